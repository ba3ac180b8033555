"""The training-data pipeline over documents: each stage applies one operator and its decisions take effect.

Stages decide and drop by a key of each row: doc_id where every row has one of its own, else a hash of id and text.  Rows
that share id and text are one document; rows without an id count as documents too.  Extra columns stay until the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import best_fit_packing, jaccard_join, quality_rules, secret_scan, winnowing
from corpusloom.llm.tables import materialise

CAPACITY = 2048
#: Keys that may be broadcast: 16 bytes each in memory, so 16 MB at most; beyond that the join shuffles.
BROADCAST_IDS = 1_000_000


def _own_ids(docs: DataFrame) -> bool:
    """True if doc_id is a whole number of every row's own."""
    whole = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return whole and docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()


def _keyed(docs: DataFrame, own: bool) -> DataFrame:
    """docs with a whole-numbered _key, null-safe; 64-bit hashes of two rows collide with a chance of about n^2 / 2^64."""
    if own:
        return docs.withColumn("_key", F.col("doc_id").cast("long"))
    return docs.withColumn("_key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs but those whose _key is in keys."""
    keys = materialise(keys.distinct())
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, "_key", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.apply_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of 5-word shingle sets 80 per cent alike."""
    own = _own_ids(docs)
    keyed = _keyed(docs, own)
    found = jaccard_join.cluster(keyed, k=5, percent=80, id_col="_key").select("_key", "component_id")
    if own:  # a component's name is its smallest id
        return _without(keyed, found.where("_key != component_id").select("_key")).select(*docs.columns)
    found = materialise(found.distinct())
    linked = found.join(found.groupBy("component_id").count().where("count > 1"), "component_id", "left_semi")
    ids = linked.join(keyed.select("_key", "doc_id").distinct(), "_key")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))["_key"].alias("first"))
    kept = _without(keyed, linked.join(first, "component_id").where("_key != first").select("_key"))
    repeated = materialise(keyed.groupBy("_key").count().where("count > 1").select("_key"))
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    many = kept.join(repeated, "_key", "left_semi").dropDuplicates(["_key"]).select(*keyed.columns)
    return _without(kept, repeated).unionByName(many).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    items, keyed = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _keyed(docs, _own_ids(docs))
    hit = winnowing.find_overlaps(keyed, items, id_col="_key").where("n_hit > 0").select("_key")
    return _without(keyed, hit).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; n_chars follows the text."""
    text = secret_scan.redacted(F.col("text"), secret_scan.scan(F.col("text")))
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: its ids' digest, sequence and offset in sequences of 2048 ids."""
    pieces = best_fit_packing.pieces_of(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY)
    return best_fit_packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]
#: SQL cannot express the tokenizer of the last stage; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

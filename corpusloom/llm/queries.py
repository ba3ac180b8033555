"""The contract queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_packing, compression_distance, crf_extraction, edit_counts, hilbert_sharding, jaccard_join, quality_rules, secret_scan, token_files, winnowing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_crf_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return crf_extraction.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets are 90 per cent alike."""
    return jaccard_join.cluster(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    out = quality_rules.measure(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document and their places in sequences of 2048 ids."""
    pieces = best_fit_packing.pieces_of(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return best_fit_packing.pack(digests, 2048)


def op5_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, before and after the house edits."""
    return edit_counts.counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_compression_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document; labels of the held-out fold are never read."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = compression_distance.fit(docs, labels.where(~compression_distance.in_fold("doc_id")))
    scored = compression_distance.score(docs, model)
    return scored.select("doc_id", compression_distance.in_fold("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that occur in windows of benchmark items."""
    out = winnowing.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    out = hilbert_sharding.shard(_table(spark, sf_dir, "documents"), 24)
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and digests of every document's ids, as read back from the token files."""
    folder = token_files.new_folder(spark)
    token_files.write(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    out = token_files.read(spark, folder)
    n = F.expr("octet_length(ids) div 4").cast("long")
    return out.select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of every document's secrets."""
    found = secret_scan.scan_documents(_table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["k"] < 3)
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(secret_scan.spelled(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.spelled(F.col("spans")).alias("spans"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_crf_extraction, op2_jaccard_join, op3_quality_rules, op4_best_fit_packing, op5_edit_counts, op6_compression_distance, op7_winnowing, op8_hilbert_sharding, op9_token_files, op10_secret_scan)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)

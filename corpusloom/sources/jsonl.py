"""JSON-lines sources with dense ordinals, fingerprinted inputs, prefix and staged sinks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: 2 to the 64th, as a decimal in SQL.
TWO_64 = "18446744073709551616BD"


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Rows of files in the order given, with line (from 1, blanks counted), path_rank and a dense ord; bad lines raise."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    parts = []
    for rank, path in enumerate([paths] if isinstance(paths, str) else paths):
        lines = spark.sparkContext.textFile(path).zipWithIndex()  # the one numbering that is dense and in file order
        numbered = spark.createDataFrame(lines, "value string, line long").withColumn("path_rank", F.lit(rank))
        parts.append(numbered)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.where(F.trim("value") != "").withColumn("_row", F.from_json("value", schema, {"mode": "FAILFAST"}))
    sizes = rows.groupBy("path_rank", F.expr("line div 65536").alias("_block")).agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window

    before = Window.orderBy("path_rank", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("path_rank", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("path_rank", "_block").orderBy("line")) - 1
    placed = rows.withColumn("_block", F.expr("line div 65536")).withColumn("_at", at).join(starts, ["path_rank", "_block"])
    return placed.select("_row.*", (F.col("line") + 1).alias("line"), "path_rank", (F.col("_before") + F.col("_at")).alias("ord"))


def scan_range(rows: DataFrame, start: int = 0, limit: int | None = None) -> DataFrame:
    """Rows from an ordinal on, up to limit of them."""
    out = rows.where(F.col("ord") >= start)
    return out if limit is None else out.where(F.col("ord") < start + limit)


def read_split(spark: SparkSession, pattern: str, split: str) -> DataFrame:
    """A Parquet source whose path is a pattern of the split's name."""
    return spark.read.parquet(pattern.format(split=split))


def file_sha256(spark: SparkSession, path: str) -> str:
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def read_fingerprinted(spark: SparkSession, path: str, schema: T.StructType | str, sha256: str) -> DataFrame:
    """read_jsonl of a file that must have this SHA-256."""
    found = file_sha256(spark, path)
    if found != sha256:
        raise ValueError(f"{path} has changed: {found}")
    return read_jsonl(spark, path, schema)


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """The fingerprints of a JSON document; simhash as a signed long."""
    raw = spark.read.schema("fingerprints array<struct<problem_id:string,sha256:string,simhash:decimal(20,0),normalized_length:int>>").option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("fingerprints").alias("eval_ord", "f")).select("eval_ord", "f.*")
    signed = F.when(F.col("simhash") > F.expr("9223372036854775807BD"), F.col("simhash") - F.expr(TWO_64)).otherwise(F.col("simhash"))
    return rows.withColumn("simhash", signed.cast("long"))


def write_jsonl(rows: DataFrame, path: str, ordinal: str = "ord") -> None:
    """Rows in order as JSON lines; range-partitioned, so part files follow the order."""
    rows.repartitionByRange(F.col(ordinal)).sortWithinPartitions(ordinal).drop(ordinal).write.mode("overwrite").json(path)


def write_prefixes(rows: DataFrame, folder: str, sizes: list[int], ordinal: str = "ord") -> dict[int, str]:
    """Nested prefixes, named by their exact size."""
    out = {n: f"{folder}/prefix_{n}" for n in sorted(sizes)}
    for n, path in out.items():
        write_jsonl(rows.where(F.col(ordinal) < n), path, ordinal)
    return out


def signature(config: dict) -> str:
    """SHA-256 of a configuration's canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def staged(spark: SparkSession, folder: str, config: dict, build) -> DataFrame:
    """The table that build() gives under this configuration, computed once and found again by its signature."""
    path = f"{folder}/{signature(config)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_generations(rows: DataFrame, path: str, batch: str) -> None:
    """Whole problems of generation records, as the table of a batch: written again, a batch replaces itself, so a retry repeats nothing."""
    rows.drop("batch_id").write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch}")


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    """All batches of a generation table."""
    return spark.read.option("basePath", path).parquet(path).drop("batch_id")


def fingerprint_json(fingerprints: DataFrame) -> DataFrame:
    """One row, the document that read_fingerprints reads: (problem_id, sha256, simhash, normalized_length) in order of eval_ord.

    Evaluation sets are small: the rows are gathered to one.
    """
    unsigned = F.col("simhash").cast("decimal(20,0)") + F.when(F.col("simhash") < 0, F.expr(TWO_64)).otherwise(F.lit(0).cast("decimal(20,0)"))
    row = F.struct("eval_ord", "problem_id", "sha256", unsigned.cast("decimal(20,0)").alias("simhash"), "normalized_length")
    listed = F.transform(F.sort_array(F.collect_list(row)), lambda x: F.struct(x["problem_id"].alias("problem_id"), x["sha256"].alias("sha256"), x["simhash"].alias("simhash"), x["normalized_length"].alias("normalized_length")))
    return fingerprints.agg(listed.alias("fingerprints"))


def write_fingerprints(fingerprints: DataFrame, path: str) -> None:
    fingerprint_json(fingerprints).coalesce(1).write.mode("overwrite").json(path)

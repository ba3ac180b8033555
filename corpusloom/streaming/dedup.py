"""Incremental best-row deduplication: micro-batches merged into a table.

The best row of a group is a maximum, so merging batches in any order gives the
same table as one batch over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators.curate import best_by


def stream_best(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, key: str, order: list[Column], first_seen: str = "ord") -> None:
    """Merges every new file of source into table (a folder of versions); ends when all are read."""

    def merge(batch: DataFrame, number: int) -> None:
        kept = batch
        if number:
            before = spark.read.parquet(f"{table}/v{number - 1}")
            kept = before.select(*batch.columns).unionByName(batch)
        best_by(kept, key, order, first_seen).select(*batch.columns).write.mode("overwrite").parquet(f"{table}/v{number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
    rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, table: str, last: int) -> DataFrame:
    return spark.read.parquet(f"{table}/v{last}")

"""Places in a total order over a whole table, without a window over it."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _fixed(rows: DataFrame) -> DataFrame:
    """rows, computed once into the shared checkpoint folder, with their partitions and order kept."""
    sc = rows.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = rows.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corpusloom-"))
    return rows.checkpoint(eager=True)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place, from 0: sorted in ranges, each counted by itself; one small row for each partition.

    Rows that are alike in order get places of their own, in any order among them.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    keyed = rows.select("*", *[o.alias(k) for o, k in zip(order, keys, strict=True)])
    spread = _fixed(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*rows.columns))
    placed = spread.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each partition
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_before") + F.col("_at")).cast("long").alias(name))


def first_rows(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows in order: Spark keeps at most limit rows of each task before the last step."""
    return rows.orderBy(*order).limit(limit)

"""Connected components of a table of links, on DataFrames.

Alternates the large-star and small-star steps, each a pre-aggregated minimum
and a join, until the links no longer change; then every component is a star
around its smallest id.  Nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step on links (a, b) with a > b."""
    if large:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m")) if large else least
    joined = near.join(least, "a")
    out = joined.where(F.col("b") > F.col("a")) if large else joined.where(F.col("b") != F.col("m"))
    out = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every id in links (a, b), component being its smallest id; ids are whole numbers.

    The result reads a table of scratch; those of earlier rounds are deleted.
    """
    now = scratch.table(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        before, now = now, scratch.table(_star(_star(now, True), False))
        scratch.drop(before)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())

"""Deduplication, ordering, quotas and splits.

Orders are explicit columns: nothing relies on the order of rows in a
DataFrame.  Global ranks come from sorted ranges, each counted by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered


def best_by(rows: DataFrame, key: str, order: list[Column], first_seen: str) -> DataFrame:
    """One row for each key, the first by order, with first_seen: the smallest ordinal of its group.

    A pre-aggregating maximum, so that a hot key costs one row per task, and partial results can be fed in again.
    """
    best = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_best")
    kept = rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(F.col(key).alias("_key")).agg(best, F.min(first_seen).alias("first_seen"), F.count(F.lit(1)).alias("group_size"))
    return kept.select("_best.*", "first_seen", "group_size")


def stable_key(seed: int, id_col: str) -> Column:
    """A seeded order of ids: their SHA-256 with the seed."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256)


def stable_order(rows: DataFrame, seed: int, id_col: str) -> DataFrame:
    return rows.withColumn("order_key", stable_key(seed, id_col))


def balanced_rank(rows: DataFrame, seed: int, id_col: str, buckets: list[str], name: str = "round") -> DataFrame:
    """The round in which a round-robin over buckets takes each row; order by (round, *buckets)."""
    within = Window.partitionBy(*buckets).orderBy(stable_key(seed, id_col), id_col)
    return rows.withColumn(name, F.row_number().over(within))


def dense_ordinal(rows: DataFrame, order: list[Column], id_col: str, name: str = "ord") -> DataFrame:
    """rows with their place, from 0, in a total order, ties by id; every row has a place of its own, also where ids repeat."""
    return numbered(rows, [*order, F.col(id_col)], name)


def stride_shard(rows: DataFrame, index: int, count: int, ordinal: str = "ord") -> DataFrame:
    """Every count-th row from index on."""
    if not 0 <= index < count:
        raise ValueError(f"shard {index} of {count}")
    return rows.where(F.pmod(F.col(ordinal), F.lit(count)) == index)


def nested_prefixes(rows: DataFrame, sizes: list[int], rank: str = "ord") -> dict[int, DataFrame]:
    """Prefixes of an order, each holding the smaller ones."""
    return {n: rows.where(F.col(rank) < n) for n in sorted(sizes)}


def largest_remainder(rows: DataFrame, level: str, limit: int) -> DataFrame:
    """level, n and quota: shares of limit by size, leftovers to the largest remainders, ties to the later name."""
    sizes = rows.groupBy(level).agg(F.count(F.lit(1)).alias("n"))  # a row for each level
    every = Window.partitionBy()
    total = F.sum("n").over(every)
    shares = sizes.withColumn("_total", total).withColumn("_share", F.expr(f"{limit}L * n div _total")).withColumn("_rest", F.expr(f"{limit}L * n % _total"))
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), F.desc(level)))
    out = shares.withColumn("_place", place).withColumn("_left", F.lit(limit) - F.sum("_share").over(every))
    quota = F.when(F.col("_total") <= limit, F.col("n")).otherwise(F.col("_share") + (F.col("_place") <= F.col("_left")).cast("long"))
    return out.select(level, "n", quota.alias("quota"))


def stratified_split(rows: DataFrame, id_col: str, level: str, seed: int, dev_fraction: float = 0.2) -> DataFrame:
    """rows with split: in each level the first share by seeded hash is dev (one at least), the rest eval."""
    if not 0 < dev_fraction < 1:
        raise ValueError("dev_fraction must lie between 0 and 1")
    by_level = Window.partitionBy(level)
    place = F.row_number().over(by_level.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(level), F.lit(":"), F.col(id_col).cast("string")).cast("binary"), 256), id_col))
    dev = F.greatest(F.lit(1), F.rint(F.count(F.lit(1)).over(by_level) * dev_fraction).cast("long"))
    return rows.withColumn("split", F.when(place <= dev, "dev").otherwise("eval"))


def shuffled_ids(ids: list[str], seed: int, namespace: str) -> list[str]:
    """The stdlib's seeded shuffle of an id list: for manifests of evaluation sets, which are small by nature."""
    import random

    out = list(ids)
    random.Random(f"{seed}:{namespace}").shuffle(out)
    return out


def split_manifest(splits: DataFrame, ids: str = "problem_id", split: str = "split", ordinal: str = "ord") -> dict:
    """Counts, ordered ids and their SHA-256 of an evaluation set's splits."""
    import hashlib
    import json

    rows = splits.groupBy(split).agg(F.sort_array(F.collect_list(F.struct(ordinal, ids))).alias("x")).collect()  # evaluation sets are small
    named = {r[split]: [x[ids] for x in r.x] for r in rows}
    canonical = json.dumps(named, sort_keys=True, separators=(",", ":"))
    return {"counts": {k: len(v) for k, v in named.items()}, "problem_ids": named, "split_sha256": hashlib.sha256(canonical.encode()).hexdigest()}

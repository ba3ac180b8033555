"""Evaluation metrics, percentiles and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pass_at_k

QUANTILES = (0.5, 0.9, 0.95, 0.99)


def percentile_index(n: Column, p: float, rule: str) -> Column:
    """The place, from 0, of a percentile in n sorted values: nearest by half-even rounding, or floor."""
    if rule == "round":
        return F.rint((n - 1) * F.lit(float(p))).cast("long")
    return F.least(n - 1, F.floor(F.lit(float(p)) * n))


def percentiles(rows: DataFrame, group: list[str], value: str, quantiles=QUANTILES, rule: str = "round", counted_too: bool = False) -> DataFrame:
    """A row for each group with p50, p90, ... and max: exact, from counts of each distinct value; and n_rows and mean if counted_too.

    Counting first keeps a group's rows out of one task; the window sees distinct values only.
    """
    from pyspark.sql import Window

    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*group).orderBy("_v")
    run = counted.withColumn("_to", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*group)))
    at = lambda p: percentile_index(F.col("_all"), p, rule)
    holds = lambda p: (at(p) < F.col("_to")) & (at(p) >= F.col("_to") - F.col("_n"))
    named = [F.max(F.when(holds(p), F.col("_v"))).alias(f"p{round(100 * p)}") for p in quantiles]
    more = [F.sum("_n").alias("n_rows"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean")] if counted_too else []
    return run.groupBy(*group).agg(*named, F.max("_v").alias("max"), *more)


def per_problem(records: DataFrame) -> DataFrame:
    """Counts by problem of generation records (problem_id, difficulty, extraction_success, compiled, passed, total_tests, response_length)."""
    perfect = (F.col("passed") == F.col("total_tests")) & (F.col("total_tests") > 0) & F.col("compiled")
    return records.groupBy("problem_id", "difficulty").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(perfect, F.lit(False))).alias("c"),
        F.count_if("extraction_success").alias("extracted"),
        F.count_if(F.coalesce("compiled", F.lit(False))).alias("compiled"),
        F.sum(F.coalesce("passed", F.lit(0))).alias("passed"),
        F.sum("total_tests").alias("tests"),
        F.sum("response_length").alias("length"),
    )


def require_equal_samples(records: DataFrame) -> None:
    """Raises if records are none, or problems have different numbers of samples."""
    n = records.groupBy("problem_id").count().agg(F.min("count"), F.max("count")).first()
    if n[0] is None:
        raise ValueError("no generation records")
    if n[0] != n[1]:
        raise ValueError(f"problems have {n[0]} to {n[1]} samples; every problem needs as many")


def metrics(records: DataFrame, k: int) -> DataFrame:
    """A row over all (difficulty null, overall true) and one for each difficulty; a failed extraction's tests count.

    Problems may have different numbers of samples here; require_equal_samples() refuses that.
    """
    one, many = pass_at_k(F.col("n"), F.col("c"), 1), pass_at_k(F.col("n"), F.col("c"), k)
    rated = per_problem(records).withColumn("p1", one).withColumn("pk", many)
    share = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0))
    out = rated.groupingSets([[], [F.col("difficulty")]], F.col("difficulty")).agg(
        F.grouping_id().alias("_g"),
        F.count(F.lit(1)).alias("problems"),
        F.sum("n").alias("generations"),
        share("extracted", "n").alias("extraction_rate"),
        share("compiled", "n").alias("compile_rate"),
        share("passed", "tests").alias("test_pass_rate"),
        share("length", "n").alias("mean_length"),
        F.avg("p1").alias("pass_at_1"),
        F.avg("pk").alias("pass_at_k"),
    )
    overall = F.col("_g") == 1
    return out.where(overall | (F.coalesce("difficulty", F.lit("")) != "")).withColumn("overall", overall).drop("_g")


def group_advantage(records: DataFrame, problem: str, reward: str) -> DataFrame:
    """Rewards less their problem's mean, over its deviation; 0 where all of a problem's rewards are alike."""
    stats = records.groupBy(problem).agg(F.avg(reward).alias("_m"), F.stddev_pop(reward).alias("_s"))
    value = F.when(F.col("_s") > 0, (F.col(reward) - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    return records.join(stats, problem).withColumn("advantage", value).drop("_m", "_s")

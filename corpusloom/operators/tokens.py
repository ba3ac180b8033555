"""Token counts, encoding with masks and padding, and selection within a token budget."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = -100


def char_count(c: Column) -> Column:
    return F.length(c)


def word_count(c: Column) -> Column:
    """Words between spaces of a normalised text."""
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))


def counter(encode: Callable[[str], list[int]]) -> Callable[[Column], Column]:
    """A count of any tokenizer's ids, in Arrow batches."""

    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(encode(t or "")))

    return count


def with_counts(rows: DataFrame, count: Callable[[Column], Column], fields: tuple[str, ...] = ("problem", "prompt", "reasoning", "code", "response")) -> DataFrame:
    """rows with token_counts; total is the count of prompt and response put together, not their sum."""
    own = [count(F.col(f)).cast("int").alias(f) for f in fields]
    return rows.withColumn("token_counts", F.struct(*own, count(F.concat("prompt", "response")).cast("int").alias("total")))


def budget_refill(rows: DataFrame, limit: int, target: int, total: str = "total", ordinal: str = "ord") -> DataFrame:
    """The first target rows within limit, in order, with selected_rank; ``refill_report`` counts the rest.

    Ranks come from partial counts by range of the ordinal, so no task holds all rows.
    """
    return ranked_where(rows, F.col(total) <= limit, ordinal).where(F.col("selected_rank") <= target)


def ranked_where(rows: DataFrame, keep: Column, ordinal: str, block: int = 1 << 16) -> DataFrame:
    """Kept rows with their place, from 1, in order of a dense ordinal."""
    kept = rows.where(keep).withColumn("_block", F.expr(f"{ordinal} div {block}"))
    sizes = kept.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    starts = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(ordinal))
    return kept.withColumn("_at", inside).join(starts, "_block").withColumn("selected_rank", F.col("_before") + F.col("_at")).drop("_block", "_at", "_before")


def refill_report(rows: DataFrame, limit: int, target: int, total: str = "total", ordinal: str = "ord") -> DataFrame:
    """selected, and rejected_total_tokens: rows over the limit before the target was reached."""
    chosen = budget_refill(rows, limit, target, total, ordinal).agg(F.count(F.lit(1)).alias("selected"), F.max(ordinal).alias("last"))
    over = rows.where(F.col(total) > limit).crossJoin(F.broadcast(chosen))  # one row
    reached = (F.col("selected") < target) | (F.col(ordinal) < F.col("last"))
    counted = over.agg(F.count_if(reached).alias("rejected_total_tokens"))
    return chosen.select("selected").crossJoin(counted)


def encode_masked(rows: DataFrame, prompt_ids: str, response_ids: str, eos: int, max_length: int) -> DataFrame:
    """rows with input_ids, labels (the prompt masked), length and error (over-long rows are never cut)."""
    ids = F.concat(prompt_ids, response_ids, F.array(F.lit(eos)))
    labels = F.concat(F.array_repeat(F.lit(MASK), F.size(prompt_ids)), response_ids, F.array(F.lit(eos)))
    length = F.size(prompt_ids) + F.size(response_ids) + 1
    error = F.when(length > max_length, "too_long")
    return rows.withColumn("input_ids", ids).withColumn("labels", labels).withColumn("length", length).withColumn("error", error)


def collate(rows: DataFrame, batch: str, pad: int, multiple: int = 8) -> DataFrame:
    """Rows padded to their batch's longest, rounded up to a multiple, with attention_mask."""
    longest = F.max("length").over(Window.partitionBy(batch))
    width = (F.ceil(longest / multiple) * multiple).cast("int")
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("_w") - F.col("length")))
    mask = F.concat(F.array_repeat(F.lit(1), F.col("length")), F.array_repeat(F.lit(0), F.col("_w") - F.col("length")))
    out = rows.withColumn("_w", width).withColumn("attention_mask", mask)
    return out.withColumn("input_ids", fill(F.col("input_ids"), pad)).withColumn("labels", fill(F.col("labels"), MASK)).withColumnRenamed("_w", "width")

"""Selecting training rows: loading orders, bounded short subsets, small filters and set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .metrics import percentiles
from .order import first_rows

#: Fixed value: the least length of a question.
MIN_QUESTION = 80


def load_rows(rows: DataFrame, limit: int | None = None, selection: str = "ordered", ordinal: str = "ord", total: str = "token_counts.total", id_col: str = "problem_id") -> DataFrame:
    """Training rows in file order, or the shortest ones first (by total, then id); limit rows of them, or all."""
    orders = {"ordered": [F.col(ordinal)], "shortest": [F.col(total), F.col(id_col)]}
    if selection not in orders:
        raise ValueError(f"selection must be one of {', '.join(orders)}, not {selection}")
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    return rows.orderBy(*orders[selection]) if limit is None else first_rows(rows, orders[selection], limit)


def question_reason(question: Column, least: int = MIN_QUESTION) -> Column:
    """missing_question for a null, empty or "-" question, short_question for one of fewer than least characters, or null."""
    text = strip(F.coalesce(question, F.lit("")))
    return F.when(text.isin("", "-"), "missing_question").when(F.length(text) < least, "short_question")


def select_short_rows(rows: DataFrame, limit: int, target: int, verified: str = "verified", length: str = "token_counts.response", id_col: str = "problem_id", ordinal: str = "ord") -> DataFrame:
    """The first target verified rows whose response has at most limit tokens; raises if they are fewer or share an id.

    target is a report's size: the rows are counted on the driver.
    """
    kept = first_rows(rows.where(F.col(verified) & (F.col(length) <= limit)), [F.col(ordinal)], target)
    n, distinct = kept.agg(F.count(F.lit(1)), F.count_distinct(id_col)).first()
    if n < target:
        raise ValueError(f"{n} rows are verified and short enough; {target} were wanted")
    if distinct < n:
        raise ValueError("selected rows share an id")
    return kept


def short_stats(rows: DataFrame, length: str) -> DataFrame:
    """One row: rows, p50, p90, p95, p99, max (by floor rank) and mean of a length."""
    return percentiles(rows.select(F.col(length).alias("length")), [], "length", rule="floor", counted_too=True)


def histogram(rows: DataFrame, field: str) -> DataFrame:
    """value and n of a field; null and empty count as unknown."""
    value = F.col(field).cast("string")
    return rows.groupBy(F.when(F.coalesce(value, F.lit("")) == "", "unknown").otherwise(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def split_counts(splits: DataFrame, level: str, levels: list[str], split: str = "split") -> DataFrame:
    """A row for each split: total, and a count for each level, 0 where it has none."""
    counts = [F.count_if(F.col(level) == x).alias(x) for x in levels]
    return splits.groupBy(split).agg(F.count(F.lit(1)).alias("total"), *counts)


def require_levels(rows: DataFrame, level: str, levels: list[str]) -> None:
    """Raises unless rows have exactly these levels."""
    found = {r[0] for r in rows.select(level).distinct().limit(len(levels) + 1).collect()}
    if found != set(levels):
        raise ValueError(f"{level} holds {sorted(map(str, found))}, not {sorted(levels)}")


def shared_ids(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """The distinct ids that both sides hold."""
    return left.select(id_col).intersect(right.select(id_col))


def selected_tokens(rows: DataFrame, length: str, id_col: str, ordinal: str) -> DataFrame:
    """One row: rows, the sum of their lengths and the SHA-256 of their ids in order, comma-joined; for selections of a report's size."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(ordinal, F.col(id_col).cast("string").alias("id")))), lambda x: x["id"]), ",")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(length).alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"))


def with_reason_prefix(report: DataFrame, prefix: str, reason: str = "reason") -> DataFrame:
    """The rows of a reject report whose reason starts with prefix."""
    return report.where(F.col(reason).startswith(prefix))

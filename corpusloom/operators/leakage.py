"""Leak joins: training rows against evaluation rows, the first match in evaluation order.

Exact matches are hash joins against one row for each distinct text.  Near
duplicates differ in at most MAX_BITS bits of their fingerprints: of eight
blocks of a fingerprint at least two agree, so an equi-join on each choice of
two blocks (28 keys of 16 bits), checked on whole fingerprints, finds all of
them without a cross join.  Equal fingerprints are joined once on either side,
so groups of copies cost a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.simhash import block_keys
from ..functions.text import hamming

MAX_BITS, MIN_LENGTH = 6, 100
REASONS = ("problem_id", "normalized_sha256", "near_duplicate_simhash")
#: The same matches as seen by the curation of training rows, which has no ids to compare.
CURATION_REASONS = {"normalized_sha256": "eval_exact", "near_duplicate_simhash": "eval_near_duplicate"}


def near_fingerprints(left: DataFrame, right: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(l, r, distance) of all pairs of distinct fingerprints (simhash) within max_bits."""

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        own = rows.select(F.col("simhash").alias(name)).where(F.col(name).isNotNull()).distinct()
        return own.select(name, F.explode(block_keys(F.col(name), max_bits)).alias("_key")).select(name, "_key.*")

    met = keyed(left, "l").join(keyed(right, "r"), ["choice", "value"])
    return met.select("l", "r", hamming(F.col("l"), F.col("r")).alias("distance")).where(F.col("distance") <= max_bits).distinct()


def near_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, max_bits: int = MAX_BITS) -> DataFrame:
    """(left_id, right_id, distance) of all pairs of rows within max_bits; both sides have simhash."""
    pairs = near_fingerprints(left, right, max_bits)
    named = pairs.join(left.select(left_id, F.col("simhash").alias("l")), "l").join(right.select(right_id, F.col("simhash").alias("r")), "r")
    return named.select(left_id, right_id, "distance")


def find_leaks(training: DataFrame, evaluation: DataFrame, use_ids: bool = True) -> DataFrame:
    """(training_id, eval_id, reason): the first evaluation row, by eval_ord, that each training row matches.

    training: training_id, [problem_id,] sha256, simhash, normalized_length; evaluation: eval_id, eval_ord and the same.
    """
    first = F.min(F.struct("eval_ord", "eval_id")).alias("m")
    hit = lambda rows, rank: rows.select("training_id", F.struct(F.col("m.eval_ord"), F.lit(rank).alias("rank"), F.col("m.eval_id")).alias("m"))
    hits = hit(training.join(evaluation.groupBy("sha256").agg(first), "sha256"), 1)
    if use_ids:
        hits = hits.unionByName(hit(training.join(evaluation.groupBy("problem_id").agg(first), "problem_id"), 0))
    long_t, long_e = (x.where(F.col("normalized_length") >= MIN_LENGTH) for x in (training, evaluation))
    of_print = long_e.groupBy(F.col("simhash").alias("r")).agg(first)
    near = near_fingerprints(long_t, long_e).join(of_print, "r").groupBy(F.col("l").alias("simhash")).agg(F.min("m").alias("m"))
    hits = hits.unionByName(hit(long_t.join(near, "simhash"), 2))
    least = hits.groupBy("training_id").agg(F.min("m").alias("m"))
    reason: Column = F.get(F.array(*[F.lit(r) for r in REASONS]), F.col("m.rank"))
    return least.select("training_id", F.col("m.eval_id").alias("eval_id"), reason.alias("reason"))


def curation_reasons(leaks: DataFrame) -> DataFrame:
    """leaks found without ids, under the reasons that the curation counts."""
    named = F.create_map(*[F.lit(x) for pair in CURATION_REASONS.items() for x in pair])
    return leaks.withColumn("reason", F.element_at(named, F.col("reason")))


def find_leaks_by_file(files: dict[str, DataFrame], evaluation: DataFrame, use_ids: bool = True) -> DataFrame:
    """find_leaks over several training files, with training_file."""
    found = [find_leaks(rows, evaluation, use_ids).select(F.lit(name).alias("training_file"), "*") for name, rows in files.items()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out

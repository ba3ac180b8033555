"""Evaluation runs: validated problems, resumable generations, shards and their merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_code


class InvalidRows(ValueError):
    """A dataset breaks a rule; the message names the first line and rule."""


def checked(rows: DataFrame, reason: str = "reason", line: str = "line") -> DataFrame:
    """rows without reason, or InvalidRows for the first that has one."""
    first = rows.where(F.col(reason).isNotNull()).orderBy(line).select(line, reason).first()
    if first is not None:
        raise InvalidRows(f"line {first[line]}: {first[reason]}")
    return rows.drop(reason)


def validate_problems(rows: DataFrame, line: str = "line") -> DataFrame:
    """Problems, after every rule held: an id, unique, a statement, C++, tests with text; and at least one row."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    # a line's place is that of its file and then its own, where rows come from several files
    place = F.struct(*[F.col(c) for c in ("path_rank", line) if c in rows.columns])
    firsts = rows.groupBy("problem_id").agg(F.min(place).alias("_first"))
    marked = rows.join(firsts, "problem_id", "left")
    bad_io = F.exists("tests", lambda t: t["input"].isNull() | t["output"].isNull())
    reason = (
        F.when(empty("problem_id"), "missing problem_id")
        .when(place > F.col("_first"), "duplicate problem_id")
        .when(empty("problem"), "empty problem")
        .when(F.coalesce(F.col("language"), F.lit("")) != "cpp", "language is not cpp")
        .when(F.coalesce(F.size("tests"), F.lit(0)) <= 0, "no tests")
        .when(bad_io, "test input and output must be text")
    )
    out = checked(marked.withColumn("reason", reason), line=line).drop("_first")
    if out.isEmpty():
        raise InvalidRows("no problems")
    return out


def validate_manifest(problems: DataFrame, ids: list[str], ordinal: str = "ord") -> None:
    """Raises unless the problems' ids, in order, are those of a manifest."""
    want = problems.sparkSession.createDataFrame(list(enumerate(ids)), "pos long, want string")
    wrong = problems.select(F.col(ordinal).alias("pos"), "problem_id").join(want, "pos", "full_outer").where(~F.col("problem_id").eqNullSafe(F.col("want")))
    if not wrong.isEmpty():
        raise InvalidRows("problems differ from the manifest")


def completed(records: DataFrame, problems: DataFrame, samples: int) -> DataFrame:
    """Ids with all their samples; raises for unknown ids, bad or repeated sample indexes, and partial problems."""
    if not records.join(problems, "problem_id", "left_anti").isEmpty():
        raise InvalidRows("records of unknown problems")
    if not records.where(F.col("sample_index").isNull() | (F.col("sample_index") < 0) | (F.col("sample_index") >= samples)).isEmpty():
        raise InvalidRows("sample_index out of range")
    counted = records.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sample_index").alias("d"))
    if not counted.where((F.col("n") != samples) | (F.col("d") != samples)).isEmpty():
        raise InvalidRows("partial or repeated samples")
    return counted.select("problem_id")


def pending(problems: DataFrame, done: DataFrame) -> DataFrame:
    return problems.join(done, "problem_id", "left_anti")


def generate(problems: DataFrame, generator: Callable[[list[str]], list[list[dict]]], prompt: str = "prompt") -> DataFrame:
    """A row for each sample: text, token_count and finish_reason, from a batch generator.

    Generation may not repeat itself, so write the result before using it twice.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row, samples in zip(frame.itertuples(index=False), generator(frame[prompt].tolist()), strict=True):
                yield pd.DataFrame([{"problem_id": row.problem_id, "sample_index": i, **s} for i, s in enumerate(samples)], columns=["problem_id", "sample_index", "text", "token_count", "finish_reason"])

    return problems.select("problem_id", prompt).mapInPandas(run, "problem_id string, sample_index int, text string, token_count int, finish_reason string")


def replay(recorded: dict[str, list[dict]]) -> Callable[[list[str]], list[list[dict]]]:
    """A generator that answers prompts from a record."""
    return lambda prompts: [recorded[p] for p in prompts]


def shard_report(records: DataFrame, ids: DataFrame, samples: int) -> DataFrame:
    """One row: duplicate, missing and extra (problem_id, sample_index) keys of merged shards."""
    expected = ids.select("problem_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample_index")).withColumn("_want", F.lit(1))
    got = records.groupBy("problem_id", "sample_index").agg(F.count(F.lit(1)).alias("_got"))
    both = expected.join(got, ["problem_id", "sample_index"], "full_outer")
    return both.agg(
        F.coalesce(F.sum(F.greatest(F.col("_got") - 1, F.lit(0))), F.lit(0)).cast("long").alias("duplicates"),
        F.count_if(F.col("_got").isNull()).alias("missing"),
        F.count_if(F.col("_want").isNull()).alias("extra"),
    )


def merge_shards(shards: list[DataFrame], ids: DataFrame, samples: int) -> DataFrame:
    """All shards' records with pos, the manifest's place (ids: problem_id, pos); raises unless each key is there once."""
    records = shards[0]
    for s in shards[1:]:
        records = records.unionByName(s)
    found = shard_report(records, ids, samples).first()
    if any(found):
        raise InvalidRows(f"{found.duplicates} duplicate, {found.missing} missing and {found.extra} extra records")
    return records.join(ids, "problem_id").orderBy("pos", "sample_index")


def generation_records(rows: DataFrame) -> DataFrame:
    """Records of generations (problem_id, difficulty, sample_index, prompt, response, response_tokens, finish_reason, tests), to be judged.

    Adds response_length, total_tests, the code found and extraction_success; a null response is empty.
    """
    response = F.coalesce("response", F.lit(""))
    coded = rows.withColumn("response", response).withColumn("code", extract_code(F.col("response")))
    return coded.select(
        "problem_id", "difficulty", "sample_index", "prompt", "response",
        F.length("response").alias("response_length"), "response_tokens", "finish_reason",
        F.coalesce(F.size("tests"), F.lit(0)).alias("total_tests"),
        F.col("code").isNotNull().alias("extraction_success"), "code",
    )


def judged_records(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """records with judge, the verdict by (problem_id, sample_index); null where no code was found."""
    rest = [c for c in verdicts.columns if c not in ("problem_id", "sample_index")]
    own = verdicts.select("problem_id", "sample_index", F.struct(*rest).alias("judge"))
    joined = records.join(own, ["problem_id", "sample_index"], "left")
    return joined.withColumn("judge", F.when(F.col("extraction_success"), F.col("judge")))


def request_batches(rows: DataFrame, size: int, ordinal: str = "ord") -> DataFrame:
    """rows with batch: consecutive runs of size rows of a dense ordinal."""
    if size <= 0:
        raise ValueError("size must be positive")
    return rows.withColumn("batch", F.expr(f"{ordinal} div {int(size)}"))

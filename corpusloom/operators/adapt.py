"""Adapters from upstream rows to problems and samples, with reasons for rejected ones."""

from __future__ import annotations

import base64
import json
import pickletools
import zlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import difficulty, render_response, split_generation, strip

#: Fixed value: the source that samples name.
SOURCE = "nvidia/OpenCodeReasoning-2"
LEVELS = ("easy", "medium", "hard")
TESTS = "array<struct<input:string,output:string,testtype:string>>"
#: The pickle operations of a lone string.
_SAFE = frozenset(["PROTO", "FRAME", "BINUNICODE", "SHORT_BINUNICODE", "MEMOIZE", "STOP"])


def _decoded(value: str | None) -> str | None:
    """The JSON list in an encoded test column; None if it is not one.  Pickles are read as operations, never loaded."""
    if not value:
        return "[]"
    try:
        raw = zlib.decompress(base64.b64decode(value))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            steps = [(op.name, arg) for op, arg, _ in pickletools.genops(raw)]
            strings = [arg for name, arg in steps if "UNICODE" in name]
            if len(strings) != 1 or not _SAFE.issuperset(name for name, _ in steps):
                return None
            text = strings[0]
        return text if isinstance(json.loads(text), list) else None
    except (ValueError, zlib.error, UnicodeDecodeError):
        return None


@F.pandas_udf(T.StringType())
def decode_private_tests(values: pd.Series) -> pd.Series:
    return values.map(_decoded)


def adapt_problems(raw: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Problems with reason: null for accepted rows; the first of a repeated problem_id stays."""
    required = ("question_id", "question_content", "platform", "difficulty")
    missing = F.lit(None).cast("string")
    for name in reversed(required):
        missing = F.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit(f"missing_{name}")).otherwise(missing)
    rows = raw.withColumn("_private", decode_private_tests("private_test_cases"))
    rows = rows.withColumn("_public", F.from_json(F.coalesce("public_test_cases", F.lit("[]")), TESTS)).withColumn("_more", F.from_json("_private", TESTS))
    rows = rows.withColumn("_tests", F.concat("_public", "_more")).withColumn("difficulty", F.lower("difficulty"))
    bad_io = F.exists("_tests", lambda t: t["input"].isNull() | t["output"].isNull())
    reason = (
        F.when(missing.isNotNull(), missing)
        .when(~F.col("difficulty").isin(*LEVELS), "difficulty")
        .when(F.col("_public").isNull(), "public_test_cases")
        .when(F.col("_more").isNull(), "private_test_cases")
        .when(F.exists("_tests", lambda t: F.coalesce(t["testtype"], F.lit("stdin")) != "stdin"), "not_stdin")
        .when(bad_io, "test_io")
        .when(F.size("_tests") == 0, "no_tests")
    )
    adapted = rows.withColumn("reason", reason).withColumn("problem_id", F.concat_ws(":", F.lit("livecodebench"), "platform", "question_id"))
    nth = F.row_number().over(Window.partitionBy("problem_id", F.col("reason").isNull()).orderBy(ordinal))
    adapted = adapted.withColumn("reason", F.when(F.col("reason").isNull() & (nth > 1), "duplicate_problem_id").otherwise(F.col("reason")))
    tests = F.transform("_tests", lambda t: F.struct(t["input"].alias("input"), t["output"].alias("output")))
    upstream = F.coalesce(F.from_json("metadata", "map<string,string>"), F.expr("map()").cast("map<string,string>"))
    own = F.create_map(F.lit("platform"), F.col("platform"), F.lit("contest_id"), F.col("contest_id"), F.lit("contest_date"), F.col("contest_date"), F.lit("title"), F.col("question_title"))
    merged = F.map_from_entries(F.concat(F.filter(F.map_entries(own), lambda e: ~F.array_contains(F.map_keys(upstream), e["key"])), F.map_entries(upstream)))
    return adapted.select(ordinal, "problem_id", F.lit("livecodebench").alias("source"), F.col("question_content").alias("problem"), F.lit("cpp").alias("language"), "difficulty", tests.alias("tests"), merged.alias("metadata"), "reason")


def adapt_samples(candidates: DataFrame, question: str = "question", source: str = SOURCE) -> DataFrame:
    """Training samples with reason, from candidates that carry their question."""
    parsed = split_generation(F.col("r1_generation"))
    rate = strip(F.coalesce(F.col("pass_rate").cast("string"), F.lit("-1"))).try_cast("double")
    rows = candidates.withColumn("_p", parsed).withColumn("_rate", rate)
    asked = strip(F.coalesce(F.col(question), F.lit("")))
    reason = F.when(F.col("_p").isNull(), "unparseable_generation").when((asked == "") | (asked == "-"), "missing_question").when(F.col("_rate").isNull() | F.isnan("_rate"), "invalid_pass_rate")
    verified = F.col("_rate") >= 0
    meta = F.struct(F.col("id").alias("original_id"), F.col("question_id").alias("original_question_id"), "dataset", F.col("split").alias("dataset_split"), F.col("index").alias("dataset_index"), F.col("source").alias("platform"), F.col("difficulty").alias("difficulty_raw"), "judgement", F.col("_rate").alias("pass_rate"), "license")
    return rows.select(
        F.concat(F.lit("ocr2:"), "question_id").alias("problem_id"),
        F.concat(F.lit("ocr2:"), "id").alias("sample_id"),
        F.lit(source).alias("source"),
        asked.alias("problem"),
        difficulty(F.col("difficulty")).alias("difficulty"),
        F.array().cast("array<string>").alias("tags"),
        F.col("_p.reasoning").alias("reasoning"),
        F.col("_p.code").alias("code"),
        render_response(F.col("_p.reasoning"), F.col("_p.code")).alias("response"),
        F.lit("cpp").alias("language"),
        verified.alias("verified"),
        meta.alias("metadata"),
        reason.alias("reason"),
    )


def lookup_questions(candidates: DataFrame, questions: DataFrame, ordinal: str = "ord") -> DataFrame:
    """candidates with question by (dataset, split, index); the last of repeated questions counts, unresolved ones are null."""
    last = questions.groupBy("dataset", "split", F.col("index").cast("long").alias("_index")).agg(F.max_by("question", ordinal).alias("question"))
    keyed = candidates.withColumn("_index", F.expr("try_cast(index as bigint)"))
    return keyed.join(last, ["dataset", "split", "_index"], "left").drop("_index")


def reject_report(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows by reason, in one pass; accepted ones have none."""
    return rows.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("n"))

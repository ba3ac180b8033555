"""Small helpers for building native Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of the white space characters that end a word, U+0020 and U+0009 to U+000D, and any other character.
WORD_SPACE, WORD_CHAR = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text: maximal runs of other characters than white space."""
    return F.filter(F.split(text, WORD_SPACE, -1), lambda w: w != "")


def indices(n: Column) -> Column:
    """0 to n - 1; empty where n is 0 or less."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

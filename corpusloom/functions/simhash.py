"""64-bit SimHash fingerprints of normalised problems.

``simhash`` follows the published definition (BLAKE2b features) in an Arrow
function; ``simhash_md5`` is the same sum over MD5 features in built-in
expressions.  Features are word trigrams, single words where there are fewer
than three, counted as often as they occur; an empty text has all bits set.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let, normalized

#: Blocks of 8 bits that a fingerprint is cut into.
BLOCKS = 8


def _fingerprint(text: str) -> int:
    words = text.split(" ") if text else []
    features = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else words
    if not features:
        return -1
    raw = b"".join(hashlib.blake2b(f.encode(), digest_size=8).digest() for f in features)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) >= len(features)).view(">i8")[0])


@F.pandas_udf(T.LongType())
def _blake2b(texts: pd.Series) -> pd.Series:
    return texts.map(_fingerprint)


def simhash(problem: Column) -> Column:
    """The fingerprint as a signed long."""
    return _blake2b(normalized(problem))


def features(problem: Column) -> Column:
    def of(t: Column) -> Column:
        words = F.filter(F.split(t, " "), lambda w: w != "")
        return let(words, lambda w: F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(w))

    return let(normalized(problem), of)


def simhash_md5(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col and simhash over MD5 features, in one pre-aggregated shuffle of 64 counts for each text."""
    halves = [F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(2)]
    hashed = rows.select(id_col, F.explode_outer(features(F.col(text_col))).alias("f")).select(id_col, F.md5(F.col("f").cast("binary")).alias("h"))
    parts = hashed.select(id_col, halves[0].alias("a"), halves[1].alias("b"), F.col("h").isNotNull().cast("int").alias("one"))
    sums = [F.sum(F.shiftright(F.col("a" if i < 32 else "b"), 31 - i % 32).bitwiseAND(1)).alias(f"s{i}") for i in range(64)]
    counted = parts.groupBy(id_col).agg(F.sum("one").alias("n"), *sums)
    word = lambda lo: sum((F.when(2 * F.coalesce(F.col(f"s{i}"), F.lit(0)) >= F.col("n"), F.lit(1 << (31 - i % 32))).otherwise(0).cast("long") for i in range(lo, lo + 32)), F.lit(0).cast("long"))
    return counted.select(id_col, F.shiftleft(word(0), 32).bitwiseOR(word(32)).alias("simhash"))


def block_keys(fingerprint: Column, max_bits: int) -> Column:
    """A key for each choice of BLOCKS - max_bits blocks: fingerprints within max_bits agree in all blocks of one choice."""
    if not 0 <= max_bits < BLOCKS:
        raise ValueError(f"{BLOCKS} blocks find distances of {BLOCKS - 1} bits at most")
    masks = [sum(0xFF << 8 * i for i in choice) for choice in itertools.combinations(range(BLOCKS), BLOCKS - max_bits)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.array(*[F.struct(F.lit(i).alias("choice"), fingerprint.bitwiseAND(F.lit(m).cast("long")).alias("value")) for i, m in enumerate(masks)])

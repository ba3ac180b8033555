"""Benchmark decontamination by winnowing.

Both sides keep fingerprints: of every ``WINDOW - K + 1`` consecutive hashes of
K-word grams, the smallest (the rightmost of equals).  The choice depends on
these words alone, so each run of WINDOW words that a document shares with an
item has a fingerprint in common, at the same place of the run.  Fingerprints
are joined, each joint one is extended word by word to both sides (the words
themselves are compared, so hash collisions cannot count), and runs of WINDOW
words or more are hits.  Items shorter than WINDOW words are one window of
their own length; documents are searched for those by their grams of just the
lengths that such items have.

Bounds: document fingerprints first pass a Bloom filter of fixed size built
from the item side, so that only likely hits are shuffled.  The item side is
broadcast if its counted rows are within ``BROADCAST_ROWS``; beyond that the
join shuffles, where adaptive execution splits skewed fingerprints.

Defined results: a null text, on either side, has no words.  Documents that
repeat (same id and text) get equal rows.  Only the id and text columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialise
from .wordhash import ALNUM, Words, grams, mix, of_texts, signed

WINDOW, K = 10, 5
BROADCAST_ROWS = 100_000
FILTER_BITS = 1 << 22
_WINNOWED = WINDOW  # the kind of winnowed fingerprints; shorter kinds are an item's whole length


def winnow(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places of the fingerprints among the words, and their hashes."""
    g = grams(words.hashes, K)
    span = WINDOW - K + 1
    n = len(g) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), g[:0]
    best, place = g[:n].copy(), np.arange(n)
    for j in range(1, span):
        other = g[j : j + n]
        lower = other <= best
        best = np.where(lower, other, best)
        place = np.where(lower, np.arange(j, j + n), place)
    within = np.repeat(words.at[1:], np.diff(words.at))[:n] >= np.arange(n) + WINDOW
    places = np.unique(place[within])
    return places, g[places]


def _bits(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return fp & np.uint64(FILTER_BITS - 1), (mix(fp) >> np.uint64(40)) & np.uint64(FILTER_BITS - 1)


def _fingerprints(words: Words, lengths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, places, hashes): winnowed ones, and all grams of these lengths."""
    yield (_WINNOWED, *winnow(words))
    for n in lengths:
        g = grams(words.hashes, n)
        ends = np.repeat(words.at[1:], np.diff(words.at))[: len(g)]
        places = np.flatnonzero(ends >= np.arange(len(g)) + n)
        yield n, places, g[places]


def _context(words: Words, text: int, place: int, kind: int) -> tuple[list[str], int]:
    """The words that can take part in a window over this gram, and the gram's place among them."""
    reach, size = (WINDOW - K, K) if kind == _WINNOWED else (0, kind)
    lo, hi = max(int(words.at[text]), place - reach), min(int(words.at[text + 1]), place + size + reach)
    return [words.word(w) for w in range(lo, hi)], place - lo


_SCHEMA = "kind int, fp long, place int, words array<string>, lo int"


def _arrow(cols: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in cols.items()], list(cols))


_TYPES = {"kind": pa.int32(), "fp": pa.int64(), "place": pa.int32(), "words": pa.list_(pa.string()), "lo": pa.int32()}


def _item_side(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Fingerprints of items, with the items of each."""
    kind = items.schema[item_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, types = batch.column(0), _TYPES | {"item": batch.schema.field(0).type}
            for words in of_texts(batch.column(1), ALNUM):
                cols: dict[str, list] = {k: [] for k in (*_TYPES, "item")}
                sizes = np.diff(words.at)
                for kind, places, hashes in _fingerprints(words, tuple({int(n) for n in sizes if 0 < n < WINDOW})):
                    texts = np.searchsorted(words.at, places, "right") - 1
                    for text, place, fp in zip(texts, places, signed(hashes), strict=True):
                        if kind != _WINNOWED and sizes[text] != kind:
                            continue
                        around, lo = _context(words, text, int(place), kind)
                        for k, v in zip(cols, (kind, int(fp), int(place - words.at[text]), around, lo, ids[words.first + int(text)]), strict=True):
                            cols[k].append(v.as_py() if isinstance(v, pa.Scalar) else v)
                yield _arrow(cols, types)

    rows = items.select(item_col, text_col).mapInArrow(run, f"{_SCHEMA}, item {kind}")
    return rows.groupBy("kind", "fp", "words", "lo").agg(F.collect_set(F.col("item").cast("string")).alias("items"))


def _filter_of(items: DataFrame) -> bytes:
    """A Bloom filter of the items' fingerprints: FILTER_BITS bits, whatever the number of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate(_bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(both.astype(np.int64))], ["bit"])

    bits = items.select("fp").mapInArrow(run, "bit long")
    words = bits.groupBy(F.expr("bit div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(bit % 64)))").alias("v"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for row in words.toLocalIterator():
        out[row.w] = row.v
    return out.tobytes()


def _document_side(docs: DataFrame, id_col: str, text_col: str, bloom: bytes, lengths: tuple[int, ...]) -> DataFrame:
    """A row of kind 0 for each document, and one for each fingerprint that passes the filter."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(bloom)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            types = {"id": batch.schema.field(0).type, "digest": pa.int64(), "n_words": pa.int64()} | _TYPES
            for words in of_texts(batch.column(1), ALNUM):
                n = len(words.at) - 1
                ids, digests = batch.column(0).slice(words.first, n), batch.column(2).slice(words.first, n)
                none = [None] * n
                spread = pa.array(signed(mix(digests.to_numpy(zero_copy_only=False).view(np.uint64))))
                base = [ids, digests, pa.array(np.diff(words.at)), pa.array([0] * n, pa.int32()), spread, *(pa.array(none, types[k]) for k in ("place", "words", "lo"))]
                yield pa.RecordBatch.from_arrays(base, list(types))
                cols: dict[str, list] = {k: [] for k in types}
                for kind, places, hashes in _fingerprints(words, lengths):
                    a, b = _bits(hashes)
                    hit = bits[a] & bits[b]
                    places, hashes = places[hit], hashes[hit]
                    for text, place, fp in zip(np.searchsorted(words.at, places, "right") - 1, places, signed(hashes), strict=True):
                        around, lo = _context(words, text, int(place), kind)
                        row = (ids[int(text)].as_py(), digests[int(text)].as_py(), None, kind, int(fp), int(place - words.at[text]), around, lo)
                        for k, v in zip(cols, row, strict=True):
                            cols[k].append(v)
                if cols["kind"]:
                    yield _arrow(cols, types)

    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")), F.xxhash64(F.col(text_col)))
    return rows.mapInArrow(run, f"id {kind}, digest long, n_words long, {_SCHEMA}")


def _extent(k: Column, d: Column, lo_d: Column, b: Column, lo_b: Column) -> Column:
    """Words that match to the left, whether the gram matches, and words that match to the right."""
    size = F.when(k == _WINNOWED, F.lit(K)).otherwise(k)

    def equal(i: Column) -> Column:
        return F.coalesce(F.get(d, lo_d + i) == F.get(b, lo_b + i), F.lit(False))

    def run(steps: list[Column]) -> Column:
        alive = [reduce(lambda x, y: x & y, steps[: i + 1]) for i in range(len(steps))]
        return reduce(lambda x, y: x + y, [F.when(a, 1).otherwise(0) for a in alive])

    reach = range(WINDOW - K)
    core = reduce(lambda x, y: x & y, [(size <= i) | equal(F.lit(i)) for i in range(WINDOW)])
    return F.struct(run([equal(F.lit(-i - 1)) for i in reach]).alias("left"), core.alias("core"), run([equal(size + i) for i in reach]).alias("right"), size.alias("size"))


def _union(spans: Column) -> Column:
    """Words covered by spans (s, e)."""
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["e"]).alias("end")
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def find_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For every row of docs: id_col, n_words, spans of words hit, n_hit, and the sorted items (as strings) that occur."""
    index = materialise(_item_side(items, item_col, item_text_col))
    size = index.count()
    lengths = tuple(sorted(r.kind for r in index.select("kind").distinct().collect() if r.kind != _WINNOWED))  # nine at most
    found = _document_side(docs, id_col, text_col, _filter_of(index), lengths)
    right = index.select("kind", "fp", F.col("words").alias("item_words"), F.col("lo").alias("item_lo"), "items")
    right = F.broadcast(right) if size <= BROADCAST_ROWS else right
    joint = found.join(right, ["kind", "fp"], "left")
    joint = joint.withColumn("x", _extent(F.col("kind"), F.col("words"), F.col("lo"), F.col("item_words"), F.col("item_lo")))
    need = F.when(F.col("kind") == _WINNOWED, F.lit(WINDOW)).otherwise(F.col("kind"))
    real = F.col("items").isNotNull() & F.col("x.core") & (F.col("x.left") + F.col("x.size") + F.col("x.right") >= need)
    span = F.struct((F.col("place") - F.col("x.left")).alias("s"), (F.col("place") + F.col("x.size") + F.col("x.right")).alias("e"))
    kept = joint.select("id", "digest", "n_words", F.when(real, span).alias("span"), F.when(real, F.col("items")).alias("items"))
    kept = kept.where(F.col("n_words").isNotNull() | F.col("span").isNotNull())
    by_doc = kept.groupBy("id", "digest").agg(
        F.max("n_words").alias("n_words"),
        F.count("n_words").alias("_copies"),
        F.collect_set("span").alias("spans"),
        F.collect_set("items").alias("_items"),
    )
    return by_doc.select(
        F.col("id").alias(id_col),
        "n_words",
        F.array_sort("spans").alias("spans"),
        _union(F.col("spans")).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("_items"))).alias("items"),
        F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"),
    ).drop("_copy")

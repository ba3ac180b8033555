"""Best-fit decreasing packing of documents into sequences of fixed capacity.

Capacities and piece lengths are whole numbers up to ``capacity``, so the packing
depends on the pieces' lengths alone, and a histogram of lengths (at most
``capacity`` rows, whatever the corpus) holds all that best-fit decreasing needs.
The driver runs it on that histogram: lengths from long to short, each into the
tightest open bin, which a segment tree over remaining capacities finds in
logarithmic time.  Bins with the same history are one group, as are equal
pieces, so a step places as many equal pieces as the tightest bins take; the
outcome is that of placing the pieces one at a time.  The steps number at most
a few for every pair of length and capacity.

Each step is a rule: ranks from..to among the pieces of one length go to bins
from a first one on, q pieces to a bin, at an offset.  Pieces get their rank by
counting per partition and length, then look their rule up by binary search.
No piece is shuffled by its length, so a length that a third of all pieces
share is no hot key.

Defined results: pieces of length 0 do not occur, since each document ends
with an end id; a null text is the end id alone; ties are broken by the place
in the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretokens import batches_of, encoder
from .tables import checkpointed


class CapacityTree:
    """A segment tree over remaining capacities 0 to n: which of them have open bins."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.any = np.zeros(2 * self.leaves, bool)

    def put(self, capacity: int, has: bool) -> None:
        node = capacity + self.leaves
        self.any[node] = has
        while node > 1:
            node >>= 1
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity with an open bin that is least or more."""
        node = least + self.leaves
        if self.any[node]:
            return least
        while node > 1:
            if not node & 1 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Rules (first rank, first bin, pieces a bin, offset) by length, ascending by rank; and the number of bins."""
    tree, open_bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)]  # by capacity: (first bin, bins)
    rules: dict[int, list[tuple[int, int, int, int]]] = {}
    n_bins = 0

    def keep(left: int, first: int, n: int) -> None:
        if left and n:
            open_bins[left].append((first, n))
            tree.put(left, True)

    for length in sorted(histogram, reverse=True):
        rank, count, own = 0, histogram[length], rules.setdefault(length, [])
        while rank < count:
            left = tree.tightest(length)
            if left is None:  # new bins, as many as the rest of this length fills
                left, first, n = capacity, n_bins, -(-(count - rank) // (capacity // length))
                n_bins += n
            else:
                first, n = open_bins[left].pop()
                if not open_bins[left]:
                    tree.put(left, False)
            per = left // length
            full = min(n, (count - rank) // per)
            if full:
                own.append((rank, first, per, capacity - left))
                rank += full * per
                keep(left - per * length, first, full)
            if full < n and rank < count:  # one bin takes the last pieces
                rest = count - rank
                own.append((rank, first + full, rest, capacity - left))
                rank = count
                keep(left - rest * length, first + full, 1)
                full += 1
            keep(left, first + full, n - full)
    return rules, n_bins


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every document's pieces.

    A document of more than capacity ids is cut from its end, so the first piece may be shorter.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, some in batches_of(texts):
                rows, piece, start, ids = [], [], [], []
                for i, x in enumerate(encoder(tokenizer).encode(some), first):
                    x += end
                    edges = [0, *range(len(x) % step or min(step, len(x)), len(x), step), len(x)]
                    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        rows.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        ids.append(x[a:b])
                cols = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """pieces (doc_id, piece, a length, and any other columns) with sequence_id and offset: best-fit decreasing bins of this capacity.

    pieces is computed once and kept in the checkpoint folder, so it should be narrow or worth keeping.
    """
    kept = checkpointed(pieces).withColumn("_part", F.spark_partition_id())
    sizes = checkpointed(kept.groupBy("_part", F.col(length_col).alias("_length")).agg(F.count(F.lit(1)).alias("_n")))
    histogram = {int(r["_length"]): r.n for r in sizes.groupBy("_length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    rules, _ = best_fit_decreasing(histogram, capacity)
    table = {k: np.array(v, np.int64) for k, v in rules.items()}
    shared = kept.sparkSession.sparkContext.broadcast(table)

    earlier = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = sizes.select("_part", "_length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part", "_length").orderBy("doc_id", "piece")
    numbered = kept.withColumn("_length", F.col(length_col)).withColumn("_at", F.row_number().over(inside) - 1)
    ranked = numbered.join(ranks, ["_part", "_length"]).select(*pieces.columns, F.col("_length"), (F.col("_before") + F.col("_at")).alias("_rank"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("_length", "_rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                own = length == value
                first, bins, per, at = shared.value[int(value)].T
                k = np.searchsorted(first, rank[own], "right") - 1
                nth = rank[own] - first[k]
                sequence[own] = bins[k] + nth // per[k]
                offset[own] = at[k] + nth % per[k] * value
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sequence), pa.array(offset)], names=schema.fieldNames())

    return ranked.mapInArrow(run, schema)

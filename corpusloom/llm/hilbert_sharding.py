"""Sharding along a Hilbert curve.

Metadata dimensions are quantised to ``bits`` bits each, the cell's index on the
Hilbert curve orders the rows, and equal runs of that order become shards, so
that a shard's files hold a compact region of every dimension and min/max
statistics prune on any of them.

The global order is found without a global window: rows are range partitioned
by (curve index, text hash, id), which is unique enough for a hot cell to be
split, and numbered inside each partition; the partitions' sizes (one row each) give the
offsets.  Only narrow rows are shuffled; texts stay where they are.

Defined results: null dimensions share a value of their own; a null text counts
as empty; an empty table gives no rows; equal rows get consecutive places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .native import let
from .tables import checkpointed

BITS = 5


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a cell, whose coordinates are ints of ``bits`` bits."""
    n = len(dims)

    def replaced(x: Column, changes: dict[int, Column]) -> Column:
        return F.array(*[changes.get(i, F.get(x, F.lit(i))) for i in range(n)])

    def unrotate(x: Column, q: int, i: int) -> Column:
        low = q - 1
        first, own = F.get(x, F.lit(0)), F.get(x, F.lit(i))
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        flipped = replaced(x, {0: first.bitwiseXOR(low)})
        swapped = replaced(x, {0: first.bitwiseXOR(swap), i: own.bitwiseXOR(swap)}) if i else x
        return F.when(own.bitwiseAND(q) != 0, flipped).otherwise(swapped)

    x = F.array(*[d.cast("int") for d in dims])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            x = let(x, lambda v, q=q, i=i: unrotate(v, q, i))
    for i in range(1, n):
        x = let(x, lambda v, i=i: replaced(v, {i: F.get(v, F.lit(i)).bitwiseXOR(F.get(v, F.lit(i - 1)))}))

    def fixed(v: Column) -> Column:
        last, t = F.get(v, F.lit(n - 1)), F.lit(0)
        for q in (1 << b for b in range(bits - 1, 0, -1)):
            t = t.bitwiseXOR(F.when(last.bitwiseAND(q) != 0, F.lit(q - 1)).otherwise(F.lit(0)))
        return let(t, lambda u: F.transform(v, lambda e: e.bitwiseXOR(u)))

    def woven(v: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(bits):
            for i in range(n):
                bit = F.shiftright(F.get(v, F.lit(i)), b).bitwiseAND(1).cast("long")
                out = out.bitwiseOR(F.shiftleft(bit, b * n + n - 1 - i))
        return out

    return let(let(x, fixed), woven)


def quantise_category(c: Column, bits: int = BITS) -> Column:
    """A category's cell: 0 for null, else by hash."""
    return F.when(c.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(c), F.lit((1 << bits) - 1)).cast("int") + 1)


def quantise_size(c: Column, bits: int = BITS) -> Column:
    """A size's cell: half powers of two, the last cell open-ended."""
    return F.least(F.lit((1 << bits) - 1), F.floor(F.log2(F.greatest(c, F.lit(1)).cast("double")) * 2).cast("int"))


def numbered(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """rows with their place in a total order, from 0; distributed, with one small row for each partition."""
    spread = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = spread.select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at"))
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    joined = placed.join(F.broadcast(offsets), "_pid")  # a row for each partition: bounded by their number
    return joined.select(*rows.columns, (F.col("_before") + F.col("_at")).alias(name), F.col("_total").alias("total"))


def shard(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """id, size, text_crc32, curve index, shard and slot of every row; shards' counts differ by one at most."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + 8).cast("long")
    dims = [*[quantise_category(F.col(c)) for c in categories], quantise_size(size)]
    rows = docs.select(
        F.col(id_col),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        hilbert_index(dims).alias("curve"),
    )
    ranked = numbered(rows, ["curve", "text_hash", id_col])
    rank = F.col("rank")
    # exact integer arithmetic: shard s starts at ceil(s * total / n_shards)
    at = F.expr(f"(rank * {n_shards}) div total")
    start = F.expr(f"((rank * {n_shards}) div total * total + {n_shards} - 1) div {n_shards}")
    return ranked.select(id_col, "size", "text_crc32", "curve", at.cast("int").alias("shard"), (rank - start).cast("long").alias("slot"))

"""Token-ID files: canonical, length-limited Huffman codes in independent blocks.

Documents are range partitioned by id and encoded in order; whole documents are
gathered to blocks of ``BLOCK`` ids at least.  Global counts of the ids give one
canonical code whose lengths are at most ``MAX_BITS``, found by package-merge.
Each block is coded by itself and carries the bit offset of every ``STRIDE``-th
id, so a block is decoded by table in as many lanes as it has checkpoints, and
a reader may start at any block.

A dataset is a folder with two Parquet tables: ``codebook`` (id, bits) and
``blocks`` (part, block, start: ids before it in the whole dataset, doc_ids,
counts, checkpoints, payload).  Blocks are written in order of part and block,
which is ascending order of documents.  Writing goes through Spark's committed
writers, so lost executors leave no partial files.

Bounds: the driver holds the counts of the vocabulary and one row for each
partition.  A document is never split over blocks; memory follows the longest.

Defined results: null texts are empty and have the end id alone; rows without a
document id come first; repeated ids stay in adjacent rows; an empty table gives an
empty dataset.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pretokens import batches_of, encoder
from .tables import checkpoint_dir, written

BLOCK, STRIDE, MAX_BITS = 1 << 16, 128, 20


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol in an optimal prefix code of at most limit bits; 0 for counts of 0 (package-merge)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weight, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(weight))
        merged = both[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take, bits = 2 * len(weight) - 2, np.zeros(len(weight), np.uint8)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = bits
    return out


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol, from the lengths alone."""
    out = np.zeros(len(bits), np.uint64)
    order = np.flatnonzero(bits)
    order = order[np.lexsort((order, bits[order]))]
    # a code is the sum of the shares of all codes before it, in units of its own share
    share = np.uint64(1) << (np.uint64(MAX_BITS) - bits[order].astype(np.uint64))
    before = np.cumsum(share) - share
    out[order] = before >> (np.uint64(MAX_BITS) - bits[order].astype(np.uint64))
    return out


def coded(ids: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The payload of a block, and the bit offset of every STRIDE-th id."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = bits[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    word = at >> 5
    value = codes[ids] << (64 - size - (at & 31)).astype(np.uint64)  # across two 32-bit words
    words = np.zeros(int(end[-1] >> 5) + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
    words[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes()[: int(end[-1] + 7 >> 3)], at[::STRIDE].copy()


class Table:
    """The decoding table: for every MAX_BITS bits, the symbol that they begin with and its length."""

    def __init__(self, bits: np.ndarray):
        order = np.flatnonzero(bits)
        order = order[np.lexsort((order, bits[order]))]
        share = 1 << (MAX_BITS - bits[order].astype(np.int64))
        self.symbol = np.zeros(1 << MAX_BITS, np.uint32)
        self.bits = np.ones(1 << MAX_BITS, np.uint8)
        n = int(share.sum())
        self.symbol[:n] = np.repeat(order, share)
        self.bits[:n] = np.repeat(bits[order], share)

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The n ids of a block."""
        lanes = len(checkpoints)
        out = np.zeros((STRIDE, lanes), np.uint32)
        raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at = checkpoints.astype(np.int64)
        last = len(window) - 1
        for i in range(min(STRIDE, n)):
            here = np.minimum(at >> 3, last)  # lanes that have ended run on and are cut off below
            key = (window[here] << (at & 7).astype(np.uint32)) >> np.uint32(32 - MAX_BITS)
            out[i] = self.symbol[key]
            at += self.bits[key]
        return out.T.reshape(-1)[:n]


def _encode_ordered(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """Blocks (part, block, doc_ids, counts, ids, start: ids before it in its partition) of range-partitioned documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        doc_ids: list = []
        counts: list[int] = []
        ids: list[bytes] = []
        total = before = 0

        def flush() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(ids), "<u4")
            narrow = flat.astype("<u2").tobytes() if not len(flat) or flat.max() < 1 << 16 else None
            cols = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([narrow or flat.tobytes()], pa.binary()), pa.array([narrow is not None]), pa.array([before])]
            return pa.RecordBatch.from_arrays(cols, ["part", "block", "doc_ids", "counts", "ids", "narrow", "start"])

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            names = batch.column(0).to_pylist()
            for first, some in batches_of(texts):
                for i, x in enumerate(encoder(tokenizer).encode(some), first):
                    doc_ids.append(names[i])
                    counts.append(len(x) // 4 + 1)
                    ids += (x, end)
                    total += counts[-1]
                    if total >= BLOCK:
                        yield flush()
                        before += total
                        doc_ids, counts, ids, total, block = [], [], [], 0, block + 1
        if doc_ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # documents of one id stay together; ids are unique in sound tables, so ranges are even
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return ordered.mapInArrow(run, "part int, block int, doc_ids array<long>, counts array<long>, ids binary, narrow boolean, start long")


def _flat(ids: bytes, narrow: bool) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if narrow else "<u4")


def _counts(raw: DataFrame) -> np.ndarray:
    """How often each id occurs in the whole dataset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids, narrow in zip(batch.column(0), batch.column(1), strict=True):
                seen = np.bincount(_flat(ids.as_py(), narrow.as_py()), minlength=len(total))
                seen[: len(total)] += total
                total = seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = raw.select("ids", "narrow").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row for each id of the vocabulary
    out = np.zeros(1 + max((r.id for r in rows), default=0), np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes docs and writes the dataset to folder, which all executors must share."""
    spark = docs.sparkSession
    written(_encode_ordered(docs, id_col, text_col, tokenizer, end_id), f"{folder}/raw")
    raw = spark.read.parquet(f"{folder}/raw")
    bits = code_lengths(_counts(raw))
    totals = raw.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    before, so_far = {}, 0
    for r in totals:  # one for each partition
        before[r.part] = so_far
        so_far += r.n
    book = spark.sparkContext.broadcast(bits.tobytes())
    spark.createDataFrame([(int(i), int(bits[i])) for i in np.flatnonzero(bits)], "id int, bits int").coalesce(1).write.parquet(f"{folder}/codebook")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(book.value, np.uint8)
        codes = canonical_codes(own)
        for batch in batches:
            payloads, points = [], []
            for ids, narrow in zip(batch.column(4), batch.column(5), strict=True):
                payload, checkpoints = coded(_flat(ids.as_py(), narrow.as_py()), own, codes)
                payloads.append(payload)
                points.append(checkpoints.astype("<u4").tobytes())
            start = [before[p] + s for p, s in zip(batch.column(0).to_pylist(), batch.column(6).to_pylist(), strict=True)]
            cols = [*batch.columns[:2], pa.array(start, pa.int64()), *batch.columns[2:4], pa.array(points, pa.binary()), pa.array(payloads, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["part", "block", "start", "doc_ids", "counts", "checkpoints", "payload"])

    coded_rows = raw.mapInArrow(run, "part int, block int, start long, doc_ids array<long>, counts array<long>, checkpoints binary, payload binary")
    written(coded_rows, f"{folder}/blocks", compression="none")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/raw")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian unsigned 32-bit) of every document."""
    book = spark.read.parquet(f"{folder}/codebook").collect()  # one row for each id of the vocabulary
    bits = np.zeros(1 + max((r.id for r in book), default=0), np.uint8)
    for r in book:
        bits[r.id] = r.bits
    shared = spark.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(np.frombuffer(shared.value, np.uint8))
        for batch in batches:
            for start, doc_ids, counts, checkpoints, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                flat = table.decode(payload, np.frombuffer(checkpoints, "<u4"), sum(counts)).astype("<u4")
                edges = np.cumsum([0, *counts])
                ids = pa.array([flat[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + edges[:-1]), ids], ["doc_id", "start", "ids"])

    blocks = spark.read.parquet(f"{folder}/blocks").select("start", "doc_ids", "counts", "checkpoints", "payload")
    return blocks.mapInArrow(run, "doc_id long, start long, ids binary")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"

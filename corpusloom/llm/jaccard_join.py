r"""Exact Jaccard join of word-shingle sets in metric space.

Documents are points under the Jaccard distance d = 1 - |A n B| / |A u B|; two
link when d <= r = 1 - t.

1. Neighbourhoods. Nearly all distances of a corpus are 1, and pivots cannot divide
   a space whose points are all equally far apart: the window below would put every
   document into every region.  So the first cut is none by pivots: linked sets
   share one shingle at least of their prefixes (the first |A| - ceil(t |A|) + 1
   shingles in an order common to all).  The order puts rare shingles first, by a count
   sketch of fixed size over all documents, so passages that many documents share hardly ever
   bring two together.  Inside a neighbourhood, class profiles tell which members can be linked
   at all (the number of hash classes in which two sets differ is no more than their symmetric
   difference; sizes are held against each other before, by rings of sizes); in those of over CELL members all count as such.  Documents that can be, directly
   or in a chain, make a region; linked documents are always in one.
2. Voronoi regions. A region of more than BLOCK shingles is divided by pivots, members of
   its own: each member's distance to every pivot is computed, a member belongs to the region of its
   nearest pivot q and is replicated to each other pivot p with d(x, p) <= d(x, q) + 2r
   (triangle inequality: nobody within r of x's home region is missed).  Members within r of a
   pivot are linked to it there and then, so of two of them nothing more is asked; they go on
   only where a member beyond r has come so close that d(x, p) >= d(y, p) - r.
3. Recursion. Regions that are still too large are divided again, by pivots of their own.  One
   that its pivots have left nearly whole is cut into blocks that meet pairwise, which is exact as well.
4. In a task, a region or two blocks join in the same way (pivots, windows, recursion), down to a few
   sets, which are compared exactly behind a check of finer class profiles.
   Links make a spanning forest of the region, not all pairs.

No pair closer than r is lost, and no cap is set on neighbourhoods, regions or
candidates.  Equal sets are one point from the start, so a group of copies costs
its size; a group of near copies costs about its size times its number of pivots.

Sets are kept as 64-bit shingle hashes; two texts are one point if their sets'
128-bit sums agree.

Defined results: a null text, or one without words, has an empty set and links
with nothing; with fewer than k words, the whole sequence is the one shingle.
Repeated rows get repeated results.  Ids are whole numbers (others raise) and one
document's own: rows that share an id but not a text may be joined.  A row
without an id links with nothing and has no component.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .tables import Scratch
from .wordhash import SPACED, Words, grams, mix, of_texts, signed

#: Shingles (and OVERHEAD for each set) that a task joins at once; pivots of a division; sets that are compared without dividing on.
BLOCK, OVERHEAD, PIVOTS, LEAF = 1 << 19, 64, 8, 48
#: Members of a neighbourhood that one task checks by profiles, and of one whose pairs are checked all at once.
CELL, FEW = 4096, 24
#: A division that leaves a region this share of its parent has not divided it.
SHRINK = 0.8
#: Rows (region, blocks) of 16 bytes that may be broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 1_000_000
#: The counters of the sketch, in slices that are added up by themselves.
COUNTERS, SLICES, FAN_IN = 1 << 20, 64, 64
#: Bits of the bitmap of ids whose sets are read, two set for each id: 16 an id, between these bounds (32 MB).
LEAST_BITS, MOST_BITS, BITS_AN_ID = 1 << 20, 1 << 28, 16
_SEEDS = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)
_EPS = 1e-9


class Sets:
    """Distinct shingles of consecutive texts: text t has members at[t] to at[t + 1], ascending."""

    def __init__(self, words: Words, k: int):
        n_words = np.diff(words.at)
        g = grams(words.hashes, k)
        text_of = np.repeat(np.arange(len(n_words)), n_words)
        whole = np.flatnonzero(np.repeat(words.at[1:], n_words)[: len(g)] >= np.arange(len(g)) + k)
        texts, members = text_of[whole], g[whole]
        short = np.flatnonzero((n_words > 0) & (n_words < k))
        if len(short):
            own = [grams(words.hashes[words.at[t] : words.at[t + 1]], int(n_words[t])) for t in short]
            texts, members = np.append(texts, short), np.concatenate([members, *own])
        order = np.lexsort((members, texts))
        texts, members = texts[order], members[order]
        if len(members):
            new = np.append(True, (np.diff(texts) != 0) | (np.diff(members) != 0))
            texts, members = texts[new], members[new]
        self.first, self.members = words.first, members
        self.at = np.searchsorted(texts, np.arange(len(n_words) + 1))

    def digest(self, seed: np.uint64) -> np.ndarray:
        """A sum over each text's set."""
        total = np.append(np.uint64(0), np.cumsum(mix(self.members ^ seed)))
        return total[self.at[1:]] - total[self.at[:-1]]

    def prefixes(self, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Each text's prefix: offsets and shingles, the rarest ones by counts, ties by hash."""
        size = np.diff(self.at)
        text = np.repeat(np.arange(len(size)), size)
        seen = np.minimum(counts[_counter(self.members)], (1 << 24) - 1).astype(np.uint64)
        order = np.lexsort((seen << np.uint64(40) | mix(self.members ^ _SEEDS[1]) >> np.uint64(24), text))
        length = np.where(size > 0, size - -(-size * percent // 100) + 1, 0)
        place = np.arange(len(text)) - np.repeat(self.at[:-1], size)
        return np.append(0, np.cumsum(length)), self.members[order[place < np.repeat(length, size)]]


def profiles(sets: Sets, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's profile: offsets and bytes, a sum over each of 2 ** b hash classes, twice as many as a linked pair may differ in.

    A profile of half the classes is the sum of neighbours, so two of different lengths can be compared.
    """
    size = np.diff(sets.at)
    differ = np.maximum(8, 2 * size * (100 - percent) // (100 + percent))
    classes = np.where(size > 0, 1 << np.ceil(np.log2(2 * differ)).astype(np.int64), 0)
    at = np.append(0, np.cumsum(classes))
    own = (mix(sets.members ^ _SEEDS[2]) >> np.uint64(32)) * np.repeat(classes, size).astype(np.uint64) >> np.uint64(32)
    out = np.zeros(at[-1], np.uint8)
    np.add.at(out, np.repeat(at[:-1], size) + own.astype(np.int64), (mix(sets.members ^ _SEEDS[1]) & np.uint64(255)).astype(np.uint8))
    return at, out


class Profiles:
    """Profiles of some sets, to be compared."""

    def __init__(self, size: np.ndarray, data: list[bytes], percent: int):
        self.size, self.percent = size, percent
        length = np.array([len(x) for x in data])
        self.level = np.log2(np.maximum(length, 1)).astype(np.int64)
        self.row = np.zeros(len(data), np.int64)
        self.tables: dict[tuple[int, int], np.ndarray] = {}  # by level, and the level folded down to
        for level in np.unique(self.level):
            own = np.flatnonzero(self.level == level)
            self.row[own] = np.arange(len(own))
            self.tables[int(level), int(level)] = np.frombuffer(b"".join(data[i] for i in own), np.uint8).reshape(len(own), 1 << level)

    def _folded(self, level: int, to: int) -> np.ndarray:
        if (level, to) not in self.tables:
            finer = self._folded(level, to + 1)
            self.tables[level, to] = finer[:, ::2] + finer[:, 1::2]
        return self.tables[level, to]

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True for each pair that sizes and profiles don't keep apart."""
        t, n, m = self.percent, self.size[a], self.size[b]
        out = (n * 100 >= m * t) & (m * 100 >= n * t)
        most = (n + m) * (100 - t) // (100 + t)
        kind = self.level[a] * 64 + self.level[b]
        for x in np.unique(kind[out]):
            i, j = divmod(int(x), 64)
            left, right = self._folded(i, min(i, j)), self._folded(j, min(i, j))
            step = max(1, (1 << 24) >> min(i, j))
            pairs = np.flatnonzero(out & (kind == x))
            for part in (pairs[k : k + step] for k in range(0, len(pairs), step)):
                out[part] = (left[self.row[a[part]]] != right[self.row[b[part]]]).sum(1) <= most[part]
        return out


def _neighbours(cells: np.ndarray, profiles_: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that may link, as forests inside runs of equal cells."""
    edges = np.append(np.flatnonzero(np.append(True, cells[1:] != cells[:-1])), len(cells))
    count, first = np.diff(edges), edges[:-1]
    few = count <= FEW
    out = []
    for step in range(1, FEW):  # all pairs that are so far apart, over all small neighbourhoods
        a = np.concatenate([first[few & (count > step)] + k for k in range(FEW - step)] or [first[:0]])
        a = a[a + step < len(cells)]
        a = a[cells[a] == cells[a + step]]
        if len(a):
            good = profiles_.may_link(a, a + step)
            out.append((a[good], a[good] + step))
    for k in np.flatnonzero(~few):
        left = np.arange(first[k], edges[k + 1])
        group = left[:0]
        while len(left):  # a forest: whoever is reached leaves, and reaches on
            if not len(group):
                group, left = left[:1], left[1:]
            i, group = group[:1], group[1:]
            good = profiles_.may_link(np.repeat(i, len(left)), left)
            out.append((np.repeat(i, good.sum()), left[good]))
            group, left = np.append(group, left[good]), left[~good]
    if not out:
        return first[:0], first[:0]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _shared(entered: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of entered (cell, id, and others) whose cell has several ids."""
    dealt = entered.repartition("cell")  # one exchange for the counts and for the rows
    several = dealt.groupBy("cell").agg(F.min("id").alias("b"), F.max("id").alias("most")).where("b != most")
    return scratch.table(dealt.join(several.select("cell"), "cell", "left_semi"))


def candidates(points: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) that connect whatever may be linked among points (id, n, tokens, profile)."""
    entered = _shared(points.select(F.explode("tokens").alias("cell"), "id", F.col("n").cast("int").alias("n")), scratch)
    # sizes of a linked pair lie in one ring or in neighbouring ones: rings a little wider than the sizes may differ by
    ring = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.01 * 100 / percent)))).cast("int")
    rings = entered.select(F.explode(F.array(F.xxhash64("cell", ring), F.xxhash64("cell", ring + 1))).alias("cell"), "id")
    every = _shared(rings, scratch)
    # neighbourhoods of the same members are one
    members = F.xxhash64("id")
    of = [F.count(F.lit(1)).alias("count"), F.bit_xor(members).alias("h"), F.sum(members.bitwiseAND(0xFFFFFFFF)).alias("g"), F.min("id").alias("b")]
    cells = every.groupBy("cell").agg(*of).groupBy("count", "h", "g", "b").agg(F.min("cell").alias("cell"))
    rows = scratch.table(every.join(cells.select("cell", "count", "b"), "cell"))
    scratch.drop(entered)
    scratch.drop(every)
    stars = rows.where((F.col("count") > CELL) & (F.col("id") != F.col("b"))).select(F.col("id").alias("a"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        n = 0

        def checked(table: pa.Table) -> pa.RecordBatch:
            ids = table.column("id").to_numpy()
            a, b = _neighbours(table.column("cell").to_numpy(), Profiles(table.column("n").to_numpy(), table.column("profile").to_pylist(), percent))
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

        for batch in batches:
            kept.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n < 2 * CELL:
                continue
            table = pa.concat_tables(kept)
            cells = table.column("cell").to_numpy()
            last = int(np.searchsorted(cells, cells[-1]))  # the last cell may go on
            if last:
                yield checked(table.slice(0, last))
            kept, n = [table.slice(last)], len(table) - last
        if n:
            yield checked(pa.concat_tables(kept))

    small = rows.where(F.col("count") <= CELL).select("cell", "id").distinct().join(points.select("id", "n", "profile"), "id")
    near = small.repartition("cell").sortWithinPartitions("cell", "id").select("cell", "id", "n", "profile").mapInArrow(run, "a long, b long")
    return scratch.table(stars.unionByName(near).where("a != b").distinct())


def _counter(members: np.ndarray) -> np.ndarray:
    return (mix(members ^ _SEEDS[0]) >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _read(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, n (set size), d1 and d2 (the set's digest) of every row; and for each task SLICES rows (slice, counts) of a count sketch.

    The sketch counts the hashed shingles of all texts, each text's set once, in COUNTERS counters.
    """
    width = COUNTERS // SLICES
    names = ["id", "n", "d1", "d2", "slice", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some, n = np.zeros(COUNTERS, np.uint32), [np.zeros(0, np.int64)], 0
        for batch in batches:
            for words in of_texts(batch.column(1), SPACED):
                sets = Sets(words, k)
                size = np.diff(sets.at)
                digests = [pa.array(signed(sets.digest(s))) for s in _SEEDS[:2]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(sets.first, len(size)), pa.array(size), *digests, pa.nulls(len(size), pa.int64()), pa.nulls(len(size), pa.binary())], names)
                some.append(_counter(sets.members))
                n += len(some[-1])
                if n > COUNTERS:
                    total += np.bincount(np.concatenate(some), minlength=COUNTERS).astype(np.uint32)
                    some, n = [], 0
        total += np.bincount(np.concatenate([np.zeros(0, np.int64), *some]), minlength=COUNTERS).astype(np.uint32)
        if total.any():
            slices = [pa.array(np.arange(SLICES)), pa.array([x.tobytes() for x in total.reshape(SLICES, width)], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64())] * 4 + slices, names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, n long, d1 long, d2 long, slice long, counts binary")


def rarity(read: DataFrame) -> np.ndarray:
    """The sketch of all tasks: how common a shingle is, by its counter."""
    width = COUNTERS // SLICES

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint64)
        for x in rows.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.uint32)
        most = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
        return pa.table({"slice": rows.column("slice").slice(0, 1), "counts": pa.array([most.tobytes()], pa.binary())})

    schema = "slice long, counts binary"
    parts = read.where("slice is not null").select("slice", "counts").withColumn("part", F.spark_partition_id() % FAN_IN)
    some = parts.groupBy("slice", "part").applyInArrow(add, schema)
    out = np.zeros((SLICES, width), np.uint32)
    for row in some.groupBy("slice").applyInArrow(add, schema).collect():  # COUNTERS numbers
        out[row["slice"]] = np.frombuffer(row.counts, np.uint32)
    return out.reshape(-1)


def _bits(key: Column, bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) for seed in (0, 1)])


def _filter_of(ids: DataFrame) -> tuple[bytes, bool]:
    """A bitmap over hashed ids, and whether it has BITS_AN_ID for each; past the upper bound it lets more through."""
    bits = LEAST_BITS
    n = BITS_AN_ID * ids.count()
    while bits < min(n, MOST_BITS):
        bits *= 2
    bit = ids.select(F.explode(_bits(F.col("id"), bits)).alias("bit"))
    rows = bit.groupBy(F.expr("bit div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(bit % 64)))").alias("v"))
    out = np.zeros(bits // 64, np.int64)
    for row in rows.toLocalIterator():
        out[row.w] = row.v
    return out.tobytes(), bits >= n


def _sets_of(docs: DataFrame, id_col: str, text_col: str, k: int, filter_: bytes, make, schema: str) -> DataFrame:
    """make(sets) of the texts whose id the filter lets through: a column id and those of schema."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_)
    names = ["id", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            bit = batch.column(2).flatten().to_numpy()
            found = (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).reshape(-1, 2).all(1)
            rows = pa.array(np.flatnonzero(found))
            if not len(rows):
                continue
            batch = batch.take(rows)
            for words in of_texts(batch.column(1), SPACED):
                sets = Sets(words, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(sets.first, len(sets.at) - 1), *make(sets)], names)

    key = F.col(id_col).cast("long")
    rows = docs.select(key.alias("id"), F.col(text_col).alias("text"), _bits(key, 8 * len(filter_)).alias("bits"))
    return rows.where("id is not null").mapInArrow(run, f"id long, {schema}")


def _points(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, counts: np.ndarray, ids: DataFrame) -> DataFrame:
    """id, n, tokens (the set's prefix) and profile of these ids; and of others that the filter lets through, which does no harm: they are points as well."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    data, whole = _filter_of(ids)

    def make(sets: Sets) -> list[pa.Array]:
        at, tokens = sets.prefixes(shared.value, percent)
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(signed(tokens)))
        edges, profile = profiles(sets, percent)
        return [pa.array(np.diff(sets.at)), lists, pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(profile)])]

    found = _sets_of(docs, id_col, text_col, k, data, make, "n long, tokens array<long>, profile binary").where("n > 0")
    return found if whole else found.join(ids, "id", "left_semi")


def _members(docs: DataFrame, id_col: str, text_col: str, k: int, regions: DataFrame) -> DataFrame:
    """The sets of the ids of regions (id, region), read from the texts once more: (id, members, region)."""

    def make(sets: Sets) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(sets.at.astype(np.int32)), pa.array(signed(sets.members)))]

    found = _sets_of(docs, id_col, text_col, k, _filter_of(regions)[0], make, "members array<long>")
    return found.join(regions, "id").where("size(members) > 0")


def distances(sets: list[np.ndarray], pivots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Intersections and unions of every set with every pivot."""
    size = np.array([len(x) for x in sets])
    at = np.append(0, np.cumsum(size))
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    inter = np.zeros((len(sets), len(pivots)), np.int64)
    for j, p in enumerate(pivots):
        found = np.append(0, np.cumsum(p[np.minimum(np.searchsorted(p, flat), len(p) - 1)] == flat))
        inter[:, j] = found[at[1:]] - found[at[:-1]]
    return inter, size[:, None] + np.array([len(p) for p in pivots]) - inter


class Region:
    """Sets that join in one task: links of home sets with home and replicated ones, as a forest over the labels given."""

    def __init__(self, sets: list[np.ndarray], label: np.ndarray, percent: int):
        self.sets, self.percent = sets, percent
        self.label = np.unique(label, return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
        self.size = np.array([len(x) for x in sets])
        self.links: list[tuple[int, int]] = []
        widest = int(self.size.max(initial=1))
        classes = min(2048, max(16, 8 * widest * (100 - percent) // (100 + percent)))
        self.profile = np.zeros((len(sets), classes), np.uint64)
        for row, x in zip(self.profile, sets, strict=True):
            c = (mix(x ^ _SEEDS[2]) >> np.uint64(32)) * np.uint64(classes) >> np.uint64(32)
            np.add.at(row, c.astype(np.int64), mix(x ^ _SEEDS[1]))
        self.profile = mix(self.profile).astype(np.uint32)

    def join(self, home: np.ndarray, other: np.ndarray) -> None:
        """Links the sets of home with each other and with those of other; either are places, in no order."""
        r = 1 - self.percent / 100
        todo = [(home, other)]
        while todo:
            home, other = todo.pop()
            both = np.append(home, other)
            if not len(home) or len(np.unique(self.label[both])) < 2:
                continue
            if len(both) <= LEAF:
                self._compare(home, other)
                continue
            pivots = home[np.linspace(0, len(home) - 1, PIVOTS).astype(int)] if len(home) > PIVOTS else home
            inter, union = distances([self.sets[i] for i in both], [self.sets[i] for i in pivots])
            for j, p in enumerate(pivots):
                for i in both[inter[:, j] * 100 >= union[:, j] * self.percent]:
                    self._link(int(p), int(i))
            d = 1 - inter / union
            nearest = d.argmin(1)
            enters = d <= d.min(1)[:, None] + 2 * r + _EPS
            is_home = np.arange(len(both)) < len(home)
            parts = [(both[is_home & (nearest == j)], both[enters[:, j] & ~(is_home & (nearest == j))]) for j in range(len(pivots))]
            if max(len(a) + len(b) for a, b in parts) > SHRINK * len(both):
                self._compare(home, other)
            else:
                todo += parts

    def _link(self, i: int, j: int) -> None:
        if self.label[i] != self.label[j]:
            self.label[self.label == self.label[j]] = self.label[i]
            self.links.append((i, j))

    def _compare(self, home: np.ndarray, other: np.ndarray) -> None:
        t = self.percent
        for k, i in enumerate(home):
            rest = np.append(home[k + 1 :], other)
            rest = rest[self.label[rest] != self.label[i]]
            n, m = self.size[i], self.size[rest]
            rest = rest[(n * 100 >= m * t) & (m * 100 >= n * t)]
            most = (self.size[rest] + n) * (100 - t) // (100 + t)
            for j in rest[(self.profile[rest] != self.profile[i]).sum(1) <= most]:
                if self.label[j] != self.label[i]:
                    inter = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
                    if inter * 100 >= (n + self.size[j] - inter) * t:
                        self._link(int(i), int(j))


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    lists = column.combine_chunks()
    flat, at = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


_WEIGHT = f"cast(size(members) + {OVERHEAD} as long)"


def _narrow(rows: DataFrame) -> DataFrame:
    """rows of a few numbers each, to be broadcast where they are few enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _without(parts: DataFrame, regions: DataFrame) -> DataFrame:
    return parts.join(_narrow(regions.select("region")), "region", "left_anti")


def _cut(parts: DataFrame, blocks: DataFrame) -> DataFrame:
    """parts with blocks (1 where their region is not in blocks) and block, by hash of the id."""
    cut = parts.join(_narrow(blocks), "region", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    return cut.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))


def _meet(parts: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) in regions: parts are (region, id, label, home, members), blocks (region, blocks) the regions to be cut into more blocks than one."""

    def join(rows: pa.Table) -> pa.Table:
        ids, label, home, first = (rows.column(c).to_numpy() for c in ("id", "label", "home", "first"))
        region = Region(_arrays(rows.column("members")), label, percent)
        own = [np.flatnonzero(home.astype(bool) & side) for side in (first, ~first)]
        away = [np.flatnonzero(~home.astype(bool) & side) for side in (first, ~first)]
        if first.all():
            region.join(own[0], away[0])
        else:  # two blocks: only across, though links inside do no harm
            region.join(np.append(*own), np.append(*away))
        a, b = np.array(region.links, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    placed = _cut(parts, blocks)
    # block b meets each block: as the first side of (b, j), j >= b, and the second of (i, b), i < b
    sides = placed.withColumn("with", F.explode(F.expr("sequence(0L, blocks - 1)")))
    sides = sides.select("region", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), (F.col("block") <= F.col("with")).alias("first"), "id", "label", "home", "members")
    return sides.groupBy("region", "i", "j").applyInArrow(join, "a long, b long")


def _divide(parts: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """Each member's places: (region, pivot, id, home, linked, d), by the Voronoi regions of pivots drawn by hash from the region's home members."""
    r = 1 - percent / 100
    homes = parts.where("home")
    lowest = [F.min(F.struct(F.xxhash64("id", F.lit(j)), "id"))["id"].alias(f"p{j}") for j in range(PIVOTS)]
    drawn = homes.groupBy("region").agg(*lowest)
    drawn = drawn.select("region", F.explode(F.array_distinct(F.array(*[f"p{j}" for j in range(PIVOTS)]))).alias("id"))
    pivots = homes.select("region", "id", "members").join(_narrow(drawn), ["region", "id"]).join(blocks, "region")
    pivots = pivots.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    pivots = pivots.select(F.col("region").alias("of"), F.col("block").alias("part"), F.col("id").alias("pivot"), F.col("members").alias("shingles"))
    placed = _cut(parts, blocks).select("region", "block", "id", "home", "members")

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("region", "pivot", "id", "home", "linked", "d")
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], kind) for c, kind in zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.float64()), strict=True)})
        order = np.argsort(right.column("pivot").to_numpy(), kind="stable")
        own = _arrays(right.column("shingles"))
        inter, union = distances(_arrays(left.column("members")), [own[j] for j in order])
        d = 1 - inter / union
        i, j = np.nonzero(d <= d.min(1)[:, None] + 2 * r + _EPS)
        home = left.column("home").to_numpy()[i] & (j == d.argmin(1)[i])
        linked = inter[i, j] * 100 >= union[i, j] * percent
        columns = (left.column("region").to_numpy()[i], right.column("pivot").to_numpy()[order][j], left.column("id").to_numpy()[i], home, linked, d[i, j])
        return pa.table({c: pa.array(x) for c, x in zip(names, columns, strict=True)})

    cogrouped = placed.groupBy("region", "block").cogroup(pivots.groupBy("of", "part"))
    return cogrouped.applyInArrow(place, "region long, pivot long, id long, home boolean, linked boolean, d double")


def links_in(parts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect whatever the similarity connects inside the regions of parts (region, id, members)."""
    r = 1 - percent / 100
    sets = parts.select("id", "members")
    parts = parts.select("region", "id", F.col("id").alias("label"), F.lit(True).alias("home"), "members")
    found, parent = [], None
    while True:
        weight = parts.groupBy("region").agg(F.sum(F.expr(f"cast(size(members) + {OVERHEAD} as long)")).alias("weight"))
        over = scratch.table(weight.where(f"weight > {BLOCK}").withColumn("blocks", F.expr(f"(weight + {BLOCK} - 1) div {BLOCK}")))
        # regions nearly as heavy as the one they come from are cut into blocks that meet; the others are divided
        stuck = over.limit(0) if parent is None else scratch.table(over.join(parent, "region").where(F.col("weight") > F.col("parent") * SHRINK).select(over.columns))
        large = over if parent is None else scratch.table(over.join(stuck.select("region"), "region", "left_anti"))
        if large.isEmpty():
            found.append(scratch.table(_meet(parts, stuck.select("region", "blocks"), percent)))
            break
        found.append(scratch.table(_meet(_without(parts, large), stuck.select("region", "blocks"), percent)))
        own = scratch.table(parts.join(_narrow(large.select("region")), "region", "left_semi"))
        placed = scratch.table(_divide(own, large.select("region", "blocks"), percent))
        found.append(placed.where("linked and id != pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")))
        # members linked to a pivot go on only as partners of those that are not
        reach = placed.where("not linked").groupBy("region", "pivot").agg(F.min("d").alias("reach"))
        on = placed.join(_narrow(reach), ["region", "pivot"]).where(~F.col("linked") | (F.col("d") >= F.col("reach") - r - _EPS))
        label = F.when(F.col("linked"), F.col("pivot")).otherwise(F.col("id"))
        on = scratch.table(on.select(F.xxhash64("region", "pivot").alias("region"), F.col("region").alias("from"), "id", label.alias("label"), "home"))
        of = large.select(F.col("region").alias("from"), F.col("weight").alias("parent"))
        parent = scratch.table(on.select("region", "from").distinct().join(of, "from").groupBy("region").agg(F.min("parent").alias("parent")))
        parts = scratch.table(on.drop("from").join(sets, "id").select("region", "id", "label", "home", "members"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def cluster(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles and component_id (the smallest id reachable by links) of every row; ids are whole numbers.

    The result is a table in the checkpoint folder; all others that the join writes there are deleted.
    """
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"{id_col} must hold whole numbers, not {kind.simpleString()}")
    with Scratch(docs.sparkSession) as scratch:
        read = scratch.table(_read(docs, id_col, text_col, k))
        rows = read.where("slice is null").select("id", "n", "d1", "d2")
        reps = scratch.table(rows.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("id")))
        points = scratch.table(_points(docs, id_col, text_col, k, percent, rarity(read), reps.select("id")))
        met = candidates(points, percent, scratch)
        scratch.drop(points)
        regions = components(met, scratch).withColumnRenamed("component", "region")
        parts = scratch.table(_members(docs, id_col, text_col, k, regions))
        links = links_in(parts, percent, scratch)
        label = components(links, scratch).select("id", "component")
        named = reps.join(label, "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("component_id"))
        of_sets = rows.where("n > 0").join(named, ["d1", "d2"], "left")
        component = F.when(F.col("id").isNotNull(), F.col("component_id"))
        rest = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
        out = of_sets.select("id", "n", component.alias("component_id")).unionByName(rest)
        return scratch.keep(out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), "component_id"))

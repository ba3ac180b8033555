"""Token counts that follow edits.

Each document keeps a segment tree over its pre-token units: a leaf holds a run
of units with their lengths in characters and tokens, an inner node the sums
below it.  An edit finds its leaves by descending along the character sums.
Only the units it touches, with a unit of context on either side, are cut and
encoded again; the context widens until the new cut meets the old boundaries,
from where on the old units hold.  Then the leaves change and the sums on their
paths to the root are updated.

Only byte-level tokenizers have units that tile the text, so others are refused.

Defined results: a null text is empty and counts 0; an edit beyond the text's
end is cut off at the end.  Repeated rows get repeated results, an empty table an empty one;
other columns are not read, whatever their names.  Documents are independent rows: no shuffle, and
memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import UnitEncoder, batches_of, encoder

LEAF = 64
Edit = tuple[int, int, str]  # from, to (code points of the text as it is by then), replacement


class TokenTree:
    """A document's units in a segment tree of character and token sums."""

    def __init__(self, units: list[str], sizes: list[int], encode: UnitEncoder):
        self.encode, self.encoded = encode, 0
        self._build(units, sizes)

    def _build(self, units: list[str], sizes: list[int]) -> None:
        self.units = [units[i : i + LEAF] for i in range(0, len(units), LEAF)] or [[]]
        self.sizes = [sizes[i : i + LEAF] for i in range(0, len(sizes), LEAF)] or [[]]
        self.n = 1 << (len(self.units) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.n), [0] * (2 * self.n)
        for i, (u, s) in enumerate(zip(self.units, self.sizes, strict=True)):
            self.chars[self.n + i], self.tokens[self.n + i] = sum(map(len, u)), sum(s)
        for i in range(self.n - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    def _find(self, at: int) -> tuple[int, int, int]:
        """The leaf and unit that hold the character at this place, and the place of the unit's start."""
        node, left = 1, at
        while node < self.n:
            node *= 2
            if left >= self.chars[node] and self.chars[node + 1]:
                left -= self.chars[node]
                node += 1
        leaf, k = node - self.n, 0
        units = self.units[leaf] if leaf < len(self.units) else []
        while k < len(units) - 1 and left >= len(units[k]):
            left -= len(units[k])
            k += 1
        return leaf, k, at - left

    def _set(self, leaf: int, units: list[str], sizes: list[int]) -> None:
        self.units[leaf], self.sizes[leaf] = units, sizes
        node = self.n + leaf
        self.chars[node], self.tokens[node] = sum(map(len, units)), sum(sizes)
        while node > 1:
            node >>= 1
            self._sum(node)

    def _gather(self, at: tuple[int, int], n: int, step: int) -> tuple[tuple[int, int], list[str]]:
        """Up to n units before (step -1) or from (step 1) a place; and the place reached."""
        (leaf, k), out = at, []
        while len(out) < n:
            if step < 0:
                while k == 0 and leaf > 0:
                    leaf -= 1
                    k = len(self.units[leaf])
                if k == 0:
                    break
                k -= 1
                out.append(self.units[leaf][k])
            else:
                while leaf < len(self.units) - 1 and k >= len(self.units[leaf]):
                    leaf, k = leaf + 1, 0
                if k >= len(self.units[leaf]):
                    break
                out.append(self.units[leaf][k])
                k += 1
        return (leaf, k), out[::step]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from start to end."""
        total = self.chars[1]
        start, end = min(start, total), min(max(start, end), total)
        first_leaf, first, begin = self._find(start)
        last_leaf, last, last_begin = self._find(max(start, end - 1))
        touched = [u for leaf in range(first_leaf, last_leaf + 1) for u in self.units[leaf][first if leaf == first_leaf else 0 : last + 1 if leaf == last_leaf else None]]
        old = "".join(touched)
        changed = old[: start - begin] + new + old[end - begin :]
        reach = 1
        while True:
            low, before = self._gather((first_leaf, first), reach, -1)
            high, after = self._gather((last_leaf, last + 1 if touched else last), reach, 1)
            _, ahead = self._gather(high, 2, 1)
            region = "".join(before) + changed + "".join(after)
            text = region + "".join(ahead)
            strange = self.encode.odd(text) or self.encode.odd(old)
            fresh, at = [], 0
            for unit in [] if strange else self.encode.units(text):
                if at >= len(region):
                    break
                fresh.append(unit)
                at += len(unit)
            whole = len(before) < reach and not ahead
            if not strange and at == len(region) and (len(before) < reach or fresh[:1] == before[:1]):
                break
            if whole:
                fresh = self.encode.units(region) if region else []
                break
            reach *= 4
        sizes = [len(x) // 4 for x in self.encode.unit_ids([fresh])[0]]
        self.encoded += len(fresh)
        (a, i), (b, j) = low, high
        head_u, head_s = self.units[a][:i], self.sizes[a][:i]
        tail_u, tail_s = self.units[b][j:], self.sizes[b][j:]
        for leaf in range(a + 1, b + 1):
            self._set(leaf, [], [])
        self._set(a, head_u + fresh + tail_u, head_s + sizes + tail_s)
        if len(self.units[a]) > 4 * LEAF:  # keeps leaves short
            self._build([u for x in self.units for u in x], [s for x in self.sizes for s in x])


def tree_of(texts: list[str], encode: UnitEncoder) -> Iterator[TokenTree]:
    """A tree for each text."""
    if not encode.prefix:
        raise ValueError("edit-aware counts need a byte-level tokenizer")
    cut = [encode.units(t) if t else [] for t in texts]
    for units, ids in zip(cut, encode.unit_ids(cut), strict=True):
        yield TokenTree(units, [len(x) // 4 for x in ids], encode)


def house_edits(text: str) -> list[Edit]:
    """The edits of the registered query: a title line in front, a word in the middle masked, a line feed at the end."""
    middle = text.find(" ", len(text) // 2)
    out: list[Edit] = [(len(text), len(text), "\n")]
    if middle >= 0:
        stop = text.find(" ", middle + 1)
        out.append((middle + 1, stop if stop >= 0 else len(text), "[MASK]"))
    return [*out, (0, 0, "Title: document\n")]  # from the end to the front, so that places stay


def counts(docs: DataFrame, tokenizer: str, edits: Callable[[str], list[Edit]] = house_edits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens before and n_tokens_after the edits, and n_encoded, the units that the edits encoded."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = [t or "" for t in batch.column(1).to_pylist()], []
            for first, some in batches_of(texts):
                for text, tree in zip(some, tree_of(some, encoder(tokenizer)), strict=True):
                    before = tree.count
                    for edit in edits(text):
                        tree.edit(*edit)
                    rows.append((before, tree.count, tree.encoded))
            cols = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [id_col, "n_tokens", "n_tokens_after", "n_encoded"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_tokens_after long, n_encoded long")

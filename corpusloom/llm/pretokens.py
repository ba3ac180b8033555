"""Encoding with the tokenizers library, pre-token by pre-token.

Both tokenizer kinds in use cut a text into pre-tokens that never span certain
white space, and encode each by itself.  So a text is cut at such places, each
distinct unit is encoded once and kept in a cache of bounded size, and the ids
of a text are its units' ids in a row: the same ids as for the whole text.
Where a text holds a character on which Python's and the library's ideas of
white space differ, the name of an added token (which the library cuts out first, with or
without special tokens of its own), or, for a tokenizer that lower-cases, a letter whose lower case
depends on its neighbours or is two characters, the whole text is encoded directly.

A unit of a byte-level tokenizer is a run of non-space with the one space
before it, or a run of spaces; of a tokenizer that drops white space, a run of
non-space.  Full stops and commas after a word are units of their own, which
makes distinct units fewer.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache
from pathlib import Path

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core
from tokenizers import Tokenizer  # noqa: E402

#: The cache's bounds: units, and the characters of a unit.  Once full it stays as it is: common units came early.
CACHE_UNITS, LONG_UNIT = 800_000, 100
#: Characters that Python takes for white space and Unicode doesn't.
ODD = "\x1c\x1d\x1e\x1f"
#: Letters whose lower case depends on their neighbours, or is two characters.
_ODD_CASE = "\u03a3\u0130"
#: Latin letters alone, before white space, a full stop or a comma: a pre-token always ends there.
_LETTERS = r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]++"
_WORD = rf"{_LETTERS}(?=[ \n.,]|\Z)"
_ROW = 256
_PREFIX_UNITS = re.compile(rf" ?{_WORD}|[.,]++(?=\s|\Z)| ?\S+|\s+(?!\S)|\s+")
_DROP_UNITS = re.compile(rf"{_WORD}|[.,]++(?=\s|\Z)|\S+")


class UnitEncoder:
    """ids of texts as bytes: little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        stated = json.loads(Path(path).read_text(encoding="utf-8"))
        self.prefix = stated["pre_tokenizer"]["type"] == "ByteLevel"
        names = "|".join(re.escape(x["content"]) for x in stated["added_tokens"]) or "(?!)"
        odd = ODD + ("" if self.prefix else _ODD_CASE)  # units in lower case may spell a name that the text has in capitals
        self.strange = re.compile(f"[{odd}]|{names}" if self.prefix else f"[{odd}]|(?i:{names})").search
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.marks = np.zeros(1 + max(vocabulary.values()), bool)
        for token, i in vocabulary.items():
            self.marks[i] = token.startswith("\u0120") if self.prefix else token.endswith("</w>")
        self.plain = re.compile((" " if self.prefix else "") + _LETTERS).fullmatch

    def odd(self, text: str) -> bool:
        """True if the text can't be cut safely."""
        return self.strange(text) is not None

    def units(self, text: str) -> list[str]:
        """The units of a text; a text that can't be cut safely is one unit."""
        if self.odd(text):
            return [text]
        if self.prefix:
            return _PREFIX_UNITS.findall(text)
        if unicodedata.is_normalized("NFC", text):
            text = text.lower()  # as the tokenizer does next, and distinct units are fewer
        return _DROP_UNITS.findall(text)

    def _encoded(self, units: list[str]) -> dict[str, bytes]:
        """The ids of each unit.  Plain words go in rows of many, which their tokens' space or end mark cuts again."""
        plain = [u for u in units if self.plain(u)]
        rest = [u for u in units if not self.plain(u)]
        out = {}
        rows = [plain[i : i + _ROW] for i in range(0, len(plain), _ROW)]
        found = self.tokenizer.encode_batch_fast([("" if self.prefix else " ").join(r) for r in rows], add_special_tokens=False)
        for row, x in zip(rows, found, strict=True):
            ids = np.array(x.ids, "<u4")
            cut = np.flatnonzero(self.marks[ids])
            if len(cut) != len(row):
                rest += row
                continue
            edges = [*(4 * cut).tolist(), 4 * len(ids)] if self.prefix else [0, *(4 * cut + 4).tolist()]
            data = ids.tobytes()
            out.update((unit, data[a:b]) for unit, a, b in zip(row, edges[:-1], edges[1:], strict=True))
        found = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        out.update((unit, np.array(x.ids, "<u4").tobytes()) for unit, x in zip(rest, found, strict=True))
        return out

    def unit_ids(self, cut: list[list[str]]) -> list[list[bytes]]:
        """The ids of each unit of each text."""
        known = self.known
        new = self._encoded(list(set().union(*cut).difference(known)))
        known.update(new)
        out = [list(map(known.__getitem__, units)) for units in cut]
        full = len(known) > CACHE_UNITS
        for unit in new:
            if full or len(unit) > LONG_UNIT:
                del known[unit]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        return [b"".join(x) for x in self.unit_ids([self.units(t) for t in texts])]


@lru_cache(maxsize=4)
def encoder(path: str) -> UnitEncoder:
    """One encoder for each file and worker process, so that its cache lasts over tasks."""
    return UnitEncoder(path)


def batches_of(texts: list[str], size: int = 1 << 20):
    """(first, texts) in groups of about size characters, longer texts by themselves."""
    first, n = 0, 0
    for i, t in enumerate(texts):
        if i > first and n + len(t) > size:
            yield first, texts[first:i]
            first, n = i, 0
        n += len(t)
    if first < len(texts):
        yield first, texts[first:]

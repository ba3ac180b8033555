"""Word hashing over batches of texts, vectorised over their bytes.

A word is a maximal run of word bytes; both word definitions in use are unions
of ASCII characters and "every byte above 0x7F", so UTF-8 bytes can be judged
one by one.  A word's hash is a polynomial in an odd base over random 64-bit
values of its bytes, mixed at the end: a pure function of the word.  Texts are
taken in groups of about ``GROUP`` bytes, longer texts in pieces cut between
words, so memory follows the number of words and not 8 bytes for every byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

GROUP = 1 << 18
_RNG = np.random.default_rng(20240611)
_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _bytes_table(chars: bytes) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(chars)] = False
    return out


#: Word bytes: anything but U+0020 and U+0009 to U+000D; digits, letters and everything beyond ASCII.
SPACED = _bytes_table(bytes([0x20, *range(0x09, 0x0E)]))
ALNUM = _bytes_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, GROUP * 2), base & (1 << 64) - 1, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def _piece(data: bytes, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(word_bytes[raw].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[raw] * _power(_BASE, len(raw)), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * _power(_INVERSE, len(raw) + 1)[start] + (end - start).astype(np.uint64))
    return hashes, start, end


@dataclass
class Words:
    """Words of consecutive texts: text t has words at[t] to at[t + 1]; word w is data[start[w]:end[w]]."""

    first: int
    at: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: bytes

    def word(self, w: int) -> str:
        """A word, with A-Z in lower case."""
        return self.data[self.start[w] : self.end[w]].lower().decode("utf-8", "replace")


def _long(data: bytes, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts, at = [], 0
    raw = np.frombuffer(data, np.uint8)
    while at < len(data):
        end = min(len(data), at + GROUP)
        while end < len(data):  # to the next byte that ends a word
            gap = np.flatnonzero(~word_bytes[raw[end : end + GROUP]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + GROUP)
        h, s, e = _piece(data[at:end], word_bytes)
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def of_texts(texts: pa.Array, word_bytes: np.ndarray) -> Iterator[Words]:
    """The words of every text, nulls as empty texts, in groups of consecutive texts."""
    rows = [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]
    first = 0
    while first < len(rows):
        last, size = first + 1, len(rows[first])
        while last < len(rows) and size + len(rows[last]) < GROUP:
            size += len(rows[last])
            last += 1
        own = rows[first:last]
        data = b"\n".join(own) if len(own) > 1 else own[0]
        if len(data) > 2 * GROUP:
            hashes, start, end = _long(data, word_bytes)
        else:
            hashes, start, end = _piece(data, word_bytes)
        bounds = np.cumsum([0, *(len(x) + 1 for x in own)])
        yield Words(first, np.searchsorted(start, bounds), hashes, start, end, data)
        first = last


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, regardless of where texts end."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    return mix(out + np.uint64(k))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

"""Secret scan: fixed patterns plus sliding-window Shannon entropy, in built-in expressions.

Patterns give spans by kind (``assign``, ``access``, ``hex``).  The method adds
spans of kind ``entropy``: candidate strings (runs of at least ``MIN_LENGTH``
token characters) are put into a character class, and the Shannon entropy of
every window of ``WINDOW`` characters is followed from window to window: the counts
of all characters are kept, packed into seven numbers, and only those of the character
that leaves and the one that enters change, with their terms n log2 n, in exact integer arithmetic.
A candidate whose highest window reaches its class's threshold is a span,
unless the allow list suppresses it or a pattern's span overlaps it.

Positions come from splitting the text at a pattern and adding up the lengths
of pieces and matches, so no user function is needed; a text without a match
costs one search.  Every row is handled by itself: no shuffle.  Work grows in proportion to
the text and to its longest candidate; lists of spans go in blocks of CHUNK.

Defined results: a null or empty text has no spans.  Offsets are code points,
ends exclusive.  Repeated rows get repeated results, an empty table an empty one.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import indices, let

#: The patterns that a secret must match, and the least length of the whole match or of group 2.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
MIN_ASSIGN, MIN_ACCESS = 6, 20

#: Spans that are listed or compared at once.
CHUNK = 256

#: The method's parameters: window and candidate length in characters, thresholds in bits by character class.
WINDOW, MIN_LENGTH = 20, 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
CLASSES = (("^[0-9A-Fa-f-]+$", 3.0), ("^[A-Z0-9]+$", 3.4), ("^[A-Za-z0-9+/_=-]+$", 3.7))
#: The allow list: strings that look random and are not secret.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs name things
    r"^[^0-9]*$",  # without a digit: words, paths, identifiers
    r"^[^A-Za-z]*$",  # without a letter: numbers, dates, rules
    r"^[A-Za-z]+([_/+-]+[A-Za-z]+)*[_/+-]*[0-9]{1,4}$",  # a name with a number
    r"(?i)^(?=.{1,80}$).*(example|changeme|placeholder|xxxx|abcdefgh|01234567)",  # a long string holds one of these by chance
)


def _empty() -> Column:
    return F.array().cast("array<struct<s:int,k:int,e:int>>")


def _chunks(items: Column) -> Column:
    """An array in blocks of CHUNK items."""
    return F.transform(indices(F.ceil(F.size(items) / F.lit(CHUNK)).cast("int")), lambda c: F.slice(items, c * CHUNK + 1, F.lit(CHUNK)))


def _spans(text: Column, pattern: str, kind: int, group: int = 0, at_least: int = 0) -> Column:
    """Spans of the pattern's matches, leftmost and not overlapping, whose group has at_least characters."""

    def of(b: Column) -> Column:
        # characters before a match, of the match, and of its group
        matches = F.transform(indices(F.size(b["f"])), lambda i: F.struct(F.length(F.get(b["p"], i)).alias("gap"), F.length(F.get(b["f"], i)).alias("n"), F.length(F.get(b["g"], i)).alias("own")))
        return let(_chunks(matches), placed)

    def placed(blocks: Column) -> Column:
        total = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda n, m: n + m["gap"] + m["n"]))
        ends = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(total, ends, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

        def step(acc: Column, m: Column) -> Column:
            start = acc["end"] + m["gap"]
            end = start + m["n"]
            one = F.struct(start.alias("s"), F.lit(kind).alias("k"), end.alias("e"))
            return F.struct(end.alias("end"), F.when(m["own"] >= at_least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

        inside = lambda x, at: F.aggregate(x, F.struct(at.alias("end"), _empty().alias("out")), step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, starts, inside))

    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else every
    return let(F.struct(F.split(text, pattern, -1).alias("p"), every.alias("f"), sized.alias("g")), of)


def _found(text: Column, hint: Column, pattern: str, kind: int, group: int = 0, at_least: int = 0) -> Column:
    return F.when(hint & text.rlike(pattern), _spans(text, pattern, kind, group, at_least)).otherwise(_empty())


#: Terms n log2 n are held as whole multiples of 1 / UNIT, so that no window's sum depends on the ones before it.
UNIT = 1 << 32
#: Counts in fields of 5 bits, 12 to a number: characters from + to z.
_FIRST, _FIELDS, _WORDS = ord("+"), 12, 7


def entropy_terms(window: int) -> list[int]:
    """n log2 n in units, for n from 0 to window."""
    return [round(n * math.log2(n) * UNIT) if n > 1 else 0 for n in range(window + 1)]


def window_entropy(s: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of a window of a string of candidate characters; 0 if it is shorter than a window."""
    if not 0 < window < 32:
        raise ValueError("a window has 1 to 31 characters")
    names = [f"w{j}" for j in range(_WORDS)]

    def body(codes: Column) -> Column:
        terms = F.array(*[F.lit(x).cast("long") for x in entropy_terms(window)])

        def count(w: Column, c: Column) -> Column:
            return F.call_function("shiftright", F.get(F.array(*[w[n] for n in names]), F.floor(c / _FIELDS).cast("int")), 5 * (c % _FIELDS)).bitwiseAND(31).cast("int")

        def moved(w: Column, c: Column, by: int) -> list[Column]:
            unit = F.call_function("shiftleft", F.lit(by).cast("long"), 5 * (c % _FIELDS))
            return [(w[n] + F.when(F.floor(c / _FIELDS) == j, unit).otherwise(F.lit(0).cast("long"))).alias(n) for j, n in enumerate(names)]

        def leave(acc: Column, c: Column) -> Column:
            n = count(acc, c)
            total = acc["sum"] - F.get(terms, n) + F.get(terms, n - 1)
            return F.when(c.isNull(), F.struct(*[acc[x].alias(x) for x in names], acc["sum"].alias("sum"), acc["best"].alias("best"))).otherwise(
                F.struct(*moved(acc, c, -1), total.alias("sum"), acc["best"].alias("best"))
            )

        def enter(acc: Column, c: Column, full: Column) -> Column:
            n = count(acc, c)
            return let(acc["sum"] + F.get(terms, n + 1) - F.get(terms, n), lambda t: F.struct(*moved(acc, c, 1), t.alias("sum"), F.when(full, F.least(acc["best"], t)).otherwise(acc["best"]).alias("best")))

        def step(acc: Column, i: Column) -> Column:
            return let(leave(acc, F.get(codes, i - window)), lambda left: enter(left, F.get(codes, i), i >= window - 1))

        most = F.lit(entropy_terms(window)[-1]).cast("long")  # of a window of one character: no entropy
        zero = F.struct(*[F.lit(0).cast("long").alias(x) for x in names], F.lit(0).cast("long").alias("sum"), most.alias("best"))
        return F.aggregate(indices(F.size(codes)), zero, step, lambda acc: F.lit(math.log2(window)) - acc["best"] / (window * UNIT))

    return let(F.transform(F.split(s, ""), lambda c: F.ascii(c) - _FIRST), body)


def suspicious(s: Column) -> Column:
    """True if a candidate's entropy reaches its class's threshold and the allow list doesn't suppress it."""
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | s.rlike(pattern)
    threshold = F.lit(99.0)
    for pattern, bits in reversed(CLASSES):
        threshold = F.when(s.rlike(pattern), F.lit(bits)).otherwise(threshold)
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(s) >= threshold)


def scan(text: Column) -> Column:
    """All spans of a text, an array of (s, k, e) ordered by start, then kind; k indexes KINDS."""

    def of(t: Column) -> Column:
        base = F.array_sort(
            F.concat(
                _found(t, t.contains("=") | t.contains(":"), ASSIGN, 0, 2, MIN_ASSIGN),
                _found(t, t.contains("AKIA"), ACCESS, 1, 0, MIN_ACCESS),
                _found(t, F.lit(True), HEX, 2),
            )
        )
        tokens = _found(t, F.lit(True), CANDIDATE, 3)

        def added(b: Column) -> Column:
            meet = lambda x, y: (y["s"] < x["e"]) & (x["s"] < y["e"])
            bounds = lambda c: F.struct(F.array_min(F.transform(c, lambda y: y["s"])).alias("s"), F.array_max(F.transform(c, lambda y: y["e"])).alias("e"), c.alias("spans"))
            fresh = let(
                F.transform(_chunks(b), bounds),
                lambda blocks: F.filter(tokens, lambda x: ~F.exists(blocks, lambda c: meet(x, c) & F.exists(c["spans"], lambda y: meet(x, y)))),
            )
            fresh = F.filter(fresh, lambda x: suspicious(F.substring(t, x["s"] + 1, x["e"] - x["s"])))
            return F.array_sort(F.concat(b, fresh))

        return let(base, added)

    return let(F.coalesce(text, F.lit("")), of)


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by mark."""

    def cut(v: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            gap = F.concat(F.substring(v["t"], acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))
            return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.array(gap))).otherwise(acc["out"]).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(v["t"], acc["at"] + 1, F.length(v["t"])))
        return F.when(F.size(v["x"]) == 0, v["t"]).otherwise(F.aggregate(v["x"], zero, step, end))

    return let(F.struct(text.alias("t"), spans.alias("x")), cut)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and spans, a row for each row of docs."""
    return docs.select(F.col(id_col), scan(F.col(text_col)).alias("spans"))

"""Quality rules: a table of thresholds compiled into one Spark projection.

The rules are rows of ``RULES``: a measure, a comparison, a bound in hundredths
of a base, and the least number of words from which the rule is meaningful.
``compile_rules`` turns them into one boolean expression; ``measures`` gives
every count they use.  All of it is built-in expressions, evaluated row by row:
no shuffle, no user function, no state that grows with the corpus.

Defined results: a null or empty text has no words, counts of 0, and is
rejected by the base (fewer than ``MIN_WORDS`` words).  Repeated rows are judged
alike; other columns of the input pass through ``apply_rules`` untouched and
are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import WORD_CHAR, indices, let, words

#: Characters counted as symbols.
SYMBOLS = "[#*$%&|<>]"
#: Marks that prose uses once or twice a sentence, and shouting after every word.
SHOUTS = "[!?]"
#: Common function words, in lower case, of English, French, German and Spanish.
STOP_WORDS = (
    "a and are as at be by for from have in is it not of on or that the this to was were with you "
    "au avec ce dans de des du elle en est et il je la le les mais ne ou par pas pour qui sur un une "
    "als auf aus das dem den der die ein eine für ich ist mit nicht sich sie und von zu "
    "al como con del el es las lo los más no para pero por que se su una y"
).split()
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20


@dataclass(frozen=True)
class Rule:
    """A text is rejected if 100 * measure is beyond bound * base and it has min_words words at least."""

    name: str
    measure: str
    beyond: str  # ">" or "<"
    bound: int  # in hundredths
    base: str
    min_words: int = 0


#: Length, symbol, stop-word and line ratios.
RULES = (
    Rule("words_too_long", "word_chars", ">", 2500, "n_words"),
    Rule("words_too_short", "word_chars", "<", 150, "n_words"),
    Rule("too_many_symbols", "n_symbols", ">", 20, "n_words"),
    Rule("too_many_shouts", "n_shouts", ">", 50, "n_words"),
    Rule("too_few_stop_words", "n_stop_words", "<", 2, "n_words", 60),
    Rule("too_many_duplicate_lines", "n_dup_lines", ">", 50, "n_lines"),
)


def _covered(starts: Column) -> Column:
    """Words covered by windows at these ascending starts."""
    step = lambda acc, p: F.struct(
        (acc["n"] + F.least(F.lit(WINDOW), p + WINDOW - acc["end"])).alias("n"), (p + WINDOW).alias("end")
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end"))
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def _repeated(ws: Column) -> Column:
    """Words in windows of 5 words that the text has twice or more.

    Equal hashes bring equal windows side by side; the windows' words then decide.
    """
    hashes = F.transform(indices(F.size(ws) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)]))

    def same(a: Column, b: Column) -> Column:
        equal = a["h"] == b["h"]
        for k in range(WINDOW):
            equal = equal & (F.get(ws, a["i"] + k) == F.get(ws, b["i"] + k))
        return F.coalesce(equal, F.lit(False))

    def twice(s: Column) -> Column:
        found = F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
        return _covered(F.array_sort(F.transform(found, lambda x: x["i"])))

    def of(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0)).otherwise(let(ordered, twice))

    return let(hashes, of)


def compile_rules(rules: tuple[Rule, ...], m: Column) -> Column:
    """True where a row with these measures passes every rule."""
    ok = F.lit(True)
    for r in rules:
        left, right = m[r.measure].cast("long") * 100, m[r.base].cast("long") * r.bound
        fails = (left > right) if r.beyond == ">" else (left < right)
        ok = ok & ~((m["n_words"] >= r.min_words) & fails)
    return ok


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of every measure, base_failed and kept, for a text column."""

    def measured(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CHAR))
        line_counts = let(lines, lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
        word_counts = let(
            words(t),
            lambda w: F.struct(
                F.size(w).alias("all"),
                F.length(F.array_join(w, "")).alias("chars"),
                _repeated(w).alias("repeat"),
                F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))).alias("stop"),
            ),
        )
        return let(
            F.struct(word_counts.alias("w"), line_counts.alias("l")),
            lambda c: F.struct(
                c["w"]["all"].cast("long").alias("n_words"),
                c["w"]["chars"].cast("long").alias("word_chars"),
                F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                c["l"]["dup"].cast("long").alias("n_dup_lines"),
                c["w"]["repeat"].cast("long").alias("n_repeat_words"),
                F.regexp_count(t, F.lit(SHOUTS)).cast("long").alias("n_shouts"),
                c["w"]["stop"].cast("long").alias("n_stop_words"),
                c["l"]["all"].cast("long").alias("n_lines"),
            ),
        )

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouts", "n_stop_words", "n_lines")

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)
        return F.struct(*[m[n].alias(n) for n in names], failed.alias("base_failed"), (~failed & compile_rules(rules, m)).alias("kept"))

    return let(let(F.coalesce(text, F.lit("")), measured), judged)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id_col and every field of ``verdict``, a row for each row of docs."""
    return docs.select(F.col(id_col), verdict(F.col(text_col), rules).alias("v")).select(id_col, "v.*")


def apply_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    return docs.where(verdict(F.col(text_col), rules)["kept"])

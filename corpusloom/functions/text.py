"""Text expressions: normalisation, fingerprints, code extraction, gates and renderers.

All are built-in Spark expressions.  Java and Python disagree on white space, so
the class of Unicode white space is spelled out once, in WS.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip and str.split know it.
WS = r"[\x09-\x0D\x1C-\x20\x85\xA0  -     　]"
#: Tokens of a normalised problem; letters that match a-z when case is ignored include two beyond ASCII.
TOKEN = r"(?iu)[a-z0-9]+"
#: The response format's marks, fence labels for C++, and what C++ looks like.
THINK = r"(?is)<think(?:\s[^>]*)?>(.*?)</think\s*>"
ANSWER = r"(?i)</?answer(?:\s[^>]*)?>"
FENCE = r"(?s)```[ \t]*([^\n`]*)\n(.*?)```"
OPEN_FENCE = r"(?is)^.*?```[ \t]*[^\n`]*\n"
CPP_LABELS = ("cpp", "c++", "cc", "cxx")
CPP_MARKS = ("#include", "using namespace std", "std::")
CPP_MAIN = r"\b(?:int|signed|auto)\s+main\s*\("
#: Statements that cannot be judged.
UNSUPPORTED = (
    ("interactive_problem", r"(?i)\b(?:interactive\s+(?:problem|task)|problem\s+is\s+interactive)\b"),
    ("missing_problem_statement", r"(?i)(?:problem statement.{0,60}(?:eaten|missing|lost|stolen)|without (?:the )?(?:problem )?statement)"),
)
#: Names of difficulties.
DIFFICULTY_WORDS = {"easy": ("easy", "basic", "beginner"), "medium": ("medium", "medium_hard", "interview"), "hard": ("hard", "very_hard", "extreme", "advanced")}
#: Fixed value: the prompt of the output protocol, around the problem.
PROMPT = (
    """You are solving a competitive programming problem.
Reason step by step, then provide one complete GNU C++17 program.

Your response must use exactly this structure:
<think>
Your reasoning, proof of correctness, and complexity analysis.
</think>

```cpp
Your complete C++17 program.
```

Problem:
""",
    "\n",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}++|(?<!{WS}){WS}++$", "")  # linear, however long the runs


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, WS, "")


def normalized(c: Column) -> Column:
    """Lower-case tokens joined by spaces; null counts as empty."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0)), " ")


def problem_sha256(c: Column) -> Column:
    return F.sha2(normalized(c).cast("binary"), 256)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def looks_like_cpp(c: Column) -> Column:
    out = c.rlike(CPP_MAIN)
    for mark in CPP_MARKS:
        out = out | c.contains(mark)
    return out


def _longest(texts: Column) -> Column:
    """The first of the longest strings of an array; null if it is empty."""
    return F.aggregate(texts, F.lit(None).cast("string"), lambda best, x: F.when(best.isNull() | (F.length(x) > F.length(best)), x).otherwise(best))


def extract_code(response: Column) -> Column:
    """The likeliest C++ program of a response, or null.

    Any fence that holds something settles the matter: the longest labelled as C++, else the
    longest unlabelled one that looks like it.  Without one, an unclosed fence's rest, then the whole text, if they look like it.
    """

    def fenced(t: Column) -> Column:
        labels = F.regexp_extract_all(t, F.lit(FENCE), F.lit(1))
        codes = F.regexp_extract_all(t, F.lit(FENCE), F.lit(2))
        first = lambda label: F.get(F.split(strip(F.lower(label)), f"{WS}+"), F.lit(0))
        pairs = F.zip_with(labels, codes, lambda a, b: F.struct(first(a).alias("label"), strip(b).alias("code")))
        return F.filter(pairs, lambda x: x["code"] != "")

    def choose(v: Column) -> Column:
        code = lambda xs: F.transform(xs, lambda x: x["code"])
        cpp = _longest(code(F.filter(v["f"], lambda x: x["label"].isin(*CPP_LABELS))))
        plain = _longest(code(F.filter(v["f"], lambda x: (x["label"] == "") & looks_like_cpp(x["code"]))))
        rest = strip(F.regexp_replace(v["t"], OPEN_FENCE, ""))
        opened = v["t"].rlike(r"```[ \t]*[^\n`]*\n") & looks_like_cpp(rest)
        whole = strip(v["t"])
        loose = F.when(opened, rest).when(looks_like_cpp(whole), whole)
        return F.when(F.size(v["f"]) > 0, F.coalesce(cpp, plain)).otherwise(loose)

    cleaned = F.regexp_replace(F.regexp_replace(response, THINK, ""), ANSWER, "")
    found = let(let(cleaned, lambda t: F.struct(t.alias("t"), fenced(t).alias("f"))), choose)
    return F.when(strip(response) != "", found)


def split_generation(response: Column) -> Column:
    """A struct of reasoning (the longest thought) and code; null unless both are there."""
    thoughts = F.transform(F.regexp_extract_all(response, F.lit(THINK), F.lit(1)), strip)
    both = F.struct(_longest(thoughts).alias("reasoning"), extract_code(response).alias("code"))
    return let(both, lambda b: F.when((F.coalesce(b["reasoning"], F.lit("")) != "") & b["code"].isNotNull(), b))


def render_response(reasoning: Column, code: Column) -> Column:
    return F.concat(F.lit("<think>\n"), strip(reasoning), F.lit("\n</think>\n\n```cpp\n"), strip(code), F.lit("\n```"))


def render_prompt(problem: Column) -> Column:
    return F.concat(F.lit(PROMPT[0]), strip(problem), F.lit(PROMPT[1]))


def difficulty(value: Column) -> Column:
    """easy, medium, hard or unknown, of a word or a rating; null is unknown."""
    text = F.regexp_replace(F.lower(strip(value.cast("string"))), "-", "_")

    def of(t: Column) -> Column:
        rating = F.when(t.rlike("^[0-9]+$"), t.try_cast("decimal(38,0)"))
        level = (
            F.when(rating <= 2, "easy").when(rating == 3, "medium").when(rating <= 5, "hard")
            .when(rating <= 1200, "easy").when(rating <= 1900, "medium").when(t.rlike("^[0-9]+$"), "hard")
        )
        for name, words in DIFFICULTY_WORDS.items():
            level = level.when(t.isin(*words), name)
        return level.otherwise("unknown")

    return F.coalesce(let(text, of), F.lit("unknown"))


def unsupported_reason(problem: Column) -> Column:
    out = F.lit(None).cast("string")
    for reason, pattern in reversed(UNSUPPORTED):
        out = F.when(problem.rlike(pattern), F.lit(reason)).otherwise(out)
    return out


def quality_reason(
    require_judgement: str = "right",
    minimum_pass_rate: float = 1.0,
    allow_unverified: bool = False,
    minimum_reasoning: int = 0,
    maximum_response: int = 1 << 30,
    judgement: str = "judgement",
    pass_rate: str = "pass_rate",
    generation: str = "r1_generation",
    solution: str = "solution",
) -> Column:
    """The first gate that a candidate fails, or null.  NaN pass rates count as unparsable."""
    rate = F.col(pass_rate).cast("string").try_cast("double")
    parsed = split_generation(F.col(generation))

    def of(v: Column) -> Column:
        given = strip(F.coalesce(F.col(solution), F.lit("")))
        return (
            F.when(F.lower(F.coalesce(F.col(judgement), F.lit(""))) != require_judgement.lower(), "judgement")
            .when(v["rate"].isNull() | F.isnan(v["rate"]), "pass_rate")
            .when((v["rate"] < 0) & F.lit(not allow_unverified), "unverified")
            .when((v["rate"] >= 0) & (v["rate"] < minimum_pass_rate), "pass_rate")
            .when(v["p"].isNull(), "generation")
            .when((given != "") & (without_space(given) != without_space(v["p"]["code"])), "solution_mismatch")
            .when(F.length(v["p"]["reasoning"]) < minimum_reasoning, "reasoning_too_short")
            .when(F.length(F.col(generation)) > maximum_response, "response_too_long")
        )

    return let(F.struct(rate.alias("rate"), parsed.alias("p")), of)


def question_text(dataset: Column, question: Column, description: Column, parts: Column) -> Column:
    """A question's text by upstream dataset; parts are (title, text) pairs that follow a codeforces description, empty ones skipped."""
    told = F.flatten(F.transform(F.filter(parts, lambda p: F.coalesce(p["text"], F.lit("")) != ""), lambda p: F.array(p["title"], p["text"])))
    joined = F.array_join(F.concat(F.array(description), told), "\n\n")
    return F.when(dataset.isin("taco", "apps"), question).when(dataset == "code_contests", description).when((dataset == "open-r1/codeforces") & (description != ""), joined)


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """The unbiased estimate 1 - C(n - c, k) / C(n, k) of the chance that k of n samples hold one of c passes."""
    if k == 1:
        return F.lit(1.0) - (n - c) / n
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * (n - c - i) / (n - i))
    return F.when(n - c < k, F.lit(1.0)).otherwise(F.lit(1.0) - miss)

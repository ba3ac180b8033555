"""Registered queries over the test tables, with their SQL for DuckDB.

documents are training rows, and those with doc_id % 5 = 0 the evaluation side;
labels.quality is the judgement; events are generation records (user: problem,
row number: sample, event type: outcome); conversations are prompts and
responses.  Every query reads its whole tables, except that pass_at_k
counts the first 8 events of users with 8 or more (pass_at_k_all counts all).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.simhash import simhash, simhash_md5
from ..operators import adapt, curate, judge, leakage, metrics, runs, select, tokens

SEED = 20260821
_REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _registered(sql: str | None = None):
    def keep(f):
        _REGISTRY[f.__name__] = (f, sql)
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL pieces that several oracles share
_NORM = "array_to_string(regexp_extract_all(lower(coalesce(text, '')), '(?i)[a-z0-9]+'), ' ')"
_FINGER = f"(select doc_id, lang, source, n_chars, text, {_NORM} as norm, sha256({_NORM}) as sha from documents)"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _finger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    norm = X.normalized(F.col("text"))
    return docs.select("doc_id", "lang", "source", "n_chars", norm.alias("norm")).withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))


@_registered(f"select doc_id, sha as sha256, length(norm)::bigint as normalized_length from {_FINGER}")
def normalize_fingerprint(spark, sf_dir):
    return _finger(spark, sf_dir).select("doc_id", F.col("sha").alias("sha256"), F.length("norm").cast("long").alias("normalized_length"))


_BEST = f"""select f.doc_id, f.sha, min(f.doc_id) over (partition by sha) as first_seen, count(*) over (partition by sha) as group_size,
  row_number() over (partition by sha order by coalesce(l.quality, -1) desc, f.n_chars, f.doc_id desc) as rn
  from {_FINGER} f left join labels l on f.doc_id = l.doc_id"""


@_registered(f"select doc_id, first_seen, group_size from ({_BEST}) where rn = 1")
def dedup_best(spark, sf_dir):
    rows = _finger(spark, sf_dir).select("doc_id", "n_chars", "sha").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    order = [-F.coalesce("quality", F.lit(-1)), F.col("n_chars"), -F.col("doc_id")]
    return curate.best_by(rows, "sha", order, "doc_id").select("doc_id", "first_seen", "group_size")


@_registered(f"select count(*) as total, count(distinct sha) as groups, count(*) - count(distinct sha) as duplicates from {_FINGER}")
def dedup_report(spark, sf_dir):
    by = _finger(spark, sf_dir).groupBy("sha").agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") - 1).alias("duplicates"))


@_registered(f"select doc_id, row_number() over (order by sha256('{SEED}:' || doc_id), doc_id) as place from documents order by 2 limit 100")
def stable_topk(spark, sf_dir):
    """The first hundred of a seeded order: a sampling operator, so the limit is its result."""
    docs = curate.stable_order(_t(spark, sf_dir, "documents").select("doc_id"), SEED, "doc_id")
    top = docs.orderBy("order_key", "doc_id").limit(100)
    return top.select("doc_id", F.row_number().over(Window.orderBy("order_key", "doc_id")).cast("long").alias("place"))


_ROUND = f"select doc_id, lang, source, row_number() over (partition by lang, source order by sha256('{SEED}:' || doc_id), doc_id) as round from documents"


@_registered(f"select doc_id, lang, source, round from ({_ROUND}) order by round, lang, source limit 300")
def balanced_topk(spark, sf_dir):
    """The first rows of a round-robin over languages and sources: a sampling operator."""
    ranked = curate.balanced_rank(_t(spark, sf_dir, "documents").select("doc_id", "lang", "source"), SEED, "doc_id", ["lang", "source"])
    return ranked.orderBy("round", "lang", "source").limit(300).withColumn("round", F.col("round").cast("long"))


@_registered(f"select s.size::bigint as size, count(*) as n, sum(doc_id)::bigint as ids from (select doc_id, row_number() over (order by round, lang, source) as place from ({_ROUND})) join (values (100), (200), (400)) s(size) on place <= s.size group by 1")
def nested_prefix_counts(spark, sf_dir):
    ranked = curate.balanced_rank(_t(spark, sf_dir, "documents").select("doc_id", "lang", "source"), SEED, "doc_id", ["lang", "source"])
    placed = curate.dense_ordinal(ranked, [F.col("round"), F.col("lang"), F.col("source")], "doc_id")
    prefixes = curate.nested_prefixes(placed, [100, 200, 400])
    each = [p.agg(F.lit(n).cast("long").alias("size"), F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids")) for n, p in prefixes.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@_registered("select doc_id, ord from (select doc_id, row_number() over (order by doc_id) - 1 as ord from documents) where ord % 4 = 1")
def stride_shard(spark, sf_dir):
    placed = curate.dense_ordinal(_t(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")], "doc_id")
    return curate.stride_shard(placed, 1, 4).select("doc_id", "ord")


@_registered("""with s as (select lang, count(*) as n from documents group by 1), t as (select lang, n, sum(n) over () as total from s),
 q as (select lang, n, total, (150 * n) // total as share, (150 * n) % total as rest from t),
 r as (select *, row_number() over (order by rest desc, lang desc) as place, 150 - sum(share) over () as missing from q)
 select lang, n, (case when total <= 150 then n else share + (case when place <= missing then 1 else 0 end) end)::bigint as quota from r""")
def stratified_quota(spark, sf_dir):
    return curate.largest_remainder(_t(spark, sf_dir, "documents"), "lang", 150)


@_registered(f"""select doc_id, lang, case when place <= greatest(1, round_even(n * 0.2, 0)) then 'dev' else 'eval' end as split from
 (select doc_id, lang, row_number() over (partition by lang order by sha256('{SEED}:' || lang || ':' || doc_id), doc_id) as place, count(*) over (partition by lang)::double as n from documents)""")
def hash_stratified_split(spark, sf_dir):
    return curate.stratified_split(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", SEED)


def _percentile_sql(index: str) -> str:
    at = lambda p: f"v[1 + ({index.replace('P', str(p))})::bigint]"
    return f"select lang, {', '.join(f'{at(p)} as p{round(100 * p)}' for p in metrics.QUANTILES)}, v[n] as max from (select lang, list_sort(list(n_chars)) as v, count(*) as n from documents group by lang)"


@_registered(_percentile_sql("round_even((n - 1) * P::double, 0)"))
def percentiles_round(spark, sf_dir):
    return metrics.percentiles(_t(spark, sf_dir, "documents"), ["lang"], "n_chars")


@_registered(_percentile_sql("least(n - 1, floor(P::double * n))"))
def percentiles_floor(spark, sf_dir):
    return metrics.percentiles(_t(spark, sf_dir, "documents"), ["lang"], "n_chars", rule="floor")


@_registered(f"select count(*) as n_rows, count(distinct sha) as problems, count(*) filter (n_chars > 2048) as over_2048, count(*) filter (n_chars > 8192) as over_8192, max(n_chars) as longest from {_FINGER}")
def corpus_stats(spark, sf_dir):
    over = lambda n: F.count_if(F.col("n_chars") > n).alias(f"over_{n}")
    return _finger(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("sha").alias("problems"), over(2048), over(8192), F.max("n_chars").alias("longest"))


_HISTOGRAM = "select '{0}' as field, coalesce({1}, 'unknown') as value, count(*) as n from documents d left join labels l on d.doc_id = l.doc_id group by 1, 2"


@_registered(" union all ".join([_HISTOGRAM.format("lang", "lang"), _HISTOGRAM.format("source", "source"), _HISTOGRAM.format("quality", "quality::varchar")]))
def histograms(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in ("lang", "source", "quality")]))
    return rows.select(named.alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n")).select("field", "value", "n")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _finger(spark, sf_dir).select("doc_id", F.col("sha").alias("sha256"), F.length("norm").alias("normalized_length"))
    marks = simhash_md5(_t(spark, sf_dir, "documents"), "doc_id", "text")
    both = rows.join(marks, "doc_id")
    training = both.where("doc_id % 5 != 0").withColumnRenamed("doc_id", "training_id")
    evaluation = both.where("doc_id % 5 = 0").withColumn("eval_ord", F.col("doc_id")).withColumnRenamed("doc_id", "eval_id")
    return training, evaluation


@_registered(f"select t.doc_id as training_id, min(e.doc_id) as eval_id, 'normalized_sha256' as reason from {_FINGER} t join {_FINGER} e on t.sha = e.sha where t.doc_id % 5 <> 0 and e.doc_id % 5 = 0 group by 1")
def leak_exact(spark, sf_dir):
    """The first evaluation row with the same normalised text."""
    rows = _finger(spark, sf_dir).select("doc_id", "sha")
    side = rows.where("doc_id % 5 = 0").groupBy("sha").agg(F.min("doc_id").alias("eval_id"))
    found = rows.where("doc_id % 5 != 0").join(side, "sha")
    return found.select(F.col("doc_id").alias("training_id"), "eval_id", F.lit("normalized_sha256").alias("reason"))


flagship = leak_exact

_BITS = ", ".join(f"sum((h >> {63 - i}) & 1) as s{i}" for i in range(64))
_SIMHASH = f"""(with w as (select doc_id, norm, string_split(norm, ' ') as ws from {_FINGER}),
 f as (select doc_id, case when norm = '' then []::varchar[] when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) else ws end as fs from w),
 h as (select doc_id, ('0x' || md5(unnest(fs))[1:16])::ubigint as h from f),
 s as (select doc_id, count(*) as n, {_BITS} from h group by 1),
 m as (select doc_id, {' + '.join(f'(case when 2 * s{i} >= n then {1 << (63 - i)}::hugeint else 0::hugeint end)' for i in range(64))} as u from s)
 select w.doc_id, coalesce((case when u >= 9223372036854775808::hugeint then u - 18446744073709551616::hugeint else u end)::bigint, -1) as simhash, w.norm, sha256(w.norm) as sha from w left join m on w.doc_id = m.doc_id)"""


@_registered(f"select doc_id, simhash from {_SIMHASH}")
def simhash_fingerprints(spark, sf_dir):
    return simhash_md5(_t(spark, sf_dir, "documents"), "doc_id", "text")


@_registered(f"""with s as {_SIMHASH}, p as (select t.doc_id as training_id, e.doc_id as eval_id, t.sha = e.sha as exact from s t, s e
 where t.doc_id % 5 <> 0 and e.doc_id % 5 = 0 and (t.sha = e.sha or (length(t.norm) >= 100 and length(e.norm) >= 100 and bit_count(xor(t.simhash, e.simhash)) <= 6))),
 r as (select *, row_number() over (partition by training_id order by eval_id) as rn from p)
 select training_id, eval_id, case when exact then 'normalized_sha256' else 'near_duplicate_simhash' end as reason from r where rn = 1""")
def leak_near(spark, sf_dir):
    return leakage.find_leaks(*_sides(spark, sf_dir), use_ids=False)


@_registered()
def simhash_blake2b(spark, sf_dir):
    return _t(spark, sf_dir, "documents").repartition("doc_id").select("doc_id", simhash(F.col("text")).alias("simhash"))


_RECORDS = """(select user_id::varchar as problem_id, case user_id % 3 when 0 then 'easy' when 1 then 'medium' else 'hard' end as difficulty,
 event_type <> 'error' and value is not null as extraction_success, value > 20 as compiled, case when value > 60 then 3 when value > 40 then 1 else 0 end as passed, 3 as total_tests, length(coalesce(props, '')) as response_length,
 row_number() over (partition by user_id order by ts, event_id) - 1 as sample_index from events)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    level = F.when(F.col("user_id") % 3 == 0, "easy").when(F.col("user_id") % 3 == 1, "medium").otherwise("hard")
    return e.select(
        F.col("user_id").cast("string").alias("problem_id"),
        level.alias("difficulty"),
        ((F.col("event_type") != "error") & F.col("value").isNotNull()).alias("extraction_success"),
        (F.col("value") > 20).alias("compiled"),
        F.when(F.col("value") > 60, 3).when(F.col("value") > 40, 1).otherwise(0).alias("passed"),
        F.lit(3).alias("total_tests"),
        F.length(F.coalesce("props", F.lit(""))).alias("response_length"),
        (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("sample_index"),
    )


def _metrics_sql(group: str) -> str:
    return f"""with p as (select problem_id, difficulty, count(*)::double as n, count(*) filter (passed = total_tests and compiled)::double as c, count(*) filter (extraction_success) as x,
 count(*) filter (compiled) as k, sum(passed) as passed, sum(total_tests) as tests, sum(response_length) as len from {_RECORDS} group by 1, 2)
 select {group} as difficulty, count(*) as problems, sum(n)::bigint as generations, round(sum(x) / sum(n), 9) as extraction_rate, round(sum(k) / sum(n), 9) as compile_rate,
 round(sum(passed) / sum(tests)::double, 9) as test_pass_rate, round(sum(len) / sum(n), 6) as mean_length, round(avg(1.0::double - (n - c) / n), 9) as pass_at_1,
 round(avg(case when n - c < 3 then 1.0::double else 1.0::double - ((n - c) / n) * ((n - c - 1) / (n - 1)) * ((n - c - 2) / (n - 2)) end), 9) as pass_at_k from p group by 1"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("difficulty", "problems", "generations", *[F.round(c, 6 if c == "mean_length" else 9).alias(c) for c in ("extraction_rate", "compile_rate", "test_pass_rate", "mean_length", "pass_at_1", "pass_at_k")])


@_registered(_metrics_sql("'all'"))
def metrics_overall(spark, sf_dir):
    return _rounded(metrics.metrics(_records(spark, sf_dir), 3).where("overall").withColumn("difficulty", F.lit("all")))


@_registered(_metrics_sql("difficulty"))
def metrics_by_group(spark, sf_dir):
    return _rounded(metrics.metrics(_records(spark, sf_dir), 3).where("not overall"))


@_registered("""with r as (select user_id, value > 60 as ok, row_number() over (partition by user_id order by ts, event_id) as rn, count(*) over (partition by user_id) as m from events),
 p as (select user_id, count(*)::double as n, count(*) filter (ok)::double as c from r where m >= 8 and rn <= 8 group by 1)
 select user_id, c::bigint as c, 1.0::double - (n - c) / n as pass_at_1, round(case when n - c < 3 then 1.0::double else 1.0::double - ((n - c) / n) * ((n - c - 1) / (n - 1)) * ((n - c - 2) / (n - 2)) end, 9) as pass_at_3, case when c > 0 then 1.0::double else 0.0::double end as pass_at_8 from p""")
def pass_at_k(spark, sf_dir):
    w = Window.partitionBy("user_id")
    rows = _t(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w.orderBy("ts", "event_id"))).withColumn("m", F.count(F.lit(1)).over(w))
    by = rows.where("m >= 8 and rn <= 8").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 60).alias("c"))
    at = lambda k: X.pass_at_k(F.col("n"), F.col("c"), k)
    return by.select("user_id", "c", at(1).alias("pass_at_1"), F.round(at(3), 9).alias("pass_at_3"), F.round(at(8), 9).alias("pass_at_8"))


def _at_k_sql(k: int) -> str:
    missed = " * ".join(f"((n - c - {i}) / (n - {i}))" for i in range(k))
    return f"case when n < {k} then null when n - c < {k} then 1.0::double else round(1.0::double - {missed}, 9) end as pass_at_{k}"


@_registered(f"""with p as (select user_id, count(*)::double as n, (count(*) filter (value > 60))::double as c from events group by 1)
 select user_id, n::bigint as n, c::bigint as c, {", ".join(map(_at_k_sql, (1, 3, 8)))} from p""")
def pass_at_k_all(spark, sf_dir):
    """pass@1, 3 and 8 of every user from all of its events; null where there are fewer than k."""
    by = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 60).alias("c"))
    at = lambda k: F.when(F.col("n") >= k, F.round(X.pass_at_k(F.col("n"), F.col("c"), k), 9)).alias(f"pass_at_{k}")
    return by.select("user_id", "n", "c", at(1), at(3), at(8))


_FENCED = "'<think>plan ' || source || '</think>```cpp' || chr(10) || 'int main() { return ' || (n_chars % 100) || '; }' || chr(10) || '```' || case when n_chars % 2 = 0 then '```' || chr(10) || 'std::cout << 1; int main() { return 1000000; }' || chr(10) || '```' else '' end"


@_registered(f"select doc_id, trim(list_filter(regexp_extract_all(regexp_replace(r, '(?is)<think(?:\\s[^>]*)?>.*?</think\\s*>', '', 'g'), '(?s)```cpp\\n(.*?)```', 1), lambda x: true)[1], chr(10)) as code from (select doc_id, {_FENCED} as r from documents)")
def extract_code(spark, sf_dir):
    n = F.col("n_chars")
    first = F.concat(F.lit("<think>plan "), "source", F.lit("</think>```cpp\nint main() { return "), (n % 100).cast("string"), F.lit("; }\n```"))
    more = F.when(n % 2 == 0, "```\nstd::cout << 1; int main() { return 1000000; }\n```").otherwise("")
    return _t(spark, sf_dir, "documents").select("doc_id", X.extract_code(F.concat(first, more)).alias("code"))




def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(_t(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    n = F.col("n_chars")
    spaces = F.repeat(F.lit(" "), F.greatest(n - 40, F.lit(0)).cast("int"))
    thought = F.when(n % 10 == 4, "x").otherwise("thought")
    made = rows.select(
        "doc_id", "lang", "n_chars",
        F.when((F.col("quality") == 1) & (n % 4 == 0), "RIGHT ").when(F.col("quality") == 1, "RIGHT").when(F.col("quality") == 0, "wrong").alias("judgement"),
        F.when(F.col("toxic") == 1, "-1").when(n % 13 == 1, "abc").when(n % 13 == 2, "0.5").otherwise("1.0").alias("pass_rate"),
        F.when(n % 10 == 3, "no program").otherwise(F.concat(F.lit("<think>"), thought, F.lit("</think>```cpp\nint main() {"), spaces, F.lit("}\n```"))).alias("r1_generation"),
        F.when(n % 10 == 5, "int main() { return 7; }").when(n % 10 == 6, "int\tmain ( ) { }").otherwise("").alias("solution"),
    )
    return made.withColumn("reason", X.quality_reason(minimum_reasoning=5, maximum_response=8192, generation="r1_generation"))


_GATED_SQL = """(select d.doc_id, d.lang, case when coalesce(l.quality, 0) <> 1 or d.n_chars % 4 = 0 then 'judgement' when l.toxic = 1 then 'unverified' when d.n_chars % 13 in (1, 2) then 'pass_rate'
 when d.n_chars % 10 = 3 then 'generation' when d.n_chars % 10 = 5 then 'solution_mismatch' when d.n_chars % 10 = 4 then 'reasoning_too_short'
 when 39 + 7 + greatest(d.n_chars - 40, 0) > 8192 then 'response_too_long' end as reason from documents d left join labels l on d.doc_id = l.doc_id)"""


@_registered(f"select doc_id, reason from {_GATED_SQL}")
def quality_gate(spark, sf_dir):
    return _gated(spark, sf_dir).select("doc_id", "reason")


@_registered(f"select reason, count(*) as n from {_GATED_SQL} where reason is not null group by 1")
def reject_counters(spark, sf_dir):
    return adapt.reject_report(_gated(spark, sf_dir))


@_registered("""select doc_id, case when n_chars <= 2 then 'easy' when n_chars = 3 then 'medium' when n_chars <= 5 then 'hard' when n_chars <= 1200 then 'easy' when n_chars <= 1900 then 'medium' else 'hard' end as rated,
 case doc_id % 4 when 0 then 'easy' when 1 then 'medium' when 2 then 'hard' else 'unknown' end as named from documents""")
def difficulty_bucket(spark, sf_dir):
    word = F.get(F.array(F.lit(" Beginner"), F.lit("MEDIUM-hard"), F.lit("very-hard "), F.lit("x²")), (F.col("doc_id") % 4).cast("int"))
    return _t(spark, sf_dir, "documents").select("doc_id", X.difficulty(F.col("n_chars").cast("string")).alias("rated"), X.difficulty(word).alias("named"))


@_registered("select d.doc_id, coalesce(l.quality, -1) as answer, case when l.doc_id is null then 'missing_question' end as reason from documents d left join labels l on d.doc_id = l.doc_id")
def question_lookup(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels")
    questions = labels.select(F.lit("d").alias("dataset"), F.lit("s").alias("split"), F.col("doc_id").cast("string").alias("index"), F.col("quality").cast("string").alias("question"), F.col("doc_id").alias("ord"))
    asked = _t(spark, sf_dir, "documents").select("doc_id", F.lit("d").alias("dataset"), F.lit("s").alias("split"), F.col("doc_id").cast("string").alias("index"))
    found = adapt.lookup_questions(asked, questions)
    return found.select("doc_id", F.coalesce(F.col("question").cast("int"), F.lit(-1)).alias("answer"), F.when(F.col("question").isNull(), "missing_question").alias("reason"))




@_registered("""select page_id, case when regexp_matches(t, '(?i)\\b(?:interactive\\s+(?:problem|task)|problem\\s+is\\s+interactive)\\b') then 'interactive_problem'
 when regexp_matches(t, '(?i)(?:problem statement.{0,60}(?:eaten|missing|lost|stolen)|without (?:the )?(?:problem )?statement)') then 'missing_problem_statement' end as reason
 from (select page_id, case page_id % 5 when 0 then 'This Problem is interactive. ' when 1 then 'the problem statement was lost ' else '' end || coalesce(html, '') as t from pages)""")
def unsupported_filter(spark, sf_dir):
    lead = F.when(F.col("page_id") % 5 == 0, "This Problem is interactive. ").when(F.col("page_id") % 5 == 1, "the problem statement was lost ").otherwise("")
    return _t(spark, sf_dir, "pages").select("page_id", X.unsupported_reason(F.concat(lead, F.coalesce("html", F.lit("")))).alias("reason"))


_TURNS = "(select conv_id, min_by(text, turn) filter (role = 'user') as q, min_by(text, turn) filter (role = 'assistant') as a from conversations group by conv_id)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(first("user").alias("q"), first("assistant").alias("a"))


@_registered(f"select conv_id, sha256('{X.PROMPT[0]}' || trim(q, {_SPACE}) || chr(10)) as prompt, sha256('<think>' || chr(10) || trim(q, {_SPACE}) || chr(10) || '</think>' || chr(10) || chr(10) || '```cpp' || chr(10) || trim(a, {_SPACE}) || chr(10) || '```') as response from {_TURNS} where q is not null and a is not null")
def render_prompt(spark, sf_dir):
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    rows = _turns(spark, sf_dir).where("q is not null and a is not null")
    return rows.select("conv_id", digest(X.render_prompt(F.col("q"))).alias("prompt"), digest(X.render_response(F.col("q"), F.col("a"))).alias("response"))


_BUDGET = f"(select doc_id, case when norm = '' then 0 else len(string_split(norm, ' ')) end as total from {_FINGER})"


def _budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finger(spark, sf_dir).select("doc_id", tokens.word_count(F.col("norm")).alias("total"))


@_registered(f"select doc_id, total::bigint as total, rn as selected_rank from (select doc_id, total, row_number() over (order by doc_id) as rn from {_BUDGET} where total <= 600) where rn <= 500")
def token_budget_refill(spark, sf_dir):
    out = tokens.budget_refill(_budget(spark, sf_dir), 600, 500, ordinal="doc_id")
    return out.select("doc_id", F.col("total").cast("long").alias("total"), F.col("selected_rank").cast("long").alias("selected_rank"))


@_registered(f"""with k as (select doc_id, row_number() over (order by doc_id) as rn from {_BUDGET} where total <= 600), c as (select count(*) as selected, max(doc_id) as last from k where rn <= 500)
 select selected, (select count(*) from {_BUDGET} where total > 600 and (selected < 500 or doc_id < last)) as rejected_total_tokens from c""")
def token_budget_report(spark, sf_dir):
    return tokens.refill_report(_budget(spark, sf_dir), 600, 500, ordinal="doc_id")


@_registered(f"""with r as (select conv_id, length(q) as lq, length(a) as la, length(q) + length(a) + 1 as length, conv_id // 4 as batch from {_TURNS} where q is not null and a is not null),
 w as (select *, (ceil(max(length) over (partition by batch) / 8.0) * 8)::int as width from r)
 select conv_id, length::int as length, width, lq::int as masked, (width - length)::int as padded from w""")
def encode_mask_pad(spark, sf_dir):
    """Encoding by code points: masked prompt labels, padding to the batch's longest, rounded up to eight."""
    points = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.ascii(F.substring(c, i, F.lit(1))))
    ids = lambda c: F.when(F.length(c) > 0, points(c)).otherwise(F.array().cast("array<int>"))
    rows = _turns(spark, sf_dir).where("q is not null and a is not null").select("conv_id", ids(F.col("q")).alias("p"), ids(F.col("a")).alias("r"), F.expr("conv_id div 4").alias("batch"))
    out = tokens.collate(tokens.encode_masked(rows, "p", "r", eos=-1, max_length=1 << 30), "batch", pad=0)
    zeros: Column = F.size(F.filter("attention_mask", lambda m: m == 0))
    return out.select("conv_id", "length", "width", F.size("p").alias("masked"), zeros.alias("padded"))


_GOT = "(select doc_id, doc_id % 2 as sample_index from documents where doc_id % 7 <> 0 union all select doc_id, doc_id % 2 from documents where doc_id % 11 = 0 union all select doc_id + 100000000, 0 from documents where doc_id % 100 = 0)"


@_registered(f"""with e as (select doc_id, i as sample_index from documents, range(2) r(i)), g as (select doc_id, sample_index, count(*) as n from {_GOT} group by 1, 2)
 select (select sum(n - 1) from g)::bigint as duplicates, (select count(*) from e anti join g using (doc_id, sample_index)) as missing, (select count(*) from g anti join e using (doc_id, sample_index)) as extra""")
def shard_completeness(spark, sf_dir):
    ids = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("problem_id"))
    key = (F.col("problem_id") % 2).cast("int").alias("sample_index")
    got = ids.where("problem_id % 7 != 0").select("problem_id", key).unionAll(ids.where("problem_id % 11 = 0").select("problem_id", key))
    got = got.unionAll(ids.where("problem_id % 100 = 0").select((F.col("problem_id") + 100000000).alias("problem_id"), F.lit(0).alias("sample_index")))
    return runs.shard_report(got, ids, 2)


@_registered("select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def resume_pending(spark, sf_dir):
    ids = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("problem_id"))
    done = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("problem_id"))
    return runs.pending(ids, done).select(F.col("problem_id").alias("doc_id"))


@_registered(f"""select split, count(*) as n, sha256(string_agg(doc_id::varchar, ',' order by doc_id)) as ids_sha256 from
 (select doc_id, case when place <= greatest(1, round_even(n * 0.2, 0)) then 'dev' else 'eval' end as split from
 (select doc_id, row_number() over (partition by lang order by sha256('{SEED}:' || lang || ':' || doc_id), doc_id) as place, count(*) over (partition by lang)::double as n from labels join documents using (doc_id))) group by 1""")
def manifest_check(spark, sf_dir):
    """Ids of each split of the labelled set, in order: an evaluation set's manifest."""
    labelled = _t(spark, sf_dir, "documents").select("doc_id", "lang").join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    split = curate.stratified_split(labelled, "doc_id", "lang", SEED)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda i: i.cast("string")), ",")
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"))


@_registered("""select user_id, event_id, round(case when s > 0 then (value - m) / s else 0 end, 6) as advantage from
 (select user_id, event_id, value, avg(value) over (partition by user_id) as m, stddev_pop(value) over (partition by user_id) as s from events)""")
def group_advantage(spark, sf_dir):
    rows = metrics.group_advantage(_t(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "value")
    return rows.select("user_id", "event_id", F.round("advantage", 6).alias("advantage"))


@_registered("""select doc_id::varchar as problem_id, (n_chars % 4)::integer as sample_index, length(r)::integer as response_length, 2 as total_tests, starts_with(r, '<think>') as extraction_success,
 case when starts_with(r, '<think>') then 'int main() { return ' || (n_chars % 100) || '; }' end as code from (select doc_id, n_chars,
 case when n_chars % 3 = 0 then '' when n_chars % 3 = 1 then 'no program here' else '<think>plan</think>```cpp' || chr(10) || 'int main() { return ' || (n_chars % 100) || '; }' || chr(10) || '```' end as r from documents)""")
def generation_records(spark, sf_dir):
    n = F.col("n_chars")
    program = F.concat(F.lit("<think>plan</think>```cpp\nint main() { return "), (n % 100).cast("string"), F.lit("; }\n```"))
    case = F.struct(F.lit("1").alias("input"), F.lit("1").alias("output"))
    rows = _t(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("problem_id"), F.lit(None).cast("string").alias("difficulty"), (n % 4).cast("int").alias("sample_index"), F.lit("").alias("prompt"),
        F.when(n % 3 == 1, "no program here").when(n % 3 == 2, program).alias("response"), F.lit(1).alias("response_tokens"), F.lit("stop").alias("finish_reason"), F.array(case, case).alias("tests"),
    )
    return runs.generation_records(rows).select("problem_id", "sample_index", "response_length", "total_tests", "extraction_success", "code")


@_registered("select doc_id, n_chars from documents order by n_chars, doc_id limit 64")
def shortest_rows(spark, sf_dir):
    """The shortest documents first."""
    return select.load_rows(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), 64, "shortest", total="n_chars", id_col="doc_id")


_SHORT = "(select d.doc_id, d.n_chars, d.source from documents d join labels l on d.doc_id = l.doc_id where l.quality = 1 and d.n_chars <= 4096 order by d.doc_id limit 50)"


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _t(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("verified"))
    rows = _t(spark, sf_dir, "documents").join(labels, "doc_id")
    return select.select_short_rows(rows, 4096, 50, length="n_chars", id_col="doc_id", ordinal="doc_id")


@_registered(f"""with v as (select n_chars, row_number() over (order by n_chars) - 1 as i, count(*) over () as n from {_SHORT})
 select {", ".join(f"max(n_chars) filter (i = least(n - 1, floor({p}::double * n))) as p{round(100 * p)}" for p in metrics.QUANTILES)}, max(n_chars) as max, count(*) as n_rows, avg(n_chars) as mean from v""")
def short_subset_stats(spark, sf_dir):
    """Percentiles of the first 50 verified documents of at most 4,096 characters: a bounded subset is the feature."""
    return select.short_stats(_short(spark, sf_dir), "n_chars")


@_registered(f"select source as value, count(*) as n from {_SHORT} group by 1")
def short_subset_histogram(spark, sf_dir):
    return select.histogram(_short(spark, sf_dir), "source")


@_registered(f"select count(*) as n_rows, sum(n_chars)::bigint as n_tokens, sha256(string_agg(doc_id::varchar, ',' order by doc_id)) as ids_sha256 from {_SHORT}")
def selected_tokens(spark, sf_dir):
    return select.selected_tokens(_short(spark, sf_dir), "n_chars", "doc_id", "doc_id")


@_registered(f"""with p as (select lang, row_number() over (partition by lang order by sha256('{SEED}:' || lang || ':' || doc_id), doc_id) as place, count(*) over (partition by lang)::double as n from documents),
 s as (select lang, case when place <= greatest(1, round_even(n * 0.2, 0)) then 'dev' else 'eval' end as split from p)
 select split, count(*) as total, {", ".join(f"count(*) filter (lang = '{x}') as {x}" for x in ("en", "fr", "xx"))} from s group by 1""")
def split_level_counts(spark, sf_dir):
    """Counts by split and level, 0 for a level that no row has."""
    return select.split_counts(hash_stratified_split(spark, sf_dir), "lang", ["en", "fr", "xx"])


@_registered(f"select item_id, case when t in ('', '-') then 'missing_question' when length(t) < 80 then 'short_question' end as reason from (select item_id, trim(coalesce(text, ''), {_SPACE}) as t from benchmark) union all select conv_id * 1000000 + turn, case when t in ('', '-') then 'missing_question' when length(t) < 80 then 'short_question' end from (select conv_id, turn, trim(coalesce(text, ''), {_SPACE}) as t from conversations)")
def short_questions(spark, sf_dir):
    """Why a question is turned down for its length, of benchmark items and of conversations' turns."""
    items = _t(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long"), "text")
    turns = _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000000 + F.col("turn")).alias("item_id"), "text")
    return items.unionByName(turns).select("item_id", select.question_reason(F.col("text")).alias("reason"))


@_registered("select doc_id from documents intersect select doc_id from labels")
def shared_ids(spark, sf_dir):
    return select.shared_ids(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id")


@_registered(f"select reason, count(*) as n from {_GATED_SQL} where reason like 'r%' group by 1")
def rejects_by_prefix(spark, sf_dir):
    return select.with_reason_prefix(adapt.reject_report(_gated(spark, sf_dir)), "r")


@_registered(f"select concat('part', t.doc_id % 2) as training_file, t.doc_id as training_id, min(e.doc_id) as eval_id, 'eval_exact' as reason from {_FINGER} t join {_FINGER} e on t.sha = e.sha where t.doc_id % 5 <> 0 and e.doc_id % 5 = 0 and length(t.norm) < 100 group by 1, 2")
def leaks_by_file(spark, sf_dir):
    """Leaks of two training files, of texts too short for fingerprints to count, under the curation's reasons."""
    training, evaluation = _sides(spark, sf_dir)
    short = training.where(F.col("normalized_length") < leakage.MIN_LENGTH)
    files = {f"part{k}": short.where(F.col("training_id") % 2 == k) for k in (0, 1)}
    return leakage.curation_reasons(leakage.find_leaks_by_file(files, evaluation, use_ids=False))


@_registered()
def judge_outputs(spark, sf_dir):
    """Verdicts on a small set of programs: pass, wrong answer, runtime error and compile error."""
    programs = [
        ("sum", "#include <iostream>\nint main() { long a, b; std::cin >> a >> b; std::cout << a + b; }"),
        ("off", "#include <iostream>\nint main() { std::cout << 1; }"),
        ("crash", "int main() { return 3; }"),
        ("broken", "int main() { return x; }"),
    ]
    rows = spark.createDataFrame([(n, 0, c, [("1 2", "3.0"), ("2 2", "4")]) for n, c in programs], "problem_id string, sample_index int, code string, tests array<struct<input:string,output:string>>")
    return judge.judge(rows, allow_untrusted=True).select("problem_id", "compiled", "passed", "total", "error_type")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    usable = judge.usable()  # judge_outputs needs a compiler that works
    return {name: f for name, (f, _) in _REGISTRY.items() if usable or f is not judge_outputs}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTRY.items() if sql}

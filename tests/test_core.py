"""The curation and evaluation operators, on small cases worked out by hand."""

import base64
import hashlib
import json
import math
import pickle
import random
import zlib
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import simhash as S
from corpusloom.functions import text as X
from corpusloom.operators import adapt, curate, judge, leakage, metrics, runs, select, tokens
from corpusloom.plans import catalog
from corpusloom.sources import jsonl, reports
from corpusloom.streaming import dedup


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("response", "code"),
    [
        ("```cpp\nint a;\n```", "int a;"),
        ("```C++ 17\nshort\n```\n```cxx\nint longer;\n```", "int longer;"),
        ("```\nint main() {}\n```", "int main() {}"),
        ("```python\nprint()\n```\nint main() {}", None),
        ("<answer>\n```cpp\nint main() {", "int main() {"),
        ("#include <x>\n", "#include <x>"),
        ("<think>```cpp\nint no;\n```</think> words", None),
        ("   ", None),
        (None, None),
    ],
)
def test_extract_code(spark, response, code):
    assert one(spark, response, X.extract_code) == code


def test_text(spark):
    assert one(spark, " A-b\tC3! ", X.normalized) == "a b c3"
    assert one(spark, None, X.normalized) == ""
    assert one(spark, " x y\x1c", X.strip) == "x y"
    assert one(spark, " " * 50_000 + "x" + " " * 50_000 + "y", lambda c: F.length(X.strip(c))) == 50_002
    levels = {"2": "easy", "3": "medium", "5": "hard", "1200": "easy", "1900": "medium", "1901": "hard", "Very-Hard": "hard", "interview": "medium", "?": "unknown", None: "unknown"}
    for value, level in levels.items():
        assert one(spark, value, X.difficulty) == level
    parsed = spark.range(1).select(X.split_generation(X.render_response(F.lit(" why "), F.lit("int main() {}"))).alias("p")).first().p
    assert (parsed.reasoning, parsed.code) == ("why", "int main() {}")
    assert one(spark, "The problem is interactive.", X.unsupported_reason) == "interactive_problem"
    assert one(spark, "problem statement\nwas lost", X.unsupported_reason) is None


def test_quality_reason(spark):
    good = "<think>because</think>```cpp\nint main() {}\n```"
    rows = [("right", "1.0", good, "int  main(){}"), ("wrong", "1", good, ""), ("right", "x", good, ""), ("right", "nan", good, ""), ("right", "-1", good, ""), ("right", "0.5", good, ""), ("right", "1", "no", ""), ("right", "1", good, "other")]
    got = spark.createDataFrame(rows, "judgement string, pass_rate string, r1_generation string, solution string").select(X.quality_reason()).collect()
    assert [r[0] for r in got] == [None, "judgement", "pass_rate", "pass_rate", "unverified", "pass_rate", "generation", "solution_mismatch"]


def test_pass_at_k(spark):
    row = spark.createDataFrame([(4, 1)], "n int, c int").select(X.pass_at_k(F.col("n"), F.col("c"), 1), X.pass_at_k(F.col("n"), F.col("c"), 2), X.pass_at_k(F.col("n"), F.col("c"), 4)).first()
    assert row[0] == 0.25 and abs(row[1] - 0.5) < 1e-12 and row[2] == 1.0


def test_pass_at_k_of_all_events(spark, tmp_path):
    events = [(u, float(61 if i % 3 == 2 else 7)) for u in (1, 2, 3, 7, 8, 9, 20) for i in range(u)]
    spark.createDataFrame([*events, (2, None)], "user_id int, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r for r in catalog.queries()["pass_at_k_all"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 7, 8, 9, 20]
    for u, r in got.items():
        n, c = u + (u == 2), u // 3
        assert (r.n, r.c) == (n, c)
        for k, found in ((1, r.pass_at_1), (3, r.pass_at_3), (8, r.pass_at_8)):
            assert found is None if n < k else abs(found - (1 - math.comb(n - c, k) / math.comb(n, k))) < 1e-8


def test_simhash_and_near_pairs(spark):
    text = "one two three four"
    features = ["one two three", "two three four"]
    bits = [sum((int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big") >> b & 1) * 2 - 1 for f in features) for b in range(64)]
    want = sum(1 << b for b in range(64) if bits[b] >= 0)
    assert one(spark, text, S.simhash) & (2**64 - 1) == want
    assert one(spark, "", S.simhash) == -1
    rng = random.Random(3)
    left = [(i, rng.getrandbits(63)) for i in range(60)]
    right = [(i, v ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 9)))) for i, v in left]
    frame = lambda rows, c: spark.createDataFrame(rows, f"{c} long, simhash long")
    got = {(r.a, r.b) for r in leakage.near_pairs(frame(left, "a"), frame(right, "b"), "a", "b").collect()}
    assert got == {(i, j) for i, v in left for j, w in right if (v ^ w).bit_count() <= 6}


def test_find_leaks_first_in_evaluation_order(spark):
    kinds = "string, sha256 string, simhash long, normalized_length int"
    training = spark.createDataFrame([("t1", "p9", "s1", 0, 200), ("t2", "p2", "s2", 0, 200), ("t3", "p8", "s8", -1, 50)], f"training_id string, problem_id {kinds}")
    evaluation = spark.createDataFrame([("e0", 0, "p0", "s0", 3, 200), ("e1", 1, "p2", "s1", 1 << 40, 200)], f"eval_id string, eval_ord int, problem_id {kinds}")
    got = {r.training_id: (r.eval_id, r.reason) for r in leakage.find_leaks(training, evaluation).collect()}
    assert got == {"t1": ("e0", "near_duplicate_simhash"), "t2": ("e0", "near_duplicate_simhash")}
    got = {r.training_id: (r.eval_id, r.reason) for r in leakage.find_leaks(training, evaluation.where("eval_ord = 1")).collect()}
    assert got["t2"] == ("e1", "problem_id") and got["t1"] == ("e1", "normalized_sha256")


def test_best_by_is_associative(spark):
    rng = random.Random(1)
    rows = [(f"q{rng.randint(0, 5)}", rng.choice([0.5, 1.0]), "x" * rng.randint(1, 3), i) for i in range(60)] + [(None, 1.0, "x", 99), ("", 1.0, "x", 98)]
    frame = spark.createDataFrame(rows, "q string, rate double, text string, ord long")
    order = [-F.col("rate"), F.length("text"), F.col("ord")]
    pick = lambda f: {(r.q, r.ord) for r in curate.best_by(f, "q", order, "ord").collect()}
    first = curate.best_by(frame.where("ord < 30"), "q", order, "ord").select(*frame.columns)
    assert pick(frame) == pick(first.unionByName(frame.where("ord >= 30")))


def test_quota_split_and_prefixes(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 7 % 3]) for i in range(100)], "id long, level string")
    quota = curate.largest_remainder(rows, "level", 10).collect()
    assert sum(r.quota for r in quota) == 10
    split = curate.stratified_split(rows, "id", "level", 7).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split}["dev"] == sum(max(1, round(sum("abc"[i % 7 % 3] == c for i in range(100)) * 0.2)) for c in "abc")
    placed = curate.dense_ordinal(rows, [curate.stable_key(1, "id")], "id")
    assert sorted(r.ord for r in placed.collect()) == list(range(100))
    small, large = ({r.id for r in p.collect()} for p in curate.nested_prefixes(placed, [5, 20]).values())
    assert small < large and len(large) == 20
    shards = [curate.stride_shard(placed, i, 3).count() for i in range(3)]
    assert shards == [34, 33, 33]
    with pytest.raises(ValueError):
        curate.stride_shard(placed, 3, 3)
    assert curate.shuffled_ids(["a", "b", "c"], 1, "x") == curate.shuffled_ids(["a", "b", "c"], 1, "x")
    manifest = curate.split_manifest(placed.select(F.col("id").cast("string").alias("problem_id"), "level", "ord"), split="level")
    assert sum(manifest["counts"].values()) == 100


def test_percentiles(spark):
    rng = random.Random(2)
    rows = [(g, rng.randint(0, 30)) for g in "ab" for _ in range(rng.randint(1, 40))]
    frame = spark.createDataFrame(rows, "g string, v int")
    for rule, index in (("round", lambda n, p: round((n - 1) * p)), ("floor", lambda n, p: min(n - 1, int(p * n)))):
        for r in metrics.percentiles(frame, ["g"], "v", rule=rule).collect():
            values = sorted(v for g, v in rows if g == r.g)
            assert [r.p50, r.p90, r.p95, r.p99] == [values[index(len(values), p)] for p in metrics.QUANTILES]


def test_metrics(spark):
    rows = [("a", "easy", True, True, 2, 2, 5), ("a", "easy", True, False, 0, 2, 10), ("b", None, True, True, 0, 2, 15), ("b", None, False, None, None, 2, 10)]
    frame = spark.createDataFrame(rows, "problem_id string, difficulty string, extraction_success boolean, compiled boolean, passed int, total_tests int, response_length int")
    overall = metrics.metrics(frame, 2).where("overall").first()
    assert (overall.extraction_rate, overall.compile_rate, overall.test_pass_rate, overall.pass_at_1, overall.pass_at_k, overall.mean_length) == (0.75, 0.5, 0.25, 0.25, 0.5, 10)
    assert metrics.metrics(frame, 2).where("not overall").count() == 1


def test_tokens(spark):
    rows = spark.createDataFrame([(i, 700 if i in (0, 3, 9) else 10) for i in range(10)], "ord long, total int")
    assert [r.ord for r in tokens.budget_refill(rows, 600, 3).orderBy("ord").collect()] == [1, 2, 4]
    assert tuple(tokens.refill_report(rows, 600, 3).first()) == (3, 2)
    assert tuple(tokens.refill_report(rows, 600, 20).first()) == (7, 3)
    made = spark.createDataFrame([(1, [1, 2], [3]), (1, [1] * 9, [2])], "b int, p array<int>, r array<int>")
    out = tokens.collate(tokens.encode_masked(made, "p", "r", 9, 11), "b", 0).orderBy("length").collect()
    assert out[0].input_ids == [1, 2, 3, 9] + [0] * 12 and out[0].labels == [-100, -100, 3, 9] + [-100] * 12
    assert out[0].error is None and len(out[1].input_ids) == 16 and sum(out[1].attention_mask) == 11


def encoded(payload):
    return base64.b64encode(zlib.compress(payload)).decode()


def test_adapt_problems(spark):
    tests = json.dumps([{"input": "1", "output": "2", "testtype": "stdin"}])
    base = {"question_id": "1", "question_title": "t", "question_content": "p", "platform": "atcoder", "contest_id": "c", "contest_date": "d", "difficulty": "Easy", "public_test_cases": tests, "private_test_cases": encoded(pickle.dumps(tests)), "metadata": '{"platform": "other"}', "ord": 0}
    class Evil:
        def __reduce__(self):
            return (print, ("x",))

    rows = [base, base | {"ord": 1}, base | {"ord": 2, "question_id": "2", "public_test_cases": tests.replace("stdin", "functional")}, base | {"ord": 3, "question_id": "3", "private_test_cases": encoded(pickle.dumps(Evil()))}, base | {"ord": 4, "question_id": ""}, base | {"ord": 5, "question_id": "6", "private_test_cases": encoded(tests.encode())}]
    got = adapt.adapt_problems(spark.createDataFrame(rows)).orderBy("ord").collect()
    assert [r.reason for r in got] == [None, "duplicate_problem_id", "not_stdin", "private_test_cases", "missing_question_id", None]
    assert got[0].problem_id == "livecodebench:atcoder:1" and len(got[0].tests) == 2 and got[0].metadata["platform"] == "other"
    assert {r.reason: r.n for r in adapt.reject_report(spark.createDataFrame([("a",), ("a",), (None,)], "reason string")).collect()} == {"a": 2}


def test_adapt_samples(spark):
    row = {"id": "i", "question_id": "q", "r1_generation": "<think>y</think>```cpp\nint main() {}\n```", "pass_rate": "0.5", "dataset": "taco", "split": "train", "index": "7", "source": "s", "difficulty": "1600", "judgement": "right", "license": "mit"}
    rows = spark.createDataFrame([row, row | {"r1_generation": "x"}])
    asked = adapt.lookup_questions(rows, spark.createDataFrame([("taco", "train", "7", "old", 0), ("taco", "train", "7", "what?", 1)], "dataset string, split string, index string, question string, ord int"))
    got = adapt.adapt_samples(asked).collect()
    assert sorted(str(r.reason) for r in got) == ["None", "unparseable_generation"]
    assert got[0].problem == "what?" and got[0].difficulty == "medium" and got[0].metadata.dataset_index == "7"


def test_runs(spark):
    problem = ("p", "text", "cpp", [("1", "2")], 1)
    kind = "problem_id string, problem string, language string, tests array<struct<input:string,output:string>>, line long"
    assert runs.validate_problems(spark.createDataFrame([problem], kind)).count() == 1
    for bad in ([problem, ("p", "text", "cpp", [("1", "2")], 3)], [("q", "", "cpp", [("1", "2")], 1)], [("q", "t", "py", [("1", "2")], 1)], [("q", "t", "cpp", [], 1)], []):
        with pytest.raises(runs.InvalidRows):
            runs.validate_problems(spark.createDataFrame(bad, kind))
    problems = spark.createDataFrame([("a", 0, "pa"), ("b", 1, "pb")], "problem_id string, pos long, prompt string")
    reply = {"text": "t", "token_count": 1, "finish_reason": "stop"}
    made = runs.generate(problems, runs.replay({"pa": [reply, reply], "pb": [reply, reply]}))
    assert runs.completed(made, problems, 2).count() == 2 and runs.pending(problems, runs.completed(made, problems, 2)).isEmpty()
    assert [r.problem_id for r in runs.merge_shards([made.where("problem_id = 'b'"), made.where("problem_id = 'a'")], problems.drop("prompt"), 2).collect()] == ["a", "a", "b", "b"]
    with pytest.raises(runs.InvalidRows):
        runs.merge_shards([made, made], problems.drop("prompt"), 2)
    with pytest.raises(runs.InvalidRows):
        runs.completed(made.where("sample_index = 0"), problems, 2)
    runs.validate_manifest(problems.withColumnRenamed("pos", "ord"), ["a", "b"])
    with pytest.raises(runs.InvalidRows):
        runs.validate_manifest(problems.withColumnRenamed("pos", "ord"), ["b", "a"])


def test_judge(spark, tmp_path):
    assert judge.same_output("1.0 2.00\n", "1 2") and not judge.same_output("nan", "1") and not judge.same_output("1\n2", "1 2")
    assert judge.judge_program("int x", [("", "1")])["error_type"] == "compile_error"

    def case(script, given, expected):
        (tmp_path / "main").write_text(f"#!/bin/sh\n{script}\n")
        (tmp_path / "main").chmod(0o755)
        return judge.run_case(tmp_path, given, expected, 1.0, 512 << 20, 1000)

    assert case("cat", "1 2.0", "1 2") is None
    assert case("echo 5", "", "6") == "wrong_answer"
    assert case("exit 3", "", "") == "runtime_error"
    assert case("sleep 9", "", "") == "timeout"
    assert case("while :; do :; done", "", "") == "timeout"
    assert case("head -c 5000 /dev/zero", "", "") == "output_limit"
    with pytest.raises(PermissionError):
        judge.judge(spark.range(1))


def test_sources_and_stream(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.json").write_text('{"q": "x", "rate": 1.0, "ord": 0}\n\n{"q": "x", "rate": 2.0, "ord": 1}\n')
    rows = jsonl.read_jsonl(spark, str(path / "a.json"), "q string, rate double").orderBy("ord").collect()
    assert [(r.line, r.ord, r.rate) for r in rows] == [(1, 0, 1.0), (3, 1, 2.0)]
    digest = hashlib.sha256((path / "a.json").read_bytes()).hexdigest()
    assert jsonl.read_fingerprinted(spark, str(path / "a.json"), "q string", digest).count() == 2
    with pytest.raises(ValueError):
        jsonl.read_fingerprinted(spark, str(path / "a.json"), "q string", "0")
    paths = jsonl.write_prefixes(spark.range(10).withColumnRenamed("id", "ord").withColumn("v", F.col("ord")), str(tmp_path / "out"), [3, 5])
    assert [spark.read.json(p).count() for p in paths.values()] == [3, 5]
    built = [jsonl.staged(spark, str(tmp_path / "stage"), {"a": 1}, lambda: spark.range(4)).count() for _ in range(2)]
    assert built == [4, 4]
    (path / "b.json").write_text('{"q": "y", "rate": 1.0, "ord": 2}\n{"q": "x", "rate": 0.5, "ord": 3}\n')
    dedup.stream_best(spark, str(path), "q string, rate double, ord long", str(tmp_path / "t"), str(tmp_path / "c"), "q", [-F.col("rate")])
    assert {(r.q, r.ord) for r in dedup.latest(spark, str(tmp_path / "t"), 1).collect()} == {("x", 1), ("y", 2)}


def test_judge_compiles(tmp_path):
    if not judge.compile_program("int main() {}", tmp_path)[0]:
        pytest.skip("no C++ compiler here")
    sums = "#include <iostream>\nint main() { int a, b; std::cin >> a >> b; std::cout << a + b; }"
    assert judge.judge_program(sums, [("1 2", "3"), ("2 2", "5")])["passed"] == 1


def test_ordinals_of_repeated_ids(spark):
    rows = spark.createDataFrame([(7, "b"), (7, "a"), (1, "c"), (None, "d"), (1, "c")], "id int, x string")
    got = curate.dense_ordinal(rows, [F.col("x")], "id").orderBy("ord").collect()
    assert [(r.x, r.id, r.ord) for r in got] == [("a", 7, 0), ("b", 7, 1), ("c", 1, 2), ("c", 1, 3), ("d", None, 4)]
    assert curate.dense_ordinal(rows.where("id > 9"), [F.col("x")], "id").count() == 0


def test_near_pairs_of_copies(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) - (1 << 63) for _ in range(60)]
    flip = lambda x, n: (x ^ sum(1 << b for b in rng.sample(range(63), n)))
    left = [(i, flip(rng.choice(prints), rng.randint(0, 8))) for i in range(150)]
    right = [(i, rng.choice(prints)) for i in range(90)]
    got = leakage.near_pairs(spark.createDataFrame(left, "a int, simhash long"), spark.createDataFrame(right, "b int, simhash long"), "a", "b").collect()
    bits = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    assert sorted((r.a, r.b, r.distance) for r in got) == sorted((i, j, bits(x, y)) for i, x in left for j, y in right if bits(x, y) <= 6)


def test_selection(spark):
    rows = spark.createDataFrame([("b", 0, True, (3, 9)), ("a", 1, True, (3, 9)), ("c", 2, False, (1, 2)), ("d", 3, True, (50, 60))], "problem_id string, ord int, verified boolean, token_counts struct<response:int,total:int>")
    ids = lambda df: [r.problem_id for r in df.collect()]
    assert ids(select.load_rows(rows, 2, "shortest")) == ["c", "a"] and ids(select.load_rows(rows)) == ["b", "a", "c", "d"]
    for wrong in ({"selection": "longest"}, {"limit": 0}):
        with pytest.raises(ValueError):
            select.load_rows(rows, **wrong)
    assert ids(select.select_short_rows(rows, 10, 2)) == ["b", "a"]
    with pytest.raises(ValueError, match="were wanted"):
        select.select_short_rows(rows, 10, 3)
    with pytest.raises(ValueError, match="share an id"):
        select.select_short_rows(rows.unionAll(rows.withColumn("ord", F.lit(0))), 10, 3)
    select.require_levels(rows, "verified", [True, False])
    with pytest.raises(ValueError):
        select.require_levels(rows, "problem_id", ["a", "b"])
    counts = select.split_counts(rows.withColumn("split", F.lit("x")), "problem_id", ["a", "zz"]).first()
    assert (counts.total, counts.a, counts.zz) == (4, 1, 0)


def test_unequal_samples_raise(spark):
    records = spark.createDataFrame([("a",), ("a",), ("b",)], "problem_id string")
    with pytest.raises(ValueError, match="1 to 2 samples"):
        metrics.require_equal_samples(records)
    with pytest.raises(ValueError, match="no generation"):
        metrics.require_equal_samples(records.where("problem_id = 'c'"))
    metrics.require_equal_samples(records.where("problem_id = 'a'"))


def test_a_broken_compiler_is_no_verdict(monkeypatch):
    assert judge.usable("no-such-compiler") is False
    monkeypatch.setattr(judge, "usable", lambda: False)
    with pytest.raises(RuntimeError, match="compiler does not work"):
        judge._need_compiler()


def test_judgement_is_not_stripped(spark):
    rows = spark.createDataFrame([("RIGHT",), ("right ",)], "judgement string").select("*", F.lit("1.0").alias("pass_rate"), F.lit("<think>a</think>```cpp\nint main() {}\n```").alias("r1_generation"), F.lit("").alias("solution"))
    assert [r[0] for r in rows.select(X.quality_reason()).collect()] == [None, "judgement"]


def test_reports_and_runs(spark, tmp_path):
    folder = str(tmp_path)
    (tmp_path / "c.yaml").write_text("data: {seed: 1}\nname: x\n")
    (tmp_path / "bad.yaml").write_text("- 1\n")
    config = reports.load_config(spark, f"{folder}/c.yaml")
    reports.require_sections(config, "data")
    with pytest.raises(reports.ConfigError, match="name, more"):
        reports.require_sections(config, "data", "name", "more")
    for name in ("bad.yaml", "none.yaml"):
        with pytest.raises(reports.ConfigError):
            reports.load_config(spark, f"{folder}/{name}")
    when = datetime(2026, 1, 2, 3, 4, 5, tzinfo=UTC)
    path = reports.start_run(spark, folder, "eval", config, when)
    assert path.endswith("20260102T030405Z_eval") and reports.read_report(spark, f"{path}/environment.json")["spark"] == spark.version
    with pytest.raises(FileExistsError):
        reports.start_run(spark, folder, "eval", config, when)
    assert reports.resume_run(spark, path, config) == path
    with pytest.raises(reports.ConfigError):
        reports.resume_run(spark, path, {"data": {"seed": 2}})
    reports.write_report(spark, spark.range(3).selectExpr("sum(id) as n"), f"{path}/metrics.json")
    assert reports.read_report(spark, f"{path}/metrics.json") == {"n": 3}
    with pytest.raises(ValueError):
        reports.write_report(spark, spark.range(2), f"{path}/two.json")


def test_generation_records_and_batches(spark, tmp_path):
    schema = "problem_id string, difficulty string, sample_index int, prompt string, response string, response_tokens int, finish_reason string, tests array<struct<input:string,output:string>>"
    rows = spark.createDataFrame([("p", "easy", 0, "q", "```cpp\nint main() {}\n```", 3, "stop", [("1", "1")]), ("p", "easy", 1, "q", None, None, "length", None)], schema)
    records = runs.generation_records(rows)
    verdicts = spark.createDataFrame([("p", 0, True), ("p", 1, True)], "problem_id string, sample_index int, compiled boolean")
    got = runs.judged_records(records, verdicts).orderBy("sample_index").collect()
    assert [(r.response_length, r.total_tests, r.extraction_success, r.code, r.judge and r.judge.compiled) for r in got] == [(24, 1, True, "int main() {}", True), (0, 0, False, None, None)]
    path = str(tmp_path / "generations")
    for _ in range(2):  # a retry repeats nothing
        jsonl.append_generations(records.where("sample_index = 0"), path, "a")
    jsonl.append_generations(records.where("sample_index = 1"), path, "b")
    assert sorted(r.sample_index for r in jsonl.read_generations(spark, path).collect()) == [0, 1]
    assert [r.batch for r in runs.request_batches(spark.range(5).withColumnRenamed("id", "ord"), 2).orderBy("ord").collect()] == [0, 0, 1, 1, 2]


def test_fingerprints_round_trip(spark, tmp_path):
    rows = [(0, "a", "x", -5, 7), (1, "b", "y", (1 << 62) + 3, 120)]
    jsonl.write_fingerprints(spark.createDataFrame(rows, "eval_ord int, problem_id string, sha256 string, simhash long, normalized_length int"), str(tmp_path / "f"))
    got = jsonl.read_fingerprints(spark, str(tmp_path / "f")).orderBy("eval_ord").collect()
    assert [tuple(r) for r in got] == rows


def test_duplicates_across_files(spark, tmp_path):
    schema = "problem_id string, problem string, language string, tests array<struct<input:string,output:string>>"
    row = json.dumps({"problem_id": "a", "problem": "p", "language": "cpp", "tests": [{"input": "1", "output": "1"}]})
    paths = []
    for name in ("x", "y"):
        (tmp_path / name).write_text(row + "\n")
        paths.append(str(tmp_path / name))
    with pytest.raises(runs.InvalidRows, match="duplicate"):
        runs.validate_problems(jsonl.read_jsonl(spark, paths, schema))
    assert runs.validate_problems(jsonl.read_jsonl(spark, paths[:1], schema)).count() == 1

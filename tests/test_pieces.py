"""Text functions, metrics, candidates, statistics, reports, judges, stores."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from scorelake.functions import identity, text
from scorelake.operators import candidates, execution, judging, metrics, readmodels, report, stats, store


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_parsers(spark):
    assert column(spark, ["The answer is \\boxed{4}.", "  7 ", "\\boxed{1} or \\boxed{ 2 }", "", None], text.math_answer) == ["4", "7", "2", "", None]
    assert column(spark, ["A or b", "no letter", "éA", "I think C.", "", None], text.choice_letter) == ["B", "", "", "C", "", ""]
    assert column(spark, ["x\n```python\na = 1\n```\n```\nb\n```", " plain ", None], text.code_block) == ["b", "plain", None]
    assert column(spark, ['{"code": "```py\\nz\\n```", "answer": "no"}', '{"solution": " ", "answer": "q"}', "t"], text.code_text) == ["z", "q", "t"]
    assert column(spark, ["Pass it", "  fail", " ", None], text.first_word) == ["pass", "fail", None, None]
    assert column(spark, ["pass", "0", "0.25", "maybe", "-2"], text.pass_fail_score) == [1.0, 0.0, 0.25, 0.0, -2.0]
    assert column(spark, ["a_b & {c} \\ 50% #~^$", None], text.latex_escaped) == ["a\\_b \\& \\{c\\} \\textbackslash{} 50\\% \\#\\textasciitilde{}\\textasciicircum{}\\$", ""]
    labels = spark.range(60).select(text.choice_label(F.col("id")).alias("l")).collect()
    assert [labels[i][0] for i in (0, 25, 26, 27, 52)] == ["A", "Z", "AA", "AB", "BA"]


def test_token_scores_equal_counters(spark):
    rng = random.Random(1)
    words = ["a", "b", "c", "dd", "eé"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(7))), rng.choice([None, " ".join(rng.choices(words, k=rng.randrange(5))), "A  b"])) for i in range(80)]
    got = {r["id"]: r for r in metrics.token_scores(spark.createDataFrame(rows, "id int, p string, g string"), ["id"], "p", "g").collect()}
    for i, p, g in rows:
        a, b = Counter(p.lower().split()), Counter((g or "").lower().split())
        o = sum((a & b).values())
        f1 = 1.0 if not a and not b else 0.0 if not o else 2 * o / (sum(a.values()) + sum(b.values()))
        assert got[i]["overlap"] == o and abs(got[i]["f1"] - f1) < 1e-12 and abs(got[i]["precision"] - (o / sum(a.values()) if a else 0)) < 1e-12


def test_exact_match_by_value(spark):
    pairs = [("1", "1.0", 1.0), ("true", "1", 1.0), ('"4"', "4", 0.0), ('{"a":1,"b":[2]}', '{"b":[2.0],"a":1}', 1.0), ("null", "null", 1.0), ('"4"', '{"answer":"4"}', 0.0)]
    df = spark.createDataFrame(pairs, "p string, e string, want double")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", metrics.exact_match(F.col("p"), F.col("e"))).collect())


def test_identities(spark):
    assert identity.content_hash({"b": 1, "a": [1, None, "é"]}) == identity.content_hash({"a": [1, None, "é"], "b": 1})
    seed = spark.range(1).select(identity.candidate_seed(F.lit("run"), F.lit(2))).first()[0]
    import hashlib

    assert seed == int(hashlib.sha256(b"run:2").hexdigest()[:8], 16)
    judge = spark.range(1).select(identity.judge_seed(F.lit("r"), F.lit("1:d:c"), F.lit("m"), F.lit("j"), F.lit(0), F.lit(1), F.lit(None).cast("string"), F.array(F.lit(0), F.lit(1)))).first()[0]
    assert judge == int(hashlib.sha256(b"r:1:d:c:m:j:0:1::0,1").hexdigest()[:8], 16)


def test_choices_among_candidates(spark):
    rows = spark.createDataFrame([("c", 0, "x", 1.0), ("c", 1, "y", 3.0), ("c", 2, "y", 3.0), ("c", 3, "x", 2.0), ("d", 5, None, 0.0)], "k string, i int, v string, s double")
    vote = {r["k"]: (r["v"], r["votes"], r["n"]) for r in candidates.majority_vote(rows, ["k"], "i", "v").collect()}
    assert vote == {"c": ("x", 2, 4), "d": (None, 1, 1)}
    assert {r["k"]: r["i"] for r in candidates.best_of_n(rows, ["k"], "i", "v", "s").collect()} == {"c": 1, "d": 5}
    assert {r["k"]: r["v"] for r in candidates.first_candidate(rows, ["k"], "i", "v").collect()} == {"c": "x", "d": None}
    assert candidates.candidate_count({"num_samples": 2, "pass_k": 5, "best_of": -1, "self_consistency_count": "9"}) == 5


def test_statistics(spark):
    assert stats.bootstrap_interval([1.0, 0.0, 1.0, 0.0]) == (0.0, 1.0) and stats.bootstrap_interval([3.0]) == (3.0, 3.0) and stats.bootstrap_interval([]) == (0.0, 0.0)
    assert stats.sign_test_p(1, 0) == 1.0 and stats.sign_test_p(0, 0) == 1.0 and abs(stats.sign_test_p(9, 1) - 0.021484375) < 1e-12
    base = spark.createDataFrame([("c1", "acc", 0.0), ("c2", "acc", 0.5), ("c1", "f1", 0.2), ("c2", "f1", 0.9)], "case_id string, metric_id string, value double")
    new = spark.createDataFrame([("c1", "acc", 1.0), ("c2", "acc", 0.5), ("c1", "f1", 0.6)], "case_id string, metric_id string, value double")
    got = {r["metric_id"]: r for r in stats.paired_compare(base, new, ["case_id", "metric_id"], ["metric_id"]).collect()}
    assert (got["acc"]["pairs"], got["acc"]["wins"], got["acc"]["ties"], got["acc"]["p_value"]) == (2, 1, 1, 1.0) and abs(got["f1"]["mean_delta"] - 0.4) < 1e-12
    rows = spark.createDataFrame([("m", i, float(i % 2)) for i in range(40)] + [("one", 0, 2.0), ("none", 0, None)], "m string, o int, v double")
    told = {r["m"]: r for r in stats.bootstrap(rows, ["m"], "v", ["o"], resamples=200).collect()}
    assert set(told) == {"m", "one"} and told["one"]["ci_lower"] == 2.0 and 0.3 < told["m"]["ci_lower"] < 0.5 < told["m"]["ci_upper"] < 0.7
    many = {r["m"]: r for r in stats.bootstrap(rows, ["m"], "v", ["o"], most=10).collect()}
    assert abs(many["m"]["ci_lower"] - 0.345) < 0.01  # the closed form for large groups


def test_timeline_positions(spark):
    log = spark.createDataFrame([("r", s, "x", None, None, None, None) for s in [5, 9000, 3, 4096, 20000]] + [("q", 1, "x", None, None, None, None)], "run_id string, seq bigint, event_type string, occurred_at timestamp, case_key string, candidate_id string, metric_id string")
    assert sorted((r["run_id"], r["position"], r["seq"]) for r in readmodels.timeline(log).collect()) == [("q", 0, 1), ("r", 0, 3), ("r", 1, 5), ("r", 2, 4096), ("r", 3, 9000), ("r", 4, 20000)]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("r", "c", "1:d:c", "m", None, 0.5, "incorrect", None, "a|b\nc")], "run_id string, case_id string, case_key string, metric_id string, candidate_id string, value double, outcome string, error_category string, error_message string")
    assert report.markdown_lines(report.score_table(rows), ["case_id", "error_message", "candidate_id"]).first()[0] == "| c | a\\|b c |  |"
    for kind in ("csv", "json", "markdown", "latex"):
        report.write_report(rows, str(tmp_path / kind), kind)
    assert json.loads(spark.read.text(str(tmp_path / "json")).first()[0])["value"] == 0.5
    numbered = report.numbered(spark.createDataFrame([(x,) for x in (9, 3, 7, 1)], "x int"), "x")
    assert sorted((r["position"], r["x"]) for r in numbered.collect()) == [(1, 1), (2, 3), (3, 7), (4, 9)]


def test_judges(spark):
    subjects = spark.createDataFrame([("k",)], "case_key string")
    assert [(r["call_id"], r["candidate_indices"]) for r in judging.fan_out(subjects, ["a", "b"], "pairwise").orderBy("repeat_index").collect()] == [("pairwise-0", [0, 1]), ("pairwise-1", [0, 1])]
    judged = spark.createDataFrame([("k", 0, "fail", 0.0), ("k", 1, "pass", 1.0), ("k", 2, None, None)], "case_key string, o int, label string, score double")
    assert judging.majority_score(judged, ["case_key"], "o").first()["winner"] == "fail"
    mean = judging.mean_score(judged, ["case_key"]).first()
    assert (mean["n"], mean["failures"], mean["mean"]) == (2, 1, 0.5)


def test_stores_and_code(spark):
    rows = spark.createDataFrame([(2, "x"), (1, "x"), (3, None)], "id int, c string")
    found = store.blobs(rows, "c", "id").collect()
    assert len(found) == 1 and found[0]["copies"] == 2 and found[0]["first_id"] == 1 and found[0]["blob_ref"].startswith("sha256:")
    cases = spark.createDataFrame([("a", "print(1)", "py", [("6", "4\n"), ("7", "4")]), ("b", "", "py", [("6", "4")]), ("n", "x", "py", [])], "k string, code string, language string, tests array<struct<input:string,output:string>>")
    rates = {r["k"]: r["pass_rate"] for r in execution.pass_rate(cases, lambda code, language, stdin: ("4\r\n" if stdin == "6" else "5", 0), ["k"]).collect()}
    assert rates == {"a": 0.5, "b": 0.0}


def test_functions_are_compared_with_their_reference(spark):
    import contextlib
    import io

    def executor(program, language, stdin):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            exec(program, {})
        return out.getvalue(), 0

    rows = [("ok", "def f(x): return x + 1", "def f(x): return 1 + x", "f", "", ["[1]", "[2]"]), ("half", "def f(x): return 2", "def f(x): return x + 1", "f", "", ["[1]", "[2]"]), ("none", "", "x", "f", "", ["[1]"]), ("script", "def f(x): return 0", "def f(x): return x", "f", "def check(g):\n    assert g(1) == 1", None)]
    df = spark.createDataFrame(rows, "k string, code string, reference string, function string, script string, inputs array<string>")
    assert {r["k"]: r["pass_rate"] for r in execution.function_pass_rate(df, executor, ["k"]).collect()} == {"ok": 1.0, "half": 0.5, "none": 0.0, "script": 0.0}


def test_final_values(spark):
    pairs = [('"a "', '{"answer": "a"}', 1.0), ("1", '{"answer": 1.0}', 1.0), ('[" a", 1.0]', '{"answer": ["a", 1]}', 1.0), ('"1"', '{"answer": 1}', 0.0), (None, '{"answer": null}', 1.0), ('"x"', '"x"', 1.0)]
    df = spark.createDataFrame(pairs, "p string, e string, want double")
    assert [r["got"] for r in df.withColumn("got", metrics.final_value_match(F.col("p"), F.col("e"))).collect()] == [w for _, _, w in pairs]

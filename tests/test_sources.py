import json

import pytest

from scorelake import cli, engine
from scorelake.sources import benchmarks, config, datasets, secrets
from scorelake.sources.runs import RunStore
from scorelake.streaming import live


def cases_of(df):
    return {r["case_id"]: r for r in df.collect()}


def test_jsonl(spark, tmp_path):
    file = tmp_path / "set.jsonl"
    file.write_text('{"input": {"q": "2+2"}, "expected_output": "4", "metadata": {"n": 1}}\n\n{"case_id": "x", "input": "a"}\n')
    rows = cases_of(datasets.from_jsonl(spark, str(file)))
    assert set(rows) == {"case-1", "x"} and rows["case-1"]["case_key"] == "3:set:case-1" and rows["case-1"]["expected_output"] == '"4"' and rows["x"]["expected_output"] is None
    assert rows["case-1"]["metadata"] == {"n": "1"} and json.loads(rows["case-1"]["input"]) == {"q": "2+2"}
    file.write_text('{"input": 1}\n{"cut\n')
    with pytest.raises(Exception, match="not a case"):
        datasets.from_jsonl(spark, str(file)).collect()


def test_inline_and_rows(spark):
    assert datasets.from_inline(spark, []).count() == 0
    made = cases_of(datasets.from_inline(spark, [{"input": "a"}, {"case_id": "z", "input": 1, "expected_output": None}]))
    assert set(made) == {"case-1", "z"} and made["case-1"]["input"] == '"a"'
    rows = spark.createDataFrame([("q1", 4, "x"), ("q2", None, "y")], "q string, a int, extra string")
    held = cases_of(datasets.from_rows(rows, "d", "test", "q", "a"))
    assert held["test-0"]["expected_output"] == "4" and held["test-1"]["metadata"] == {"extra": "y"}
    with pytest.raises(ValueError):
        datasets.from_rows(rows, "d", "test", "none")


def test_every_recipe_applies_to_empty_and_bare_rows(spark):
    for name, r in benchmarks.RECIPES.items():
        rows = spark.createDataFrame([(1,)], "unrelated int")
        made = benchmarks.materialized(rows, name).collect()
        if r.keep is None or name in ("hle", "procbench"):
            assert len(made) == 1 and made[0]["case_id"] == f"{r.split}-1", name
        assert json.loads(made[0]["expected_output"]) if made else True
        assert benchmarks.materialized(rows.limit(0), name).count() == 0


def test_recipes(spark):
    math = spark.createDataFrame([(7, "2+2?", " 4 ", ["alg", "x"])], "problem_idx int, problem string, answer string, problem_type array<string>")
    case = benchmarks.materialized(math, "aime_2025").first()
    assert case["case_id"] == "7" and case["input"].endswith("Problem:\n2+2?") and json.loads(case["expected_output"]) == {"answer": "4"} and case["metadata"] == {"problem_type": "alg, x"}
    mcq = spark.createDataFrame([("i", "Q?", ["one", "two"], "b")], "item_id string, question string, options array<string>, answer_letter string")
    case = benchmarks.materialized(mcq, "supergpqa").first()
    assert "A. one\nB. two" in case["input"] and json.loads(case["expected_output"]) == {"choice": "B"}
    gpqa = spark.createDataFrame([("What?\na) red\nb) blue\nA. b\nB. a", "a")], "question string, answer string")
    case = benchmarks.materialized(gpqa, "gpqa_diamond").first()
    assert "Question:\nWhat?\n" in case["input"] and "A. blue\nB. red" in case["input"] and json.loads(case["expected_output"]) == {"choice": "A"}
    code = spark.createDataFrame([("1", "p", "stdio", True, [("1", "2")]), ("2", "p", "file", True, []), ("3", "p", "stdio", False, [])], "id string, prompt string, input_mode string, official_tests_complete boolean, official_tests array<struct<input:string,output:string>>")
    kept = benchmarks.materialized(code, "codeforces").collect()
    assert [c["case_id"] for c in kept] == ["1"] and json.loads(kept[0]["expected_output"])["official_tests"] == [{"input": "1", "output": "2"}]
    tests = spark.createDataFrame([("a", '[{"input": "1", "output": "2"}, {"input": "3"}]'), ("b", "no json")], "question_id string, public_tests string")
    kept = benchmarks.materialized(tests, "livecodebench").collect()
    assert [c["case_id"] for c in kept] == ["a"] and len(json.loads(kept[0]["expected_output"])["official_tests"]) == 1
    hle = spark.createDataFrame([("1", "q", "a", ""), ("2", "q", "a", "img")], "id string, question string, answer string, image string")
    assert benchmarks.materialized(hle, "hle:text_only").count() == 1 and benchmarks.materialized(hle, "hle").count() == 2
    health = spark.createDataFrame([("p", [("user", "hi"), ("assistant", None)], ("done",))], "prompt_id string, prompt array<struct<role:string,content:string>>, ideal_completions_data struct<ideal_completion:string>")
    case = benchmarks.materialized(health, "healthbench").first()
    assert case["input"] == "user: hi" and json.loads(case["expected_output"])["ideal_completion"] == "done"
    with pytest.raises(ValueError):
        benchmarks.recipe("superchem:xx")
    with pytest.raises(KeyError):
        benchmarks.recipe("nothing")


def test_config_and_secrets(tmp_path):
    file = tmp_path / "c.toml"
    file.write_text('[dataset]\npath = "a.jsonl"\n')
    made = config.overridden(config.load(str(file)), ["generation.samples=3", "x.y=text"])
    assert made["dataset"]["path"] == str(tmp_path / "a.jsonl") and made["generation"]["samples"] == 3 and made["x"]["y"] == "text"
    assert config.symbol("json:dumps") is json.dumps
    assert secrets.sanitized({"url": "postgres://me:pw@h:5/db", "api_key": "${KEY}"}) == {"url": "postgres://me:<redacted>@h:5/db", "api_key": "${KEY}"}
    for bad in ({"api_key": "plain"}, {"note": "sk-abc123"}, {"a": {"Access-Key": ["x"]}}):
        with pytest.raises(ValueError):
            secrets.sanitized(bad)


def test_secrets_by_their_places_and_values():
    kept = {"n": None, "max_tokens": 5, "urls": ["HTTPS://Host/a@b", "postgres://me@H:5/db?x=1", "redis://:pw@[::1]:6/0"], "e": [], "f": {}, "token": "env:TOKEN", "x": " secret://vault/a ", "password": "", "secret": "<redacted>"}
    shown = secrets.sanitized(kept)
    assert shown == {**kept, "urls": ["HTTPS://Host/a@b", "postgres://me@h:5/db?x=1", "redis://:<redacted>@[::1]:6/0"]} and kept["urls"][2].startswith("redis://:pw")
    assert secrets.without_password("amqp://u:p@x@Host:/v#f") == "amqp://u:<redacted>@host/v#f" and secrets.without_password("mail me@x") is None and secrets.without_password("http://@h/") is None
    assert secrets.sanitized("plain") == "plain" and secrets.sanitized([1, True]) == [1, True]
    with pytest.raises(ValueError, match=r"a\.0\.pass-wd|a\.1"):
        secrets.sanitized({"a": [{"Passwd": "x"}, "ghp_abc"]})
    for bad in ("sk-ant-x", " hf_abc ", "xoxb-1-a", "-----BEGIN RSA PRIVATE KEY-----"):
        with pytest.raises(ValueError, match="at note"):
            secrets.sanitized({"note": bad})
    with pytest.raises(ValueError, match="metadata.dsn"):
        secrets.sanitized({"dsn": "plain"}, ("metadata",))


def test_labels_of_any_number(spark):
    from pyspark.sql import functions as F

    from scorelake.functions import text

    def plain(i):
        label = ""
        while i >= 0:
            label, i = chr(65 + i % 26) + label, i // 26 - 1
        return label

    some = [0, 1, 25, 26, 27, 51, 52, 701, 702, 703, 730, 18277, 18278, 475253, 475254, 12356629, 12356630, 321272405, 321272406, 2**31 - 1]
    rows = spark.createDataFrame([(i,) for i in some], "i int").select("i", text.choice_label(F.col("i")).alias("l")).collect()
    assert {r["i"]: r["l"] for r in rows} == {i: plain(i) for i in some}


def test_function_inputs_are_json(spark):
    rows = spark.createDataFrame([("t", "f", "def f(a):", "  return a", [["x", 'y"'], []], "")], "task_id string, entry_point string, prompt string, canonical_solution string, base_input array<array<string>>, test string")
    case = json.loads(benchmarks.materialized(rows, "humaneval_plus").first()["expected_output"])
    assert [json.loads(t["input"]) for t in case["official_tests"]] == [["x", 'y"'], []]


def test_experiment_runs_resumes_and_compares(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    cases = datasets.from_inline(spark, [{"case_id": f"c{i}", "input": f"q{i}", "expected_output": str(i)} for i in range(4)], "d")

    def wrong(case, seed):
        if case["case_id"] == "c3":
            raise ValueError("provider timeout")
        return case["expected_output"] if case["case_id"] != "c2" else "no"

    x = engine.Experiment(cases, wrong, "wrong", ["builtin/exact_match", "builtin/f1", "builtin/llm_rubric"], samples=2, judges={"j1": engine.demo_judge, "j2": lambda p, s: "fail"})
    run = x.run(store)
    rows = {(r["case_id"], r["metric_id"]): r for r in store.projection("score_rows", run).collect()}
    assert rows["c0", "builtin/exact_match"]["value"] == 1.0 and rows["c2", "builtin/exact_match"]["value"] == 0.0 and rows["c1", "builtin/llm_rubric"]["value"] == 0.5
    assert ("c3", "builtin/f1") not in rows
    assert store.projection("run_result", run).first()["status"] == "partial_failure"
    before = store.events(run).filter("event_type = 'generation_completed'").count()
    assert x.run(store) == run and store.events(run).filter("event_type = 'generation_completed'").count() == before
    x.replay(store, "score")
    assert store.events(run).filter("event_type = 'score_completed'").count() > 9
    right = engine.evaluate(store, cases, "builtin/exact_match")
    told = engine.compare(store, run, right).first()
    assert (told["pairs"], told["wins"], told["losses"]) == (3, 1, 0)
    assert engine.estimate(x)["judge_calls"] == 8
    with pytest.raises(ValueError):
        engine.Experiment(cases, metric_ids=["none"]).compile()
    with pytest.raises(ValueError):
        x.run(store, policy="error")
    store.clear(right)
    assert store.resume(right) is None and store.events(right).count() == 0


def test_retries():
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise TimeoutError("slow")
        return x

    assert engine.calling(flaky, engine.Retry(3, 0.0))(5) == (5, None)
    assert engine.calling(lambda: 1 / 0, engine.Retry(3, 0.0))() == (None, "division by zero")


def test_stream_follows_events(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "live"))
    row = ("r", 1, "score_completed", "1", None, "d", "c", "1:d:c", "k", 0, "m", None, None, '{"event_type": "score_completed", "score": {"value": 1}}')
    from scorelake.sources.runs import EVENTS

    source = tmp_path / "in"
    spark.createDataFrame([row, row], EVENTS).write.parquet(str(source))
    query = live.follow(live.event_stream(spark, str(source)), store, ["score_rows"], str(tmp_path / "cp"))
    query.awaitTermination(120)
    spark.createDataFrame([row[:1] + (2, "score_failed") + row[3:13] + ('{"event_type": "score_failed", "error": {"reason": "x"}}',)], EVENTS).write.mode("append").parquet(str(source))
    live.follow(live.event_stream(spark, str(source)), store, ["score_rows"], str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "live/derived/score_rows")).collect()
    assert len(got) == 1 and got[0]["error_category"] == "score_failure"


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["benchmarks"]) == 0 and "aime_2025" in capsys.readouterr().out
    assert cli.main(["init", str(tmp_path / "c.toml")]) == 0
    (tmp_path / "cases.jsonl").write_text('{"input": "q", "expected_output": "a"}\n')
    where = ["--store", str(tmp_path / "runs")]
    assert cli.main([*where, "estimate", str(tmp_path / "c.toml"), "--set", "generation.samples=2"]) == 0
    assert json.loads(capsys.readouterr().out)["generation_tasks"] == 2
    assert cli.main([*where, "run", str(tmp_path / "c.toml")]) == 0
    run = capsys.readouterr().out.strip().splitlines()[-1]
    assert cli.main([*where, "quickcheck", run]) == 0 and json.loads(capsys.readouterr().out)["mean"] == 1.0
    assert cli.main([*where, "report", run, "--format", "markdown", "--out", str(tmp_path / "out")]) == 0
    assert cli.main([*where, "resume", run]) == 0 and json.loads(capsys.readouterr().out)["status"] == "completed" and cli.main([*where, "resume", "none"]) == 1
    assert cli.main([*where, "export", run, "--out", str(tmp_path / "bundle")]) == 0 and spark.read.json(str(tmp_path / "bundle")).first()["event_type"] == "generation_completed"
    jobs = ["--queue", str(tmp_path / "jobs")]
    assert cli.main([*where, "submit", str(tmp_path / "c.toml"), *jobs]) == 0 and run in capsys.readouterr().out
    assert cli.main([*where, "worker", *jobs]) == 0 and capsys.readouterr().out.strip() == run  # it was finished already
    assert cli.main([*where, "worker", *jobs]) == 0 and "nothing" in capsys.readouterr().out


def test_selection_rejudging_and_benchmarks(spark, tmp_path):
    from scorelake.sources import runs

    store = runs.create_store(spark, "json", str(tmp_path / "json"))
    cases = datasets.from_inline(spark, [{"case_id": "c", "input": "q", "expected_output": "better"}], "d")
    seen = []
    x = engine.Experiment(
        cases, lambda case, seed: "better" if seed == 2 else "worse", "g", ["builtin/exact_match", "builtin/majority_vote_judge"], seeds=[1, 2, 3], selector="builtin/best_of_n", reducer=None,
        judges={"j": lambda p, s: "B" if p.endswith("B: better") else "A", "k": lambda p, s: "b" if p.endswith("better") else "pass"}, subscribers=[lambda r, stage, when: seen.append((stage, when))],
    )
    run = x.run(store)
    rows = {r["metric_id"]: r["value"] for r in store.projection("score_rows", run).collect()}
    assert rows["builtin/exact_match"] == 1.0 and seen[0] == ("generate", "before") and seen[-1] == ("judge", "after")
    before = store.events(run).filter("event_type = 'evaluation_completed'").count()
    x.rejudge(store, ["builtin/majority_vote_judge"])
    assert store.events(run).filter("event_type = 'evaluation_completed'").count() == before + 1
    assert "judge_calls" in runs.evaluation(store, run, "1:d:c", "builtin/majority_vote_judge") and runs.snapshot_report(store, run).first()["score_rows"] == 2
    rows = spark.createDataFrame([("1", "2+2?", "4")], "problem_idx string, problem string, answer string")
    told = engine.run_benchmark(store, rows, "aime_2025", lambda case, seed: "so \\boxed{4}")
    assert store.projection("score_rows", told).first()["value"] == 1.0
    with pytest.raises(KeyError, match="did you mean"):
        benchmarks.recipe("aime_225")
    with pytest.raises(KeyError):
        runs.create_store(spark, "nothing")


def test_queue(tmp_path):
    from scorelake import queue

    root = str(tmp_path)
    queue.submit(root, "b", {"n": 2})
    queue.submit(root, "a", {"n": 1})
    assert queue.work_once(root, lambda m: m["config"]["n"]) == 1
    with pytest.raises(ZeroDivisionError):
        queue.work_once(root, lambda m: 1 / 0)
    assert queue.work_once(root, lambda m: 0) is None and queue.requeue(root) == 1 and queue.work_once(root, lambda m: m["run_id"]) == "b"
    request = queue.submit(root, "c", {}, "batch")
    assert queue.batch(str(request), lambda m: m["mode"]) == "batch" and not request.exists()


def test_adapters():
    from scorelake import adapters

    chat = adapters.ChatGenerator(lambda messages, seed, **o: (messages[0]["content"], {"input_tokens": 3}, {"X-RateLimit-Limit": "90"}), "Be brief.")
    assert chat({"input": {"b": 1, "a": "é"}}, 5) == 'Be brief.\n\n{"a": "é", "b": 1}' and chat.last_usage == {"prompt_tokens": 3, "completion_tokens": 0} and chat.last_limit == 90
    graph = adapters.GraphGenerator(lambda value, seed: [{"name": "plan", "output": None}, {"name": "say", "output": value}])
    assert graph({"input": "x"}, 0) == "x" and graph.trace[0]["step_name"] == "plan"
    assert adapters.token_usage(None) is None and adapters.requests_per_minute({"a": 1}) is None


def test_a_stream_of_one_file_counts_copies_once(spark, tmp_path):
    from scorelake.sources.runs import EVENTS

    row = ("r", 1, "score_completed", "1", None, "d", "c", "1:d:c", "k", 0, "m", None, None, "{}")
    spark.createDataFrame([row, row, row[:1] + (2,) + row[2:]], EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    file = next((tmp_path / "in").glob("*.parquet"))
    for path in (str(file), str(tmp_path / "in")):
        assert [tuple(r) for r in live.caught_up_counts(live.event_stream(spark, path)).collect()] == [("score_completed", 2)]

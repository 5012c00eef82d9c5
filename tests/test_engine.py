"""Rules of running: what is recorded when something fails, is resumed, is selected or was done before."""

import json
import time

import pytest
from pyspark.sql import functions as F

from scorelake import adapters, engine
from scorelake.sources import datasets, runs
from scorelake.sources.runs import RunStore


def kinds(store, run):
    return {r["event_type"]: r["n"] for r in store.events(run).groupBy("event_type").agg(F.count("*").alias("n")).collect()}


def payloads(store, run, kind):
    return [json.loads(r["event_json"]) for r in store.events(run).filter(F.col("event_type") == kind).orderBy("sequence").collect()]


def cases_of(spark, *rows):
    return datasets.from_inline(spark, [{"case_id": c, "input": i, "expected_output": e} for c, i, e in rows], "d")


def test_failures_are_events_and_a_partial_failure_stays(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    cases = cases_of(spark, ("ok", "q1", {"answer": "1"}), ("bad-parse", "q2", "2"), ("bad-metric", "q3", "3"), ("bad-generator", "q4", "4"))

    def generator(case, seed):
        if case["case_id"] == "bad-generator" and not (tmp_path / "mended").exists():
            raise ValueError("provider timeout")
        return adapters.Generation(case["expected_output"], {"prompt_tokens": 3}, [{"role": "user", "content": case["input"]}], [{"step_name": "s"}])

    def parser(value, case):
        if case["case_id"] == "bad-parse":
            raise ValueError("no number")
        return value

    def metric(value, case):
        if case["case_id"] == "bad-metric":
            raise KeyError("x")
        return 1.0 if value == case["expected_output"] else 0.0

    x = engine.Experiment(cases, generator, "g", ["mine", "builtin/exact_match"], metric_functions={"mine": metric}, parser="own", parser_functions={"own": parser}, concurrency=2)
    run = x.run(store)
    told = kinds(store, run)
    assert (told["generation_failed"], told["parse_failed"], told["score_failed"], told["run_started"], told["run_completed"]) == (1, 1, 1, 1, 1)
    rows = {(r["case_id"], r["metric_id"]): r for r in store.projection("score_rows", run).collect()}
    assert rows["ok", "builtin/exact_match"]["value"] == 1.0  # the generator's object equals the expected one
    assert rows["bad-metric", "mine"]["error_category"] == "score_failure" and "x" in rows["bad-metric", "mine"]["error_message"]
    made = payloads(store, run, "generation_completed")[0]["result"]
    assert made["token_usage"] == {"prompt_tokens": 3} and made["trace"] == [{"step_name": "s"}] and made["conversation"][0]["role"] == "user"
    assert store.projection("run_result", run).first()["status"] == "partial_failure"
    (tmp_path / "mended").touch()
    assert x.run(store) == run  # resumed: the failed candidate is made now, but the run isn't started again
    assert kinds(store, run)["run_started"] == 1 and store.projection("run_result", run).first()["status"] == "partial_failure"
    assert store.events(run).filter("event_type = 'generation_completed' and case_id = 'bad-generator'").count() == 1
    store.refresh("run_result", [run])
    stored = store.projection("run_result", run)
    assert "derived" in stored.inputFiles()[0] and stored.first()["status"] == "partial_failure"  # read, not computed
    with pytest.raises(ValueError, match="unknown parser"):
        engine.Experiment(cases, parser="none").compile()


def test_finished_runs_are_taken_and_errors_stop_a_run(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    cases = cases_of(spark, ("a", {"q": 1}, None))
    x = engine.Experiment(cases, concurrency=1, threads=1)
    run = x.run(store, until="generate")
    n = store.events(run).count()
    assert payloads(store, run, "generation_completed")[0]["result"]["final_output"] == {"q": 1}  # the input, where nothing is expected
    assert x.run(store, until="generate") == run and store.events(run).count() == n  # nothing is done again

    def stop(run_id, stage, when):
        if stage == "parse":
            raise RuntimeError("stopped")

    with pytest.raises(RuntimeError, match="stopped"):
        engine.Experiment(cases, concurrency=1, subscribers=[stop]).run(store)
    assert kinds(store, run)["run_failed"] == 1 and store.projection("run_result", run).first()["status"] == "failed"
    with store.lease(run), pytest.raises(RuntimeError, match="is being written"):
        x.run(store)
    with store.lease(run), store.lease(run, minutes=-1):  # an old lease is taken over
        pass
    assert store.version() == 0 and store.migrate() == runs.LAYOUT == store.version() == store.migrate()


def test_selection_reduction_workflows_and_the_cache(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    cases = cases_of(spark, ("c", "q", "b!"), ("empty", "q", "x"))

    def select(outputs, case, ask):
        return [] if case["case_id"] == "empty" else [i for i, o in enumerate(outputs) if ask(f"keep {o}?", "k") == "yes"]

    def workflow(subject, case, ask):
        assert subject == ["b", "c"]
        return {"value": 0.5 if ask("good?") == "fine" else 0.0, "label": "half"}

    def failing(subject, case, ask):
        return ask("more?", "down")

    def down(prompt, seed):
        raise ConnectionError("down")

    def generator(case, seed):
        return {1: "a", 2: "b", 3: "c"}[seed]

    settings = {
        "metric_ids": ["builtin/exact_match", "w", "f"], "seeds": [1, 2, 3], "selector": "own", "selector_functions": {"own": select}, "reducer": "first", "reducer_functions": {"first": lambda outputs, case: outputs[0] + "!"},
        "judges": {"a": lambda p, s: "fine", "k": lambda p, s: "no" if "a?" in p else "yes", "down": down}, "workflows": {"w": workflow, "f": failing}, "subjects": {"w": "selection"}, "cache": True, "blobs": True,
        "concurrency": 2, "retry": engine.Retry(2, 0.0),
    }
    x = engine.Experiment(cases, generator, "g", **settings)
    run = x.run(store)
    told = kinds(store, run)
    assert (told["selection_completed"], told["selection_failed"], told["reduction_completed"]) == (1, 1, 1) and "no candidate" in payloads(store, run, "selection_failed")[0]["error_message"]
    assert payloads(store, run, "selection_completed")[0]["candidate_ids"] == ["c-candidate-1", "c-candidate-2"] and payloads(store, run, "reduction_completed")[0]["source_candidate_ids"] == ["c-candidate-1", "c-candidate-2"]
    rows = {r["metric_id"]: r for r in store.projection("score_rows", run).filter("case_id = 'c'").collect()}
    assert (rows["builtin/exact_match"]["value"], rows["w"]["value"], rows["f"]["error_category"]) == (1.0, 0.5, "evaluation_failure")
    assert (told["step_started"], told["step_completed"], told["step_failed"], told["evaluation_completed"], told["evaluation_failed"]) == (2, 1, 1, 1, 1)
    done = payloads(store, run, "evaluation_completed")[0]
    assert done["execution"]["judge_calls"][0]["judge_model_id"] == "a" and store.blobs().filter(F.col("blob_ref") == done["execution_blob_ref"]).count() == 1
    calls = tmp_path / "calls"

    def other(case, seed):
        calls.touch()
        return "never"

    second = engine.Experiment(cases, other, "g", **{**settings, "metric_ids": ["builtin/exact_match"]})
    again = second.run(store, until="generate")
    assert again != run and not calls.exists() and all(p["cache_hit"] for p in payloads(store, again, "generation_completed"))


def test_calls_share_a_limit_and_keep_their_order():
    began = time.monotonic()
    made = engine.calling(lambda x: x, engine.Retry(1), per_minute=1200)
    assert engine._all(made, ((i,) for i in range(9)), 4) == [(i, None) for i in range(9)] and time.monotonic() - began > 0.35


def test_scores_follow_whole_runs_over_batches(spark, tmp_path):
    from scorelake.sources.runs import EVENTS
    from scorelake.streaming import live

    def row(seq, kind, body):
        return ("r", seq, kind, "1", None, "d", "c", "1:d:c", "k", 0, "m", None, None, json.dumps({"event_type": kind, **body}))

    store, seen = RunStore(spark, str(tmp_path / "live")), []
    sink = lambda rows: seen.append([(r["value"], r["error_category"]) for r in rows.collect()])
    broken = row(1, "parse_failed", {})[:12] + ("no number", "{}")
    for batch in ([broken], [row(2, "score_completed", {"score": {"value": 1}})]):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live.current_scores_stream(store, str(tmp_path / "in"), sink).awaitTermination(120)
    assert seen == [[], [(None, "parse_failure")]]  # the second batch's score is folded with the first one's failure
    assert store.events("r").count() == 2  # the second batch went on where the first one stopped


def test_bundles_are_checked_and_numbered(spark):
    from scorelake.operators import store

    log = spark.createDataFrame([("r", 4, "score_completed", "c"), ("s", 9, "score_completed", "c")], "run_id string, sequence bigint, event_type string, case_key string")
    records = spark.createDataFrame([("r", 4, "score_completed", "c"), ("r", 1, "parse_completed", "c"), ("r", 2, "parse_completed", "c")], log.schema).coalesce(1)
    known = spark.createDataFrame([("c",)], "case_key string")
    got = sorted(map(tuple, store.imported(records, known, ["case_key"], log, run_id="r").collect()))
    assert got == [("r", 4, "score_completed", "c"), ("r", 5, "parse_completed", "c"), ("r", 6, "parse_completed", "c"), ("s", 9, "score_completed", "c")]
    for wrong in ({"run_id": "s"}, {"known": known.limit(0)}, {"log": log.filter("run_id = 's'")}):
        with pytest.raises(ValueError):
            store.imported(records, wrong.get("known", known), ["case_key"], wrong.get("log", log), run_id=wrong.get("run_id", "r"))

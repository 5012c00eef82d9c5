"""The folded log against a literal replay of random events."""

import random

from pyspark.sql import functions as F

from scorelake.operators import fold

LOG = "run_id string, seq bigint, event_type string, case_key string, case_id string, dataset_id string, candidate_id string, candidate_index int, metric_id string, occurred_at timestamp, error_message string, value double, reason string, stage string, status string, done boolean, parsed_null boolean"


def random_log(rng, run, n):
    rows = []
    for seq in range(n):
        case, m, c, i = f"1:d:{rng.randrange(2)}", f"m{rng.randrange(2)}", f"c{rng.randrange(3)}", rng.choice([0, 1, 2, None])
        kind = rng.choice(fold.KNOWN_EVENTS[:15] if rng.random() < 0.9 else ["run_started", "run_completed"])
        done = rng.random() < 0.9 if kind.endswith("completed") and not kind.startswith(("run", "selection")) or kind == "score_failed" else None
        in_case = not kind.startswith("run")
        rows.append((
            run, seq, kind, case if in_case else None, "c" if in_case else None, "d", c if in_case else None, i if kind.startswith("generation") else None, m if kind.startswith(("score", "evaluation")) else None, None,
            f"e{seq}" if kind.endswith("failed") else None, float(seq % 2) if kind == "score_completed" else None, None, "score" if kind == "run_completed" else None,
            rng.choice(["completed", "partial_failure"]) if kind == "evaluation_completed" else None, done, (rng.random() < 0.3) if kind == "parse_completed" and done else None,
        ))
    return rows


def replay(rows):
    status, cases = "pending", {}

    def failing(c):
        return bool(c["gf"] or c["sel"] or c["red"] or c["par"] or any(v in ("bad", "partial_failure") for v in c["ev"].values()) or any(not ok for ok, _ in c["sc"].values()))

    for r in rows:
        kind, case, cand, i, m, err, value, st, done, null = r[2], r[3], r[6], r[7], r[8], r[10], r[11], r[14], r[15], r[16]
        bad_before = status in ("failed", "partial_failure") or any(map(failing, cases.values()))
        if kind == "run_started":
            status = "running"
        elif kind == "run_completed":
            status = "partial_failure" if bad_before else "completed"
        elif kind == "run_failed":
            status = "failed"
        if case is None:
            continue
        c = cases.setdefault(case, {"gen": set(), "gf": {}, "gi": {}, "sel": None, "red": None, "par": None, "null": None, "ev": {}, "sc": {}})
        if kind == "generation_completed" and done:
            c["gen"].add(cand)
            if i is not None:
                c["gf"].pop(c["gi"].pop(i, None), None)
            c["gf"].pop(cand, None)
        elif kind == "generation_failed":
            c["gf"][cand] = err
            if i is not None:
                c["gi"][i] = cand
        elif kind in ("selection_completed", "selection_failed"):
            c["sel"] = err
        elif kind == "reduction_failed":
            c["red"] = err
        elif kind == "parse_failed":
            c["par"] = err
        elif kind == "parse_completed" and done:
            c["null"] = null
        elif kind == "evaluation_completed" and done:
            c["ev"][m] = st
        elif kind == "evaluation_failed":
            c["ev"][m] = "bad"
        elif kind == "score_completed" and done:
            c["sc"][m] = (True, value)
        elif kind == "score_failed" and done:
            c["sc"][m] = (False, err)
        if status == "completed" and failing(c):
            status = "partial_failure"
    return status, {k: (len(c["gen"]), len(c["gf"]), c["par"], c["red"], sum(ok for ok, _ in c["sc"].values()), sum(not ok for ok, _ in c["sc"].values()), failing(c)) for k, c in cases.items()}


def test_fold_equals_replay(spark):
    rng = random.Random(11)
    logs = {f"r{k}": random_log(rng, f"r{k}", rng.choice([3, 8, 20, 60])) for k in range(60)}
    rows = [r for rs in logs.values() for r in rs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, LOG).cache()
    status = {r["run_id"]: r["status"] for r in fold.run_states(df).collect()}
    states = {}
    for r in fold.case_states(df).collect():
        states.setdefault(r["run_id"], {})[r["case_key"]] = (r["n_generated"], r["n_generation_failures"], r["parse_error"], r["reduction_error"], r["n_scores"], r["n_score_failures"], r["has_failure"])
    for run, log in logs.items():
        want_status, want = replay(log)
        assert states.get(run, {}) == want, (run, log)
        assert status[run] == want_status, run
    df.unpersist()


def test_score_rows_order_of_errors(spark):
    at = lambda seq, kind, **k: tuple({"run_id": "r", "seq": seq, "event_type": kind, "case_key": "1:d:c", "case_id": "c", **k}.get(x.split()[0]) for x in LOG.split(", "))
    done = [at(0, "score_completed", metric_id="a", value=1.0, done=True), at(1, "score_completed", metric_id="b", value=0.0, done=True), at(2, "evaluation_completed", metric_id="b", status="partial_failure", done=True)]
    rows = {r["metric_id"]: r for r in fold.score_rows(spark.createDataFrame(done, LOG)).collect()}
    assert rows["a"]["outcome"] == "correct" and rows["b"]["error_category"] == "evaluation_partial_failure" and rows["b"]["value"] is None
    failed = spark.createDataFrame([at(0, "parse_failed", error_message="x")], LOG)
    metrics = spark.createDataFrame([("r", "a"), ("r", "b")], "run_id string, metric_id string")
    assert fold.score_rows(failed).count() == 0  # no scores: no rows, unless the metrics are named
    assert {r["error_category"] for r in fold.score_rows(failed, metrics).collect()} == {"parse_failure"}


def test_log_of_dirty_events(spark):
    schema = "run_id string, sequence bigint, event_type string, occurred_at timestamp, dataset_id string, case_id string, case_key string, candidate_id string, candidate_index int, metric_id string, error_message string, event_json string"
    rows = [
        ("r", 1, "score_completed", None, "d", "c", None, "k", 0, None, None, '{"event_type": "score_completed", "metric_id": "m", "score": {"value": "0.5"}}'),
        ("r", 1, "score_completed", None, "d", "c", "1:d:c", "k", 0, "m", None, '{"cut'), ("r", 2, "unknown_kind", None, None, None, None, None, None, None, None, None),
        ("r", 3, "parse_completed", None, "d", "c", "", "k", 0, None, None, '{"event_type": "parse_completed", "result": {"value": null}}'),
    ]
    log = fold.event_log(spark.createDataFrame(rows, schema)).orderBy("seq").collect()
    assert len(log) == 2 and log[0]["value"] == 0.5 and log[0]["case_key"] == "1:d:c" and log[1]["parsed_null"] is True
    assert fold.replayed(fold.case_states(fold.event_log(spark.createDataFrame(rows, schema))), "score").select(F.sum("n_scores")).first()[0] == 0

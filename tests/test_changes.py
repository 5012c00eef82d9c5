import random

from scorelake.operators.changes import SCORE_KEY, apply_changes, current_scores

EVENTS = "id bigint, run_id string, sequence bigint, event_type string, dataset_id string, case_id string, case_key string, candidate_id string, metric_id string, event_json string"


def brute(rows):
    last = {}
    for key, order, deleted, value in rows:
        if key not in last or (order if order is not None else -1, not deleted, value) > last[key][:3]:
            last[key] = (order if order is not None else -1, not deleted, value)
    return {(k, v[2]) for k, v in last.items() if v[1]}


def test_newest_first_equals_replaying(spark):
    rng = random.Random(3)
    for n, batches in ((0, 3), (1, 4), (60, 1), (400, 5)):
        rows = [(rng.choice(["a", "b", "c", None, "hot", "hot", "hot"]) or None, rng.randrange(40), rng.random() < 0.3, rng.randrange(5)) for _ in range(n)]
        rows += rng.sample(rows, len(rows) // 4)  # redelivered
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "key string, seq bigint, gone boolean, value int")
        got = {(r["key"], r["value"]) for r in apply_changes(df, ["key"], "seq", "gone", batches=batches).collect()}
        assert got == brute(rows)


def test_base_rows_and_nulls(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "key string, value int")
    changes = spark.createDataFrame([("a", 5, True, None, "x"), ("c", 1, None, 9, None), (None, 2, False, 7, "y")], "key string, seq bigint, gone boolean, value int, extra string")
    got = sorted((r["key"] or "", r["value"], r["extra"]) for r in apply_changes(changes, ["key"], "seq", "gone", base=base).collect())
    assert got == [("", 7, "y"), ("b", 2, None), ("c", 9, None)]
    none = changes.limit(0)
    assert apply_changes(none, ["key"], "seq", "gone", base=base).count() == 3
    assert apply_changes(none, ["key"], "seq", "gone").count() == 0


def test_map_images(spark):
    changes = spark.createDataFrame([("a", 1, False, {"x": "1"}), ("a", 2, False, {"x": "2"})], "key string, seq bigint, gone boolean, m map<string,string>")
    assert apply_changes(changes, ["key"], "seq", "gone").first()["m"] == {"x": "2"}


def test_scores(spark):
    row = lambda i, seq, kind, key="1:d:c", metric="m", payload="{}": (i, "r", seq, kind, "d", "c", key, "k", metric, payload)
    events = spark.createDataFrame(
        [
            row(1, 5, "score_completed"), row(2, 9, "score_failed", key=""), row(3, 7, "score_completed"),  # late; failed wins
            row(4, 1, "score_completed", metric=None, payload='"{\\"metric_name\\": \\"n\\"}"'), row(5, 2, "score_completed", metric="n", key=None), row(5, 2, "score_completed", metric="n", key=None),
            row(6, 3, "parse_completed"),
        ],
        EVENTS,
    )
    got = [tuple(r) for r in current_scores(events).select(*SCORE_KEY, "sequence").collect()]
    assert got == [("r", "1:d:c", "k", "n", 2)]
    assert current_scores(events.limit(0)).count() == 0

import json

from scorelake.operators import drift


def events(spark, files, kind="t"):
    rows = [("s", f, kind, json.dumps(p) if not isinstance(p, (str, type(None))) else p) for f, payloads in files.items() for p in payloads]
    return spark.createDataFrame(rows, "store_id string, file_no int, event_type string, event_json string")


def report(spark, files):
    return sorted(tuple(r)[1:2] + tuple(r)[3:] for r in drift.drift_report(events(spark, files)).collect())


def base(i, **more):
    return {"run_id": f"{i:064x}", "candidate_id": f"cand-{i % 3}", "index": i % 3, "score": {"metric_id": "m/x", "value": i / 10}, **more}


def test_added_removed_renamed_retyped(spark):
    one = [base(i) for i in range(6)]
    two = [{"run_id": f"{i:064x}", "candidateId": f"cand-{i % 3}", "index": str(i % 3), "score": {"metric_id": "m/x", "val": i / 10}, "worker": "w-1"} for i in range(6)]
    assert report(spark, {1: one, 3: two}) == [
        (3, "added", "worker", "worker"), (3, "renamed", "candidate_id", "candidateId"), (3, "renamed", "score.value", "score.val"), (3, "retyped", "index", "index"),
    ]
    assert report(spark, {1: two, 2: one})[0] == (2, "removed", "worker", "")


def test_renamed_and_retyped_gives_two_rows(spark):
    one = [base(i, seed=1000 + i) for i in range(5)]
    two = [{**{k: v for k, v in base(i).items()}, "random_seed": str(1000 + i)} for i in range(5)]
    assert report(spark, {1: one, 2: two}) == [(2, "renamed", "seed", "random_seed"), (2, "retyped", "seed", "random_seed")]


def test_majorities_nulls_and_unreadable_rows(spark):
    one = [base(0, tag=None), base(1, tag=None), base(2)]  # carried by two of three, null values count
    two = [base(0, tag="x"), base(1), "{cut", None, json.dumps(json.dumps(base(2, tag="y")))]
    assert report(spark, {1: one, 2: two}) == []  # unknown type against string is no retyping
    assert report(spark, {1: one, 2: ["{cut"], 5: [base(0)]}) == [(5, "removed", "tag", "")]  # file 2 has no readable row
    assert report(spark, {1: one}) == [] and drift.drift_report(events(spark, {})).count() == 0


def test_unrelated_fields_are_no_rename(spark):
    one, two = [base(i, flag=True) for i in range(4)], [base(i, depth=[1]) for i in range(4)]
    assert report(spark, {1: one, 2: two}) == [(2, "added", "depth", "depth"), (2, "removed", "flag", "")]


def test_rescue_and_replay_lose_nothing(spark):
    payloads = [{"run_id": "r", "seed": "7", "candidateId": "c", "cache_hit": 1, "score": {"value": "0.5", "weight": 2}}, {"seed": {"no": 1}, "odd": None, "occurred_at": 1775807292437}, "{cut", None]
    rows = events(spark, {1: payloads}).withColumnRenamed("store_id", "run_id")
    held = drift.ingested(rows, ["run_id", "file_no"], "event_json")
    got = {r["payload__run_id"]: r for r in held.collect() if r["readable"]}
    assert got["r"]["seed"] == 7 and got["r"]["cache_hit"] is True and got["r"]["score__value"] == 0.5
    assert json.loads(got["r"]["rescued"]) == {"candidateId": "c", "score.weight": 2}
    assert json.loads(got[None]["rescued"]) == {"seed": {"no": 1}, "odd": None} and str(got[None]["occurred_at"]).startswith("2026-04-10")
    assert [r["rescued"] for r in held.filter("not readable").collect()] == [json.dumps({"": "{cut"}), None]
    again = {r["payload__run_id"]: r for r in drift.promoted(held, {"candidateId": "candidate_id"}, ["run_id", "file_no"]).collect() if r["readable"]}
    assert again["r"]["candidate_id"] == "c" and json.loads(again["r"]["rescued"]) == {"score.weight": 2}


def test_whole_values_count(spark):
    one = [base(i, u=f"https://a.example/{'x' * 90}/{i}", v=[1, {"k": 1}], w="9" * 70) for i in range(4)]
    two = [{**base(i), "u": f"https://a.example/{'x' * 90}/{i}", "vv": [1, {"k": 1}], "w2": "9" * 70} for i in range(4)]
    assert report(spark, {1: one, 2: two}) == [(2, "renamed", "v", "vv"), (2, "renamed", "w", "w2")]
    assert drift.shape("a-1" * 100 + "!") != drift.shape("a-1" * 100 + "?") and drift.shape([1, "x"]) != drift.shape([1, 2]) and drift.shape("9" * 5000) == ("integer 5000", "")


def test_stray_keys_leave_before_anything_is_listed(spark):
    one = [base(i, **{f"stray-{i}-{j}": j for j in range(50)}) for i in range(6)]
    files = drift.schemas(events(spark, {1: one})).collect()
    assert len(files) == 1 and files[0]["total"] == 6 and {f["field"] for f in files[0]["fields"]} == {"run_id", "candidate_id", "index", "score", "score.metric_id", "score.value"}


def test_versions_and_undeclared_changes(spark):
    first, second = [base(i) for i in range(3)], [base(i, more=1) for i in range(3)]
    rows = [("s", f, "t", v, json.dumps(p)) for f, v, some in ((1, "1", first), (2, "1", second), (3, "v2", first), (4, None, first)) for p in some]
    log = spark.createDataFrame(rows, "store_id string, file_no int, event_type string, schema_version string, event_json string")
    meta = spark.createDataFrame([("s", 1, "schema_version", "schema-1"), ("s", 1, "schema_version", "1.0"), ("s", 2, "schema_version", "unknown"), ("s", 3, "backend", "2")], "store_id string, file_no int, key string, value string")
    told = {r["file_no"]: r for r in drift.changes_by_file(drift.drift_report(log), drift.versions(log, meta)).collect()}
    assert [(told[f]["declared"], told[f]["in_rows"], told[f]["changes"], told[f]["undeclared"]) for f in (1, 2, 3, 4)] == [(1, 1, 0, False), (None, 1, 1, True), (None, 2, 1, False), (None, None, 0, False)]
    assert told[4]["unversioned"] == 3


def test_only_approved_fields_are_promoted(spark):
    rows = events(spark, {1: [{"candidateId": "c"}]})
    assert drift.consistent(rows, ["file_no"], approved={}).first()["candidate_id"] is None
    assert drift.consistent(rows, ["file_no"], approved={"candidateId": "candidate_id"}).first()["candidate_id"] == "c"

import json
import random

import pytest

from scorelake.functions.payload import read_payload
from scorelake.operators import nested


def rebuild(triples):
    return sorted((t, o, f, v) for t, o, f, v in triples)


def test_paths_and_positions():
    record = {"id": "r", "a": [{"x": 1, "b": [{"y": "s"}, None, {}]}, None, {"x": None}], "o": {"list": [1, 2]}, "e": []}
    got = rebuild(nested.path_triples(record))
    assert ("a", (0,), "x", "1") in got and ("a", (2,), nested.RECORD, None) in got and ("a.b", (0, 2), nested.RECORD, None) in got
    assert ("a.b", (0, 0), "y", "s") in got and ("o.list", (1,), "", "2") in got and ("", (), "id", "r") in got
    assert not [g for g in got if g[0] == "a" and g[1] == (1,)] and not [g for g in got if g[0] == "a.b" and g[1] == (0, 1)]


def test_object_in_place_of_an_array():
    got = rebuild(nested.path_triples({"a": {"x": 1}}, frozenset(["a"])))
    assert got == [("", (), "", None), ("a", (0,), "", None), ("a", (0,), "x", "1")]


def test_deep_records_need_no_recursion():
    record = current = {}
    for _ in range(3000):
        current["n"] = {}
        current = current["n"]
    current["a"] = [{"x": 1}]
    assert any(t[3] == "1" for t in nested.path_triples(record))


def test_children_of_events_and_snapshots(spark):
    response = {"retry_history": {"attempt": 1}, "conversation_trace": {"messages": [None, {"role": "user"}]}}
    execution = {"judge_calls": [{"call_id": "1"}, {"call_id": "2"}], "judge_responses": [None, response], "scores": None}
    whole = json.dumps({"execution": json.dumps(execution)})
    events = spark.createDataFrame(
        [("r", 1, "evaluation_completed", json.dumps(whole)), ("r", 1, "evaluation_completed", whole), ("r", 2, "evaluation_completed", whole[:-9]), ("r", 3, "other", whole), ("r", 4, "evaluation_completed", None), ("r", 5, "evaluation_completed", '{"execution": null}')],
        "run_id string, sequence bigint, event_type string, event_json string",
    )
    snapshot = json.dumps({"datasets": [{"dataset_id": "d", "cases": {"case_id": "c"}}, None], "component_refs": {"metrics": [{}], "parsers": None}})
    snapshots = spark.createDataFrame([("r", snapshot), ("r", snapshot), ("s", "")], "run_id string, snapshot_json string")
    got = sorted(tuple(r) for r in nested.run_children(events, snapshots).collect())
    assert got == sorted([
        ("r", 1, "judge_calls", -1, 0), ("r", 1, "judge_calls", -1, 1), ("r", 1, "judge_responses", -1, 1), ("r", 1, "judge_responses.retry_history", 1, 0), ("r", 1, "judge_responses.conversation_trace.messages", 1, 1),
        ("r", -1, "datasets", -1, 0), ("r", -1, "datasets.cases", 0, 0), ("r", -1, "component_refs.metrics", -1, 0),
    ])
    assert nested.run_children(events.limit(0), snapshots.limit(0)).count() == 0


def test_pivot_keeps_links(spark):
    rows = spark.createDataFrame([(1, '{"a": [{"k": "x", "b": [{"v": 1}, {"v": 2.5}]}]}')], "id bigint, j string")
    triples = nested.shredded(rows, ["id"], "j")
    table = nested.pivoted(triples, ["id"], "a.b", {"v": "v", "nothing": "none"}).orderBy("child_pos").collect()
    assert [(r["parent_pos"], r["child_pos"], r["v"], r["none"]) for r in table] == [(0, 0, "1", None), (0, 1, "2.5", None)]


def _made(rng, depth=0):
    k = rng.random()
    if depth > 4 or k < 0.35:
        return rng.choice([None, True, False, 1, -2.50, 1e300, "", 'a"b\\é\n', "[x]", 10**20, '{"a": 1}'])
    if k < 0.6:
        return [_made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"{rng.choice(['a', 'b', 'é', 'x.y'])}{i}": _made(rng, depth + 1) for i in range(rng.randrange(4))}


def test_the_stream_equals_the_tree():
    rng, repeated = random.Random(3), frozenset(["a0", "a0.b1", "b1"])
    for _ in range(4000):
        value = _made(rng) if rng.random() < 0.7 else {"execution": _made(rng, 1) if rng.random() < 0.7 else json.dumps(_made(rng, 1)), "z": _made(rng, 1)}
        text = json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        text = json.dumps(text) if rng.random() < 0.2 else text
        if rng.random() < 0.2 and text:
            i = rng.randrange(len(text))
            text = text[:i] + rng.choice(["", ",", "}", "]", '"', ":", "x"]) + text[i + rng.randrange(2) :]
        text = text[: rng.randrange(len(text) + 1)] if rng.random() < 0.1 else text
        for root in (None, "execution"):
            record = read_payload(text)
            if record is not None and root:
                record = record.get(root)
                record = read_payload(record) if isinstance(record, str) else record
            want = sorted(nested.path_triples(record, repeated), key=repr) if isinstance(record, dict) else []
            try:
                got = sorted(nested.stream_triples(text, repeated, root), key=repr)
            except (ValueError, IndexError):
                got = []
            assert got == want, text


def test_the_stream_of_deep_and_odd_texts():
    deep = '{"n":' * 50_000 + '{"a":[{"x":1}]}' + "}" * 50_000
    assert sum(1 for t in nested.stream_triples(deep) if t[3] == "1") == 1
    for text in ("", " ", "[]", "1", "null", '"x"', '{"a":1} x', '{"a":01}', '{"a":tru}', '{"a" 1}', "{,}", '{"a":[1,]}', '"{\\"a\\": 1', '{"a":"\n"}'):
        with pytest.raises((ValueError, IndexError)):
            list(nested.stream_triples(text))


def test_flat_tables_lose_no_field(spark):
    records = [{"a": [{"Key": "x", "key": "y", "id": 1, "p.q": 2, "r": {"s": None, "t": [1, None]}}, None, {"n0": 0, "n1": 1, "n2": 2}]}, {"a": {"key": "z", "parent": "up"}}, {"a": [5, [6]]}]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(0, json.dumps(records[0])), (9, None), (8, "{cut")], "id bigint, j string")
    triples = nested.shredded(rows, ["id"], "j", repeated=["a"])
    whole = nested.flat_table(triples, ["id"], "a")
    assert whole.columns == ["id", "parent", "parent_pos", "child_pos", "element", "Key", "id_2", "key_2", "n0", "n1", "n2", "p__q", "parent_2"]
    got = {(r["id"], r["child_pos"]): r for r in whole.collect()}
    assert set(got) == {(0, 0), (0, 2), (1, 0), (2, 0), (2, 1)} and (got[0, 0]["Key"], got[0, 0]["key_2"], got[0, 0]["id_2"]) == ("x", "y", "1") and got[2, 1]["element"] == "[6]"
    few = {(r["id"], r["child_pos"]): r for r in nested.flat_table(triples, ["id"], "a", most=1).collect()}
    assert few[0, 2]["other"] == {"n0": "0", "n1": "1", "n2": "2"} and few[0, 0]["other"] == {"Key": "x", "id": "1", "p.q": "2", "r.s": ""} and few[0, 0]["key"] == "y"
    inner = nested.flat_table(triples, ["id"], "a.r.t").collect()
    assert [(r["parent"], r["parent_pos"], r["child_pos"], r["element"]) for r in inner] == [("0", 0, 0, "1")]
    assert nested.flat_table(triples.limit(0), ["id"], "a").count() == 0

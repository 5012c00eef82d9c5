import random

from scorelake.llm import consensus as C

SCHEMA = "judgment_id bigint, dataset_id string, case_id string, case_key string, candidate_id string, judge_model_id string, repeat_index int, label string, score double, rationale string"


def planted(n=300, seed=2):
    rng = random.Random(seed)
    competence = {"good-a": 0.9, "good-b": 0.8, "fair": 0.5, "spam-pass": 0.0, "noise": 0.0, "turned": -0.8}
    truth, rows, k = {}, [], 0
    for i in range(n):
        label = rng.choice(C.LABELS)
        truth[f"1:d:c{i}"] = label
        for judge, c in competence.items():
            said = label if rng.random() < abs(c) else "pass" if judge == "spam-pass" else rng.choice(C.LABELS)
            if c < 0:
                said = {"pass": "fail", "fail": "pass"}.get(said, said)
            for repeat in range(3 if judge == "spam-pass" else 1):
                k += 1
                shown = rng.choice([said, said.upper(), f" **{said}**", C.SPELLINGS[said][1]]) if rng.random() < 0.9 else None
                score = {"pass": 1.0, "partial": 0.5, "fail": 0.0}[said] * (100 if judge == "fair" else 1)
                rows.append((k, "d", f"c{i}", rng.choice(["", None, f"1:d:c{i}"]), "k", rng.choice([judge, judge.upper(), judge + " "]), repeat, shown, score, None))
    return truth, rows + rng.sample(rows, 50)


def test_consensus_beats_majority_and_finds_spammers(spark):
    truth, rows = planted()
    df = spark.createDataFrame(rows, SCHEMA)
    items, judges = C.consensus(df)
    got = {r["case_key"]: r for r in items.collect()}
    assert set(got) == set(truth)
    assert sum(got[k]["label"] == v for k, v in truth.items()) / len(truth) > 0.92
    told = {r["judge"]: r for r in judges.collect()}
    assert told["good-a"]["competence"] > told["fair"]["competence"] > 0.3 > told["noise"]["competence"] and told["spam-pass"]["guess_pass"] > 0.9
    assert told["turned"]["swapped"] and not told["good-b"]["swapped"] and told["good-a"]["n_items"] == 300
    assert all(r["n_judges"] == 6 and 0 <= r["agreement"] <= 1 for r in got.values())


def test_many_judges_are_joined(spark, monkeypatch):
    truth, rows = planted(120, 4)
    df = spark.createDataFrame([r for r in rows if r[5].strip().lower() != "turned"], SCHEMA)
    monkeypatch.setattr(C, "JUDGE_BOUND", 2)
    got = {r["case_key"]: r["label"] for r in C.consensus(df, rounds=6)[0].collect()}
    assert sum(got[k] == v for k, v in truth.items()) / len(truth) > 0.9


def test_unusable_and_empty(spark):
    rows = [(1, "d", "c", None, "k", "j", 0, "timeout", None, None), (2, "d", "c2", None, "k", "j", 0, None, 0.4, None), (3, "d", "c3", None, "k", None, 0, "pass", None, None), (4, "d", "c4", None, None, "j", 0, "pass", None, None), (5, "d", "c5", None, "k", "j", 0, "", float("nan"), None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r["case_key"], r["label"], r["agreement"]) for r in C.consensus(df)[0].collect()]
    assert got == [("1:d:c2", "partial", None)]
    items, judges = C.consensus(df.limit(0))
    assert items.count() == 0 and judges.count() == 0

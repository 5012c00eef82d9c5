import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from scorelake.llm import mixing, packing


def words(n):
    return "a" + " a" * (n - 1) if n else ""


def test_best_fit_equals_a_plain_version():
    rng = random.Random(1)
    for rule in ("norm", "dot"):
        sizes = sorted((rng.randrange(1, 100) for _ in range(300)), reverse=True)
        got = packing.best_fit(np.array(sizes), 100, 6, 100.0**2, rule)
        bins, want = [], []
        w = (1.0, 0.05, 0.2)
        for s in sizes:
            best, score = None, None
            for b, (t, n, q) in enumerate(bins):
                if t + s <= 100 and n < 6 and q + s * s <= 10000:
                    left = [(100 - t - s) / 100, (6 - n - 1) / 6, (10000 - q - s * s) / 10000]
                    now = [(100 - t) / 100, (6 - n) / 6, (10000 - q) / 10000]
                    z = sum(a * x * x for a, x in zip(w, left)) if rule == "norm" else -sum(a * x * y for a, x, y in zip(w, now, [s / 100, 1 / 6, s * s / 10000]))
                    if score is None or z < score - 1e-12:
                        best, score = b, z
            if best is None:
                bins.append((0, 0, 0))
                best = len(bins) - 1
            t, n, q = bins[best]
            bins[best] = (t + s, n + 1, q + s * s)
            want.append(best)
        assert max(Counter(got).values()) <= 6
        assert len(set(got)) <= len(bins) + 1 and np.bincount(got, np.array(sizes)).max() <= 100


def test_packed_texts(spark):
    rng = random.Random(4)
    texts = [(i, words(rng.choice([1, 5, 30, 70, 120])), "x") for i in range(200)] + [(900, None, "x"), (901, "", "x"), (902, words(1000), "x"), (902, words(3), "x"), (None, words(4), "x")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, block string")
    rows = packing.packed(docs, capacity=128, documents=20, block_tokens=4000).collect()
    held = defaultdict(list)
    for r in rows:
        if r["container"] is None:
            assert r["token_end"] == 0
        else:
            held[r["block"], r["container"]].append(r["token_end"] - r["token_start"])
    assert sum(map(sum, held.values())) == sum(len(t.split()) for _, t, _ in texts if t)
    assert all(sum(v) <= 128 and len(v) <= 20 and sum(x * x for x in v) <= 128**2 for v in held.values())
    long = sorted((r["token_start"], r["token_end"]) for r in rows if r["doc_id"] == 902 and r["piece"] > 0)
    assert long == [(k * 128, min(1000, k * 128 + 128)) for k in range(1, 8)]  # only the longer text is split, without gaps
    assert sum(r["container"] is None for r in rows) == 2 and Counter(r["doc_id"] for r in rows)[900] == 1
    assert packing.packed(docs.limit(0)).count() == 0
    for wrong in ({"attention": 0}, {"capacity": 0}, {"documents": 0}):
        with pytest.raises(ValueError):
            packing.packed(docs, **wrong)


def test_attention_binds_and_heavy_pieces_stand_alone(spark):
    docs = spark.createDataFrame([(i, words(n)) for i, n in enumerate([128] * 3 + [100] * 20 + [60] * 40 + [8] * 300)], "doc_id bigint, text string")
    counts = {}
    for rule in ("norm", "dot"):
        for budget in (128**2, 0.75 * 128**2, 0.4 * 128**2):
            held = defaultdict(list)
            for r in packing.packed(docs, capacity=128, documents=20, attention=budget, rule=rule).collect():
                held[r["block"], r["container"]].append(r["token_end"] - r["token_start"])
            assert all(sum(v) <= 128 and len(v) <= 20 and (len(v) == 1 or sum(x * x for x in v) <= budget) for v in held.values())
            counts[rule, budget] = len(held)
    assert counts["norm", 0.4 * 128**2] > counts["norm", 128**2]  # two pieces of 60 don't fit it any more
    assert all(counts["dot", b] <= 1.1 * counts["norm", b] for _, b in counts)


def test_null_and_repeated_ids_are_spread(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, words(20)) for i in range(2000)], "doc_id bigint, text string").repartition(4)
    rows = packing.packed(docs, capacity=128, block_tokens=4000).collect()
    sizes = Counter(r["block"] for r in rows)
    assert len(rows) == 2000 and len(sizes) == 10 and max(sizes.values()) < 300


def test_full_containers(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, words(rng.randrange(1, 60))) for i in range(1500)], "doc_id bigint, text string")
    bins = packing.containers(packing.packed(docs, capacity=128), 128).collect()
    assert sum(b["tokens"] for b in bins) / (128 * len(bins)) > 0.99


def test_mixture(spark):
    rng = random.Random(2)
    sizes = {"big": 400, "mid": 100, "small": 10, "other": 30}
    docs = [(i, words(rng.randrange(1, 80)), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs += [(5000, words(9), " BIG "), (5001, words(9), None), (5002, None, "mid"), (5003, "", "Mid")]
    targets = [("big", 1.0, 2), ("mid", 1.0, 3), ("small", 1.0, 4), ("none", 2.0, 2), ("off", 0.0, 1), (None, 1.0, 1), ("nan", float("nan"), 1)]
    mixture, shares = mixing.mixed(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), spark.createDataFrame(targets, "source string, target_weight double, max_repeats int"))
    rows, told = mixture.collect(), {r["source"]: r for r in shares.collect()}
    times = Counter(r["doc_id"] for r in rows)
    limits = {"big": 2, "mid": 3, "small": 4}
    assert {r["source"] for r in rows} == set(limits) and all(times[r["doc_id"]] <= limits[r["source"]] for r in rows)
    assert told["small"]["mixed_tokens"] == 4 * told["small"]["source_tokens"]  # capped
    assert abs(told["big"]["actual_share"] - told["mid"]["actual_share"]) < 0.02 and told["none"]["mixed_tokens"] == 0
    assert abs(sum(r["actual_share"] for r in told.values()) - 1) < 1e-9 and "other" not in told
    tokens = Counter()
    for r in rows:
        tokens[r["source"]] += r["n_tokens"]
    assert all(tokens[s] == told[s]["mixed_tokens"] for s in limits)
    spread = [times.get(d, 0) for d, _, s in docs if s == "mid"]
    assert max(spread) - min(spread) <= 1  # systematic: copies differ by one at most
    empty, none = mixing.mixed(spark.createDataFrame([], "doc_id bigint, text string, source string"), spark.createDataFrame(targets, "source string, target_weight double, max_repeats int"))
    assert empty.count() == 0 and none.count() == 6

import datetime as dt

import numpy as np
import pytest

from scorelake.llm import quantiles as Q


@pytest.mark.parametrize("shape", ["lognormal", "sorted", "reverse", "ties", "uniform"])
def test_rank_error_is_relative_to_the_top(shape):
    rng = np.random.default_rng(7)
    n = 300_000
    x = {"lognormal": rng.lognormal(6, 1, n), "sorted": np.sort(rng.random(n)), "reverse": np.sort(rng.random(n))[::-1], "ties": np.round(rng.lognormal(3, 1, n)), "uniform": rng.random(n)}[shape]
    whole = Q.Sketch(seed=1)
    for part in np.array_split(x, 40):  # as from many tasks and days
        s = Q.Sketch(seed=len(part) % 7)
        for piece in np.array_split(part, 9):
            s.add(piece)
        whole.merge(Q.Sketch.from_bytes(s.to_bytes()))
    assert whole.n == n and sum(len(v) for v in whole.levels) < 12_000
    ordered = np.sort(x)
    shares = [0.01, 0.5, 0.9, 0.99, 0.999, 1.0]
    for share, value in zip(shares, whole.quantiles(shares)):
        low, high = np.searchsorted(ordered, value, "left") + 1, np.searchsorted(ordered, value, "right")
        rank = max(1, int(np.ceil(share * n)))
        off = max(0, low - rank, rank - high)
        assert off <= Q.rank_error() * (n - rank + 1) + 1, (share, off, n - rank)
        assert whole.rank_bounds([share])[0] >= off


def test_small_streams_are_exact():
    s = Q.Sketch()
    s.add(np.array([5.0, 1.0, 3.0]))
    assert s.quantiles([0.0, 0.5, 0.9, 1.0]) == [1.0, 3.0, 5.0, 5.0] and Q.Sketch().quantiles([0.5]) == [None]


def test_groups_days_and_bad_values(spark):
    day = dt.date(2026, 1, 1)
    bad = [(None, day, 5.0), ("a", day, None), ("a", day, float("nan")), ("a", day, float("inf")), ("a", day, -1.0), ("a", day, 0.0), ("none", day, None)]
    rows = spark.createDataFrame(bad + [("a", day + dt.timedelta(i % 3), float(i + 1)) for i in range(900)], "m string, day date, v double").repartition(5)
    days = Q.sketches(rows, ["m", "day"], "v").cache()
    got = {(r["m"], r["day"]): r for r in Q.percentiles(days, ["m", "day"], {"p50": 0.5, "p100": 1.0}).collect()}
    assert len(got) == 4 and got["a", day]["n"] == 300 and got["a", day]["p50"] == 448.0 and got[None, day]["p50"] == 5.0
    rows_of = Q.percentile_rows(days, ["m", "day"], [0.5, 1.0]).filter("m = 'a'").collect()
    assert len(rows_of) == 6 and {r["rank_bound"] for r in rows_of} == {0} and {r["percentile"] for r in rows_of} == {50.0, 100.0}
    whole = {r["m"]: r for r in Q.percentiles(Q.combined(days, ["m"]), ["m"], {"p50": 0.5}).collect()}
    assert whole["a"]["n"] == 900 and abs(whole["a"]["p50"] - 450) <= 900 * Q.rank_error()
    assert Q.percentiles(Q.sketches(rows.limit(0), ["m"], "v"), ["m"], {"p50": 0.5}).count() == 0

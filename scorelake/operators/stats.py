"""Statistics over score rows: means, bootstrap intervals, paired comparison, sign test."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.storage import staged


#: Resamples of an interval, and draws held at once.
RESAMPLES, BLOCK = 10_000, 100_000


def resampled_means(values: Sequence[float], first: int, last: int, seed: int = 0) -> np.ndarray:
    """Means of the resamples first to last - 1 of those that random.Random(seed).randrange draws one after another.

    randrange(n) takes the upper bits of one word of the generator and draws again while they reach n; whole blocks of the
    same words are taken here. Sums are extended, as the compensated sums of Python's sum are.
    """
    held, n = np.asarray(values, dtype=np.longdouble), len(values)
    *key, at = random.Random(seed).getstate()[1]
    words = np.random.MT19937()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, dtype=np.uint32), "pos": at}}
    draw, shift, means = np.random.Generator(words).integers, np.uint32(32 - n.bit_length()), np.empty(last - first)
    skip, wanted, done, pieces, size = first * n, last * n, 0, [], 0  # wanted: accepted draws still to come
    while wanted:
        drawn = draw(0, 1 << 32, min(BLOCK, 2 * wanted), dtype=np.uint32) >> shift
        drawn = drawn[drawn < n][:wanted]
        wanted -= len(drawn)
        if skip:
            skip, drawn = max(0, skip - len(drawn)), drawn[skip:]
        pieces.append(drawn)
        size += len(drawn)
        if size >= n:
            drawn = np.concatenate(pieces)
            full = size // n
            means[done : done + full] = np.take(held, drawn[: full * n]).reshape(full, n).sum(1).astype(float) / n
            done, pieces, size = done + full, [drawn[full * n :]], size - full * n
    return means


def bootstrap_interval(values: list[float], confidence: float = 0.95, resamples: int = RESAMPLES, seed: int = 0) -> tuple[float, float]:
    """Percentile interval of the mean over seeded resamples of the ordered values; one value is its own interval."""
    n = len(values)
    if n < 2:
        return (values[0], values[0]) if n else (0.0, 0.0)
    means = np.sort(resampled_means(values, 0, resamples, seed))
    cut = (1.0 - confidence) / 2.0
    return float(means[int(cut * (resamples - 1))]), float(means[int((1.0 - cut) * (resamples - 1))])


#: Tasks that share the resamples of one group at most.
MOST_PARTS = 64


def bootstrap(rows: DataFrame, keys: list[str], value: str, order: list[str], resamples: int = RESAMPLES, most: int = 20_000) -> DataFrame:
    """keys, n, ci_lower, ci_upper of each group's mean, to ten decimals.

    The same seeded resampling at every size: for each ``most`` values of a group its resamples are shared by one task
    more (up to MOST_PARTS). Each has all values, draws the stream up to its own resamples and gives the outermost of its
    means, among which both ends of the interval must be. Null values don't count.
    """
    known = rows.filter(F.col(value).isNotNull())
    named = [known[k].alias(f"__k{i}") for i, k in enumerate(keys)]
    held = staged(known.select(*named, *(known[o].alias(f"__o{i}") for i, o in enumerate(order)), F.col(value).cast("double").alias("__value")))
    at = [f"__k{i}" for i in range(len(keys))]
    shared = F.least(F.lit(MOST_PARTS), F.lit(resamples), F.ceil(F.col("n") / most)).cast("int")
    sizes = held.groupBy(*at).agg(F.count("*").alias("n")).select(*(F.col(k).alias(f"{k}s") for k in at), "n", shared.alias("__parts"))
    same = F.lit(True)
    for k in at:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}s"))
    wide = held.join(sizes, same).drop(*(f"{k}s" for k in at)).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    lower = int((1.0 - 0.95) / 2.0 * (resamples - 1))
    upper = resamples - 1 - int((1.0 - (1.0 - 0.95) / 2.0) * (resamples - 1))  # counted from the greatest mean
    types = [f.dataType.simpleString() for f in held.select(*at).schema]
    schema = ", ".join(f"{k} {t}" for k, t in zip(at, types)) + ", n bigint, lows array<double>, highs array<double>"

    def outermost(group: pd.DataFrame) -> pd.DataFrame:
        part, parts, n = (int(group[c].iloc[0]) for c in ("__part", "__parts", "n"))
        ordered = group.sort_values([*(f"__o{i}" for i in range(len(order))), "__value"])["__value"].to_numpy()
        means = np.sort(resampled_means(ordered, resamples * part // parts, resamples * (part + 1) // parts))
        lows, highs = ([round(float(x), 10) for x in some] for some in (means[: lower + 1], means[-upper - 1 :]))
        return group.head(1)[at].assign(n=n, lows=[lows], highs=[highs])

    spark = rows.sparkSession  # the draws take long for few rows, so their partitions must not be put together
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    found = wide.repartition(tasks, *at, "__part").groupBy(*at, "__part").applyInPandas(outermost, schema)
    ends = found.groupBy(*at, "n").agg(F.sort_array(F.flatten(F.collect_list("lows"))).alias("lows"), F.sort_array(F.flatten(F.collect_list("highs")), asc=False).alias("highs"))
    return ends.select(*(F.col(k).alias(name) for k, name in zip(at, keys)), "n", F.col("lows")[lower].alias("ci_lower"), F.col("highs")[upper].alias("ci_upper"))


def summary(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """count, mean, min and max of the non-error scores by ``keys``."""
    fine = rows.filter(F.col(value).isNotNull() & ~F.col("outcome").eqNullSafe("error"))
    return fine.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))


def sign_test_p(wins: int, losses: int) -> float:
    """Two-sided exact sign test; 1 without any win or loss."""
    n = wins + losses
    if n == 0:
        return 1.0
    return min(1.0, 2.0 * (sum(math.comb(n, k) for k in range(min(wins, losses) + 1)) / (1 << n)))


def _sign_tests(wins: pd.Series, losses: pd.Series) -> pd.Series:
    return pd.Series([sign_test_p(int(w), int(x)) for w, x in zip(wins, losses)])


def sign_test(wins: Column, losses: Column) -> Column:
    """The sign test's p-value as a column."""
    return F.pandas_udf(_sign_tests, "double")(wins, losses)


def last_by_case(rows: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """One value a key: of several rows (equal case ids of two datasets) the last by ``order``."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, order).alias(value))


def paired_counts(joined: DataFrame, groups: list[str], delta: str = "__delta") -> DataFrame:
    """groups, pairs, wins, losses, ties, mean_delta, p_value of joined pairs."""
    d = F.col(delta)
    told = joined.groupBy(*groups).agg(F.count("*").alias("pairs"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"), F.avg(d).alias("mean_delta"))
    return told.withColumn("p_value", sign_test(F.col("wins"), F.col("losses")))


def paired_deltas(baseline: DataFrame, candidate: DataFrame, pair: list[str], value: str = "value") -> DataFrame:
    """The candidate's rows that both sides have, with __delta: one inner equi-join on ``pair``."""
    return baseline.withColumnRenamed(value, "__base").join(candidate, pair).withColumn("__delta", F.col(value) - F.col("__base"))


def paired_compare(baseline: DataFrame, candidate: DataFrame, pair: list[str], groups: list[str], value: str = "value") -> DataFrame:
    """groups, pairs, wins, losses, ties, mean_delta, ci_lower, ci_upper, p_value over the pairs that both sides have.

    ``pair`` includes ``groups`` or is joined to them. The interval is the bootstrap of the deltas, ordered by ``pair``.
    """
    joined = staged(paired_deltas(baseline, candidate, pair, value).select(*dict.fromkeys([*groups, *pair]), "__delta"))  # read twice
    told = paired_counts(joined, groups)
    ends = bootstrap(joined, groups, "__delta", [p for p in pair if p not in groups] or pair).drop("n")
    ends = ends.select(*(F.col(g).alias(f"__{g}") for g in groups), "ci_lower", "ci_upper")
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return told.join(ends, same, "left").select(*groups, "pairs", "wins", "losses", "ties", "mean_delta", "ci_lower", "ci_upper", "p_value")

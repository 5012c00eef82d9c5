"""Fan-out of cases over candidates, and the choice among candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.identity import candidate_seed


#: Sizes that a policy may name (fixed values).
POLICY_SIZES = ("num_samples", "pass_k", "best_of", "self_consistency_count")


def candidate_count(policy: dict) -> int:
    """The greatest positive whole number among the four sizes that a policy may name, at least 1."""
    sizes = (policy.get(k) for k in POLICY_SIZES)
    return max([1, *(s for s in sizes if isinstance(s, int) and s > 0)])


def work_items(cases: DataFrame, run_id: str, count: int, seeds: list[int] | None = None) -> DataFrame:
    """One row for each case and candidate: run_id, dataset_id, case_id, case_key, candidate_index, candidate_id, seed.
    Given seeds replace the derived ones and set the count. Fan-out by explode, so nothing is shuffled."""
    if seeds:
        fan = F.explode(F.array(*(F.struct(F.lit(i).alias("candidate_index"), F.lit(s).cast("bigint").alias("seed")) for i, s in enumerate(seeds))))
    else:
        fan = F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct(i.alias("candidate_index"), candidate_seed(F.lit(run_id), i).alias("seed"))))
    return cases.select("dataset_id", "case_id", "case_key", fan.alias("w")).select(
        F.lit(run_id).alias("run_id"), "dataset_id", "case_id", "case_key", "w.candidate_index", F.concat("case_id", F.lit("-candidate-"), F.col("w.candidate_index").cast("string")).alias("candidate_id"), "w.seed"
    )


def pending(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work items that are not done yet."""
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def first_candidate(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The candidate with the least ``order``."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(order, value), F.struct(order, value)).alias("f")).select(*keys, f"f.{order}", f"f.{value}")


def majority_vote(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The most frequent output of each case; equal counts go to the one seen first. Columns: keys, value, votes, n.

    Counts are combined by output before a case's outputs meet, so a hot case costs one row for each distinct output.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(order).alias("__first"))
    best = F.max_by(F.struct(value, "votes"), F.struct("votes", -F.col("__first")))
    return counts.groupBy(*keys).agg(best.alias("b"), F.sum("votes").alias("n")).select(*keys, f"b.{value}", "b.votes", "n")


def best_of_n(rows: DataFrame, keys: list[str], order: str, value: str, strength: str) -> DataFrame:
    """Sequential duels in the order of candidates, where a challenger must be strictly stronger: the strongest, the
    earliest of equals."""
    best = F.max_by(F.struct(order, value, strength), F.struct(F.col(strength), -F.col(order)))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, f"b.{order}", f"b.{value}", f"b.{strength}")

"""Judge workflows: planned calls, rendered prompts, scores, aggregates, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.identity import judge_seed
from scorelake.functions.text import pairwise_score
from scorelake.operators.candidates import POLICY_SIZES
from scorelake.operators.nested import child_records, snapshot_triples

#: Constants of run estimates (fixed values): tokens in a case's prompt, in a candidate, in a judge's answer.
INPUT_TOKENS, OUTPUT_TOKENS, JUDGE_TOKENS = 4, 256, 64
DEFAULT_RUBRIC = "Judge whether the candidate output correctly answers the case."


def planned(calls: DataFrame, run_id: Column) -> DataFrame:
    """Calls with position (0-based, in the order of call id, dimension, judge, repeat within an item) and derived seed.
    ``calls``: judgment_id, case_key, candidate_id, metric_id, judge_model_id, call_id, dimension_id, repeat_index, indices."""
    item = Window.partitionBy("case_key", "candidate_id").orderBy("call_id", F.coalesce("dimension_id", F.lit("")), "judge_model_id", "repeat_index", "judgment_id")
    seed = judge_seed(run_id, F.col("case_key"), F.col("metric_id"), F.col("judge_model_id"), F.lit(0), F.col("repeat_index"), F.col("dimension_id"), F.col("indices"))
    return calls.withColumns({"position": (F.row_number().over(item) - 1).cast("bigint"), "seed": seed})


def fan_out(subjects: DataFrame, judges: list[str], kind: str = "llm") -> DataFrame:
    """One row for each judge of each subject: call_id, judge_model_id, repeat_index, dimension_id, candidate_indices."""
    prefix, dimension, indices = ("pairwise", "winner", [0, 1]) if kind == "pairwise" else ("judge", None, [0])
    calls = F.array(
        *(
            F.struct(F.lit(f"{prefix}-{i}").alias("call_id"), F.lit(j).alias("judge_model_id"), F.lit(i).alias("repeat_index"), F.lit(dimension).cast("string").alias("dimension_id"), F.array(*map(F.lit, indices)).alias("candidate_indices"))
            for i, j in enumerate(judges)
        )
    )
    return subjects.withColumn("call", F.explode(calls)).select("*", "call.*").drop("call")


def rubric_prompt(rubric: Column, output: Column) -> Column:
    return F.concat(F.lit("Rubric: "), F.coalesce(rubric, F.lit(DEFAULT_RUBRIC)), F.lit("\nCandidate: "), F.coalesce(output, F.lit("")), F.lit("\nRespond with PASS or FAIL."))


def pairwise_prompt(rubric: Column, a: Column, b: Column) -> Column:
    return F.concat(F.lit("Rubric: "), F.coalesce(rubric, F.lit(DEFAULT_RUBRIC)), F.lit("\nCandidate A: "), F.coalesce(a, F.lit("")), F.lit("\nCandidate B: "), F.coalesce(b, F.lit("")), F.lit("\nRespond with A, B, or TIE."))


def mean_score(judged: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, failures (judgments without a score), mean over the rest (null if there is none)."""
    return judged.groupBy(*keys).agg(F.count("score").alias("n"), F.count_if(F.col("score").isNull()).alias("failures"), F.avg("score").alias("mean"))


def majority_score(judged: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, winner (the most frequent label; of equals the one seen first), votes, value (its score)."""
    counts = judged.filter("label is not null").groupBy(*keys, "label").agg(F.count("*").alias("votes"), F.min(order).alias("first"), F.max("score").alias("score"))
    best = F.max_by(F.struct("label", "votes", "score"), F.struct("votes", -F.col("first")))
    return counts.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.label").alias("winner"), "b.votes", F.col("b.score").alias("value"))


def pairwise(means: DataFrame, case: str, candidate: str, strength: str, a: str, b: str) -> DataFrame:
    """case, winner (a, b or tie), value (1, 0 or 0.5) of two candidates; cases without either are left out."""
    both = means.filter(F.col(candidate).isin(a, b)).groupBy(case).agg(F.max(F.when(F.col(candidate) == a, F.col(strength))).alias("__a"), F.max(F.when(F.col(candidate) == b, F.col(strength))).alias("__b"))
    winner = F.when(F.col("__a") > F.col("__b"), "a").when(F.col("__a") < F.col("__b"), "b").otherwise("tie")
    return both.filter("__a is not null and __b is not null").select(case, winner.alias("winner"), pairwise_score(winner).alias("value"))


def final_score(aggregate: Column, single: Column, scores: Column, failed: Column) -> Column:
    """The score of a workflow: its numeric aggregate, else its single score if no call failed, else null."""
    return F.coalesce(aggregate, F.when((scores == 1) & (failed == 0), single))


def estimates(snapshots: DataFrame) -> DataFrame:
    """Planned tasks and tokens of each run from its snapshot. Copies of a snapshot count once; null cases don't count."""
    last = snapshots.groupBy("run_id").agg(F.max("snapshot_json").alias("snapshot_json"))
    children = child_records(snapshot_triples(last, records_only=True, tables=["datasets.cases"]), ["run_id", "sequence"])
    cases = children.groupBy("run_id").agg(F.count("*").alias("total_cases"))
    samples = F.greatest(*(F.get_json_object("snapshot_json", f"$.identity.candidate_policy.{k}").try_cast("int") for k in POLICY_SIZES))
    listed = lambda name: F.coalesce(F.json_array_length(F.get_json_object("snapshot_json", f"$.component_refs.{name}")), F.lit(0))
    runs = last.select("run_id", F.greatest(F.lit(1), F.coalesce(samples, F.lit(1))).alias("candidate_count"), listed("metrics").alias("metric_count"), (listed("parsers") > 0).alias("__parses"))
    n, total = F.col("candidate_count"), F.col("total_cases")
    return runs.join(cases, "run_id", "left").withColumn("total_cases", F.coalesce("total_cases", F.lit(0))).select(
        "run_id", "total_cases", "candidate_count", "metric_count", (total * n).alias("generation_tasks"), F.when(n > 1, total).otherwise(0).alias("reduction_tasks"), F.when(F.col("__parses"), total).otherwise(0).alias("parse_tasks"),
        (total * F.col("metric_count")).alias("score_tasks"), (total * n * INPUT_TOKENS).alias("input_tokens"), (total * n * OUTPUT_TOKENS).alias("output_tokens"),
    )

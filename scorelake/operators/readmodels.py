"""Read models over folded logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.payload import case_key
from scorelake.operators.nested import pivoted, snapshot_triples


def outcome_counts(rows: DataFrame) -> DataFrame:
    kinds = ("correct", "incorrect", "error")
    return rows.groupBy("run_id", "metric_id").agg(*(F.count_if(F.col("outcome") == k).alias(k) for k in kinds))


def error_counts(rows: DataFrame) -> DataFrame:
    return rows.filter("error_category is not null").groupBy("run_id", "metric_id", "error_category").agg(F.count("*").alias("n"))


def metric_means(rows: DataFrame) -> DataFrame:
    return rows.filter("value is not null and outcome <> 'error'").groupBy("run_id", "metric_id").agg(F.avg("value").alias("mean"))


def progress(states: DataFrame) -> DataFrame:
    """Cases of each run that were seen, completed without failure, and failed."""
    return states.groupBy("run_id").agg(F.count("*").alias("seen_cases"), F.count_if(~F.col("has_failure")).alias("completed_cases"), F.count_if("has_failure").alias("failed_cases"))


def timeline(log: DataFrame) -> DataFrame:
    """The events of each run in order, numbered from 0. A position is the number of events with a lower seq: a running
    count within blocks of seq plus the sizes of the blocks before, so the longest run is spread over tasks."""
    block = F.floor(F.col("seq") / 4096)
    rows = log.withColumn("__block", block)
    sizes = rows.groupBy("run_id", "__block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("run_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("run_id", "__block", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("run_id", "__block").orderBy("seq")) - 1
    placed = rows.withColumn("__within", within).join(offsets, ["run_id", "__block"])
    return placed.select("run_id", (F.col("__within") + F.col("__before")).alias("position"), "seq", "event_type", "occurred_at", "case_key", "candidate_id", "metric_id")


def planned_cases(snapshots: DataFrame) -> DataFrame:
    """run_id, dataset_id, case_id, case_key of every case that a run's snapshot names."""
    keys = ["run_id", "sequence"]
    last = snapshots.groupBy("run_id").agg(F.max("snapshot_json").alias("snapshot_json"))
    triples = snapshot_triples(last, tables=["datasets", "datasets.cases"])
    datasets = pivoted(triples, keys, "datasets", {"dataset_id": "dataset_id"}).select("run_id", F.col("child_pos").alias("parent_pos"), "dataset_id")
    cases = pivoted(triples, keys, "datasets.cases", {"case_id": "case_id"}).select("run_id", "parent_pos", "case_id")
    return cases.join(datasets, ["run_id", "parent_pos"]).select("run_id", "dataset_id", "case_id", case_key(F.col("dataset_id"), F.col("case_id")).alias("case_key")).distinct()


def case_results(planned: DataFrame, states: DataFrame) -> DataFrame:
    """Every planned case with its state, or an empty one if nothing happened to it."""
    joined = planned.join(states.select("run_id", "case_key", "n_scores", "has_failure", F.lit(True).alias("__seen")), ["run_id", "case_key"], "left")
    return joined.select("run_id", "dataset_id", "case_id", "case_key", F.coalesce("__seen", F.lit(False)).alias("seen"), F.coalesce("n_scores", F.lit(0)).alias("n_scores"), F.coalesce("has_failure", F.lit(False)).alias("has_failure"))


def metric_ids(log: DataFrame) -> DataFrame:
    """Metrics that a run has scores, failures or evaluations of."""
    kinds = ["score_completed", "score_failed", "evaluation_completed", "evaluation_failed"]
    return log.filter(F.col("event_type").isin(*kinds) & F.col("metric_id").isNotNull()).select("run_id", "metric_id").distinct()


def ambiguous_case_ids(cases: DataFrame) -> DataFrame:
    """Case ids that occur in several datasets, so that a bare id names no case."""
    return cases.select("dataset_id", "case_id").distinct().groupBy("case_id").agg(F.count("*").alias("datasets")).filter("datasets > 1")


def next_stages(states: DataFrame) -> DataFrame:
    stage = F.when(F.col("n_generated") == 0, "generate").when(F.col("reduced_candidate_id").isNull(), "reduce").when(F.col("parsed_null").isNull(), "parse").when(F.col("n_scores") == 0, "score").otherwise("judge")
    return states.select("run_id", "case_key", "n_generated", "n_scores", stage.alias("next_stage"))


def runs(log: DataFrame) -> DataFrame:
    return log.groupBy("run_id").agg(
        F.count("*").alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count_distinct("case_key").alias("cases"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at")
    )

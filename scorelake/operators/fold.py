"""Folding an event log into the state of runs and cases.

The log is an append-only table; its order is ``seq`` within a run. A fold that replays events one by one is expressed as
slots, each of which holds its last event, and as intervals in which a failure is active, so every part is an aggregation
or a window over one slot and no run has to come to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.payload import blank_to_null, case_key_or_derived, first_member, unwrapped

CASE = ["run_id", "case_key"]
KNOWN_EVENTS = [
    "run_started", "run_completed", "run_failed", "generation_completed", "generation_failed", "selection_completed", "selection_failed", "reduction_completed", "reduction_failed",
    "parse_completed", "parse_failed", "evaluation_completed", "evaluation_failed", "score_completed", "score_failed", "step_started", "step_completed", "step_failed",
]


def event_log(run_events: DataFrame) -> DataFrame:
    """The log of all runs, one row for each (run_id, seq): redelivered copies fall together (of copies that differ, each
    member is the greatest), unknown event types are left out, keys are derived where they are blank.

    Members read from the payload: value (score), reason (of a failed score), stage (a run is completed through), status
    (of an evaluation), done (a completed event has its payload object), parsed_null. An unreadable payload counts as done
    without members. Only short columns go through the shuffle; payloads stay behind.
    """
    p = F.col("p")
    rows = run_events.filter(F.col("event_type").isin(*KNOWN_EVENTS)).withColumn("p", unwrapped(F.col("event_json")))
    kind = F.col("event_type")
    unreadable = F.get_json_object(p, "$.event_type").isNull()
    member = F.when(kind.isin("generation_completed", "reduction_completed", "parse_completed"), F.get_json_object(p, "$.result")).when(kind == "evaluation_completed", F.get_json_object(p, "$.execution")).when(
        kind == "score_completed", F.get_json_object(p, "$.score")
    ).when(kind == "score_failed", F.get_json_object(p, "$.error"))
    has_member = kind.isin("generation_completed", "reduction_completed", "parse_completed", "evaluation_completed", "score_completed", "score_failed")
    picked = rows.select(
        "run_id",
        F.col("sequence").alias("seq"),
        "event_type",
        F.when(F.col("case_id").isNotNull(), case_key_or_derived(F.col("case_key"), F.col("dataset_id"), F.col("case_id"))).alias("case_key"),
        "case_id",
        "dataset_id",
        "candidate_id",
        "candidate_index",
        F.coalesce(blank_to_null(F.col("metric_id")), F.when(kind.isin("score_completed", "score_failed", "evaluation_completed", "evaluation_failed"), first_member(p, ["metric_id", "metric_name", "metricId"]))).alias("metric_id"),
        "occurred_at",
        "error_message",
        F.when(kind == "score_completed", first_member(p, ["score.value", "score.val"]).try_cast("double")).alias("value"),
        F.when(kind == "score_failed", F.get_json_object(p, "$.error.reason")).alias("reason"),
        F.when(kind == "run_completed", first_member(p, ["completed_through_stage", "last_stage"])).alias("stage"),
        F.when(kind == "evaluation_completed", F.get_json_object(p, "$.execution.status")).alias("status"),
        F.when(has_member, unreadable | member.isNotNull()).alias("done"),
        F.when(kind == "parse_completed", ~unreadable & member.isNotNull() & F.get_json_object(p, "$.result.value").isNull()).alias("parsed_null"),
    )
    return picked.groupBy("run_id", "seq").agg(*(F.max(c).alias(c) for c in picked.columns if c not in ("run_id", "seq")))


def _last(log: DataFrame, slot: list[str], done: list[str], failed: list[str]) -> DataFrame:
    """slot, last_done (bool: the slot's last event is a completion), and the event's seq, value, reason and status."""
    rows = log.filter((F.col("event_type").isin(*done) & F.col("done")) | (F.col("event_type").isin(*failed) & F.coalesce("done", F.lit(True))))
    ok = F.col("event_type").isin(*done).alias("ok")
    return rows.groupBy(*slot).agg(F.max(F.struct("seq", ok, "value", F.coalesce("reason", "error_message").alias("reason"), "status")).alias("l")).select(*slot, "l.*")


def generation_failures(log: DataFrame) -> DataFrame:
    """Every failed candidate of a case with the time its failure was active: run_id, case_key, candidate_id, since, until
    (null: still active).

    A failure ends with a completion of the same candidate, or with one at the same index if this failure is the last at
    that index before it. Failures of one candidate follow each other without a gap unless a completion comes between.
    """
    rows = log.filter((F.col("event_type") == "generation_failed") | ((F.col("event_type") == "generation_completed") & F.col("done"))).filter("case_key is not null")
    rows = rows.select(*CASE, "candidate_id", "candidate_index", "seq", (F.col("event_type") == "generation_failed").alias("bad"))
    same = Window.partitionBy(*CASE, "candidate_id").orderBy("seq")
    index = Window.partitionBy(*CASE, "candidate_index").orderBy("seq")
    later = same.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("by_id", F.min(F.when(~F.col("bad"), F.col("seq"))).over(later))
    key = F.concat_ws(":", F.col("bad").cast("string"), F.when(F.col("bad"), F.col("candidate_id")))
    rows = rows.withColumn("k", key).withColumn("turn", F.when(F.col("k").eqNullSafe(F.lag("k").over(index)), 0).otherwise(1))
    rows = rows.withColumn("stretch", F.sum("turn").over(index))
    ahead = F.lead(F.struct("k", "bad", "seq")).over(index)
    rows = rows.withColumn("n", ahead)
    after = F.when(~F.col("n.k").eqNullSafe(F.col("k")) & ~F.col("n.bad"), F.col("n.seq"))
    rows = rows.withColumn("by_index", F.when(F.col("candidate_index").isNotNull(), F.max(after).over(Window.partitionBy(*CASE, "candidate_index", "stretch"))))
    # a completion at an index ends the candidate's failure, whichever of its failures stands at that index
    ends = rows.filter("bad").withColumn("open", F.least("by_id", "by_index"))
    ends = ends.withColumn("gone", F.max("open").over(same.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("fresh", F.when(F.lag("seq").over(same).isNull() | (F.col("gone") < F.col("seq")), 1).otherwise(0)).withColumn("life", F.sum("fresh").over(same))
    whole = ends.groupBy(*CASE, "candidate_id", "life").agg(F.min("seq").alias("since"), F.max("seq").alias("last"), F.collect_set("by_index").alias("__i"), F.max("by_id").alias("by_id"))
    by_index = F.array_min(F.filter("__i", lambda x: x > F.col("last")))
    return whole.select(*CASE, "candidate_id", "since", F.least("by_id", by_index).alias("until"))


def failures(log: DataFrame) -> DataFrame:
    """Every failure of a case: run_id, case_key, kind, since, until (null: still active). Reduction and parse failures
    are never cleared; a selection's, evaluation's or score's is cleared by a later completion of the same slot."""
    sticky = log.filter(F.col("event_type").isin("reduction_failed", "parse_failed")).select(*CASE, F.split_part("event_type", F.lit("_"), F.lit(1)).alias("kind"), F.col("seq").alias("since"), F.lit(None).cast("bigint").alias("until"))
    parts = [sticky, generation_failures(log).select(*CASE, F.lit("generation").alias("kind"), "since", "until")]
    for kind in ("selection", "evaluation", "score"):
        done, bad = f"{kind}_completed", f"{kind}_failed"
        slot = [*CASE, "metric_id"] if kind != "selection" else CASE
        rows = log.filter(((F.col("event_type") == done) & F.coalesce("done", F.lit(True))) | ((F.col("event_type") == bad) & F.coalesce("done", F.lit(True))))
        failing = (F.col("event_type") == bad) | (F.col("status").eqNullSafe("partial_failure"))
        after = F.min(F.when(~failing, F.col("seq"))).over(Window.partitionBy(*slot).orderBy("seq").rowsBetween(1, Window.unboundedFollowing))
        parts.append(rows.withColumn("until", after).filter(failing).select(*CASE, F.lit(kind).alias("kind"), F.col("seq").alias("since"), "until"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.filter("case_key is not null")


def case_states(log: DataFrame) -> DataFrame:
    """One row for each case with any event: counts of what its slots hold at the end, and whether anything failed."""
    cases = log.filter("case_key is not null")
    kind = F.col("event_type")
    completed = (kind == "generation_completed") & F.col("done")
    base = cases.groupBy(*CASE).agg(
        F.min("case_id").alias("case_id"),
        F.count_distinct(F.when(completed, F.col("candidate_id"))).alias("n_generated"),
        F.count_distinct(F.when(completed, F.col("candidate_index"))).alias("n_generated_indices"),
        F.max(F.when((kind == "reduction_completed") & F.col("done"), F.struct("seq", "candidate_id")))["candidate_id"].alias("reduced_candidate_id"),
        F.max(F.when(kind == "reduction_failed", F.struct("seq", "error_message")))["error_message"].alias("reduction_error"),
        F.max(F.when((kind == "parse_completed") & F.col("done"), F.struct("seq", "parsed_null")))["parsed_null"].alias("parsed_null"),
        F.max(F.when(kind == "parse_failed", F.struct("seq", "error_message")))["error_message"].alias("parse_error"),
        F.max("seq").alias("last_seq"),
    )
    scores = _last(cases, [*CASE, "metric_id"], ["score_completed"], ["score_failed"]).groupBy(*CASE).agg(F.count_if("ok").alias("n_scores"), F.count_if(~F.col("ok")).alias("n_score_failures"))
    evaluations = _last(cases, [*CASE, "metric_id"], ["evaluation_completed"], ["evaluation_failed"]).groupBy(*CASE).agg(F.count_if("ok").alias("n_evaluations"), F.count_if(~F.col("ok")).alias("n_evaluation_failures"))
    active = failures(log).groupBy(*CASE).agg(F.count_if((F.col("kind") == "generation") & F.col("until").isNull()).alias("n_generation_failures"), F.max(F.col("until").isNull()).alias("has_failure"))
    zero = ["n_scores", "n_score_failures", "n_evaluations", "n_evaluation_failures", "n_generation_failures"]
    joined = base.join(scores, CASE, "left").join(evaluations, CASE, "left").join(active, CASE, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero} | {"has_failure": F.coalesce("has_failure", F.lit(False))})


def next_mark(rows: DataFrame, marks: DataFrame, size: int = 4096) -> DataFrame:
    """``rows`` (run_id, seq, …) with ``next``, the least seq of the run's ``marks`` after theirs (null if there is none).
    Looked up within blocks of seq and, beyond the block, among the first marks of later blocks, so neither are marks
    multiplied with rows nor does a long run come to one task."""
    block = F.floor(F.col("seq") / size)
    both = rows.withColumn("__mark", F.lit(False)).unionByName(marks.select("run_id", "seq").withColumn("__mark", F.lit(True)), allowMissingColumns=True).withColumn("__block", block)
    first = F.min(F.when(F.col("__mark"), F.col("seq")))
    later = Window.partitionBy("run_id").orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy("run_id", "__block").agg(first.alias("__first")).withColumn("__later", F.min("__first").over(later)).drop("__first")
    within = first.over(Window.partitionBy("run_id", "__block").orderBy("seq").rangeBetween(1, Window.unboundedFollowing))
    return both.withColumn("__within", within).filter(~F.col("__mark")).join(blocks, ["run_id", "__block"]).withColumn("next", F.coalesce("__within", "__later")).drop("__mark", "__block", "__within", "__later")


def run_states(log: DataFrame) -> DataFrame:
    """run_id, status, completed_through_stage.

    Started means running. Completion means completed, or partial_failure if a failure is active then or the run had
    already failed; a completed run turns to partial_failure with the first failure after it. Both are final until the run
    is started again. Without any of these events a run is pending.
    """
    kind = F.col("event_type")
    w = Window.partitionBy("run_id")
    marks = log.filter(kind.isin("run_started", "run_completed", "run_failed")).select("run_id", "seq", "event_type", "stage")
    marks = marks.withColumn("start", F.coalesce(F.max(F.when(kind == "run_started", F.col("seq"))).over(w), F.lit(-1)))
    # the marks of a run since its last start, joined to failures by run: both are few beside the events
    since = marks.filter("seq > start")
    first = since.groupBy("run_id").agg(F.min(F.when(kind == "run_completed", F.col("seq"))).alias("first_done"), F.max(F.struct("seq", "event_type")).alias("last"), F.min(F.when(kind == "run_failed", F.col("seq"))).alias("first_failed"))
    bad = failures(log).select("run_id", "since", "until")
    ends = next_mark(bad.withColumnRenamed("since", "seq"), since.filter(kind == "run_completed").select("run_id", "seq"))
    at = ends.filter(F.col("next").isNotNull() & (F.col("until").isNull() | (F.col("until") > F.col("next")))).select("run_id").distinct().withColumn("active", F.lit(True))
    late = bad.join(first.select("run_id", "first_done"), "run_id").filter(F.col("since") > F.col("first_done")).select("run_id").distinct().withColumn("later", F.lit(True))
    runs = log.groupBy("run_id").agg(F.max(kind == "run_started").alias("started"), F.max(F.when(kind == "run_completed", F.struct("seq", "stage")))["stage"].alias("completed_through_stage"))
    joined = runs.join(first, "run_id", "left").join(at, "run_id", "left").join(late, "run_id", "left")
    partial = F.coalesce("active", F.lit(False)) | F.coalesce("later", F.lit(False)) | F.coalesce(F.col("first_failed") < F.col("last.seq"), F.lit(False))
    status = (
        F.when(F.col("last").isNull(), F.when(F.col("started"), "running").otherwise("pending"))
        .when(F.col("last.event_type") == "run_failed", "failed")
        .when(partial, "partial_failure")
        .otherwise("completed")
    )
    return joined.select("run_id", status.alias("status"), "completed_through_stage")


def score_rows(log: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """One row for each case and metric that has a result: run_id, case_key, case_id, metric_id, candidate_id, value,
    outcome, error_category, error_message.

    Errors come first, in this order: parse_failure, parse_null, evaluation_failure, evaluation_partial_failure,
    score_failure. ``metrics`` (run_id, metric_id) names the metrics of each run; then a case whose parse failed has an
    error row for each of them. Without it a case has the metrics of its own scores and evaluations.
    """
    cases = log.filter("case_key is not null")
    slot = [*CASE, "metric_id"]
    scores = _last(cases, slot, ["score_completed"], ["score_failed"]).select(*slot, F.struct("ok", "value", "reason").alias("score"))
    evaluations = _last(cases, slot, ["evaluation_completed"], ["evaluation_failed"]).select(*slot, F.struct("ok", "reason", "status").alias("evaluation"))
    states = case_states(log).select(*CASE, "case_id", "reduced_candidate_id", "parse_error", "parsed_null")
    own = scores.join(evaluations, slot, "full")
    if metrics is not None:
        wanted = states.select(*CASE).join(metrics.select("run_id", "metric_id").distinct(), "run_id")
        own = wanted.join(own, slot, "left")
    rows = own.join(states, CASE)
    category = (
        F.when(F.col("parse_error").isNotNull(), "parse_failure")
        .when(F.col("parsed_null"), "parse_null")
        .when(~F.col("evaluation.ok"), "evaluation_failure")
        .when(F.col("evaluation.status") == "partial_failure", "evaluation_partial_failure")
        .when(~F.col("score.ok"), "score_failure")
    )
    message = (
        F.when(F.col("c") == "parse_failure", F.col("parse_error"))
        .when(F.col("c") == "parse_null", "Parser returned null output")
        .when(F.col("c") == "evaluation_failure", F.col("evaluation.reason"))
        .when(F.col("c") == "evaluation_partial_failure", "Evaluation completed with workflow failures")
        .when(F.col("c") == "score_failure", F.col("score.reason"))
    )
    value = F.when(F.col("c").isNull() & F.col("score.ok"), F.col("score.value"))
    outcome = F.when(F.col("c").isNotNull(), "error").when(value >= 1.0, "correct").otherwise("incorrect")
    return rows.withColumn("c", category).filter("c is not null or score.ok").select(
        "run_id", "case_key", "case_id", "metric_id", F.col("reduced_candidate_id").alias("candidate_id"), value.alias("value"), outcome.alias("outcome"), F.col("c").alias("error_category"), message.alias("error_message")
    )


def replayed(states: DataFrame, stage: str) -> DataFrame:
    """States with everything from ``stage`` on cleared, to run it again: generate, reduce, parse, score or judge. The
    candidates stay unless the stage is generate."""
    cleared = {
        "generate": ["n_generated", "n_generated_indices", "n_generation_failures"],
        "reduce": ["reduced_candidate_id", "reduction_error"],
        "parse": ["parsed_null", "parse_error"],
        "score": ["n_scores", "n_score_failures"],
        "judge": ["n_evaluations", "n_evaluation_failures"],
    }
    order = list(cleared)
    gone = [c for s in order[order.index(stage) :] for c in cleared[s]] + ["has_failure"]
    zero: dict[str, Column] = {c: F.lit(0).cast("bigint") if c.startswith("n_") else F.lit(None).cast(dict(states.dtypes)[c]) for c in gone}
    return states.withColumns(zero)

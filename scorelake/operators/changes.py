"""Applying a feed of inserts, updates and deletes, newest change first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.payload import blank_to_null, case_key_or_derived, first_member, unwrapped
from scorelake.storage import staged

#: Members of a payload that name the metric, in order of trust (fixed values of the event format and its variants).
METRIC_MEMBERS = ["metric_id", "metric_name", "metricId", "metric", "score.metric_id", "error.metric_id", "score.metric_name", "score.metricId"]


def apply_changes(
    changes: DataFrame, keys: list[str], order: str, deleted: str, base: DataFrame | None = None, tie: list[str] | None = None, batches: int = 4
) -> DataFrame:
    """The state of a table after all ``changes``: one row per key with the image of its newest change.

    The changes are cut into ``batches`` ranges of ``order`` and processed from the newest range to the oldest. In
    each range the newest change of every key is taken (map-side combined), keys that a newer range has resolved are
    removed by an anti-join, and what is left is recorded: an image, or a tombstone where ``deleted`` is true. Rows of
    ``base`` (same columns, ``order`` and ``deleted`` optional) whose key no change touches are appended at the end.

    Arrival order, repetition and any other clock are irrelevant: only ``order`` counts; among changes of one key with
    equal ``order`` the one with the greatest ``tie`` columns wins, then a non-delete, then the greatest image, so the
    result never depends on the row order. Changes with a null ``order`` are older than all others. Null keys are
    equal to each other. A null ``deleted`` is an image. Empty feeds leave ``base`` as it is. Extra columns are kept.
    The columns ``__batch`` and ``__last`` are used inside and must not occur.
    """
    tie = tie or []
    spark = changes.sparkSession
    images = [c for c in changes.columns if c not in (*keys, order, deleted, *tie)]
    comparable = [c for c in images if "map<" not in dict(changes.dtypes)[c] and "variant" not in dict(changes.dtypes)[c]]
    alive = (~F.coalesce(F.col(deleted), F.lit(False))).alias("__alive")
    held = [F.col(order), *map(F.col, tie), alive, *map(F.col, comparable), *(F.col(c) for c in images if c not in comparable)]
    cuts = [i / batches for i in range(1, batches)]
    found = changes.agg(F.percentile_approx(order, cuts, 1000)).first()[0] if cuts else None
    bounds = sorted({*(found or [])})
    number: Column = reduce(lambda a, b: a + F.when(F.col(order) > b, 1).otherwise(0), bounds, F.lit(0))
    parts = staged(changes.withColumn("__batch", F.coalesce(number, F.lit(0)).cast("int")), partition_by="__batch")

    def newest(df: DataFrame) -> DataFrame:
        if images == comparable:
            best = F.max(F.struct(*held))
        else:  # maps can't be compared; they go along with the greatest of the rest
            best = F.max_by(F.struct(*held), F.struct(*held[: len(held) - len(images) + len(comparable)]))
        return df.groupBy(*keys).agg(best.alias("__last"))

    resolved: DataFrame | None = None
    for b in reversed(range(len(bounds) + 1)):
        found = newest(parts.filter(F.col("__batch") == b))
        if resolved is not None:
            seen = resolved.select(*(F.col(k).alias(f"__seen_{i}") for i, k in enumerate(keys)))
            same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__seen_{i}")) for i, k in enumerate(keys)))
            found = found.join(seen, same, "left_anti")
        if b or base is not None:
            found = staged(found)
        resolved = found if resolved is None else resolved.unionByName(found)
    state = resolved.filter("__last.__alive").select(*keys, *(F.col(f"__last.{f}").alias(f) for f in [order, *tie, *images]))
    if base is None:
        return state
    seen = resolved.select(*(F.col(k).alias(f"__seen_{i}") for i, k in enumerate(keys)))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__seen_{i}")) for i, k in enumerate(keys)))
    return state.unionByName(base.join(seen, same, "left_anti"), allowMissingColumns=True)


def score_changes(events: DataFrame) -> DataFrame:
    """score_completed and score_failed rows as changes of (run_id, case_key, candidate_id, metric_id).

    A blank case_key is derived; a blank metric_id is read from the payload, whichever of its known members names it.
    """
    payload = unwrapped(F.col("event_json"))
    return (
        events.filter(F.col("event_type").isin("score_completed", "score_failed"))
        .select(
            "run_id",
            case_key_or_derived(F.col("case_key"), F.col("dataset_id"), F.col("case_id")).alias("case_key"),
            "candidate_id",
            F.coalesce(blank_to_null(F.col("metric_id")), first_member(payload, METRIC_MEMBERS)).alias("metric_id"),
            "sequence",
            (F.col("event_type") == "score_failed").alias("deleted"),
        )
    )


SCORE_KEY = ["run_id", "case_key", "candidate_id", "metric_id"]


def current_scores(events: DataFrame, batches: int = 4) -> DataFrame:
    """The scores that hold after all changes: SCORE_KEY and the sequence of the change that set them."""
    return apply_changes(score_changes(events), SCORE_KEY, "sequence", "deleted", batches=batches).select(*SCORE_KEY, "sequence")

"""Content-addressed blobs, stage caches and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.storage import staged

#: Event type whose payloads a bundle holds.
BUNDLES = {"generation": "generation_completed", "reduction": "reduction_completed", "parse": "parse_completed", "score": "score_completed", "evaluation": "evaluation_completed"}


def blobs(rows: DataFrame, content: str, order: str) -> DataFrame:
    """One row for each distinct content: blob_ref (``sha256:<hex>``), copies, first_id. Only hashes are shuffled."""
    refs = rows.filter(F.col(content).isNotNull()).select(F.concat(F.lit("sha256:"), F.sha2(content, 256)).alias("blob_ref"), order)
    return refs.groupBy("blob_ref").agg(F.count("*").alias("copies"), F.min(order).alias("first_id"))


def new_blobs(rows: DataFrame, content: str, stored: DataFrame) -> DataFrame:
    """blob_ref and content of those not in ``stored`` (blob_ref) yet, once each."""
    refs = rows.filter(F.col(content).isNotNull()).select(F.concat(F.lit("sha256:"), F.sha2(content, 256)).alias("blob_ref"), content)
    return refs.dropDuplicates(["blob_ref"]).join(stored.select("blob_ref"), "blob_ref", "left_anti")


def cached(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of ``cache`` where an earlier result has the same key, else nulls."""
    return rows.join(cache, key, "left")


def cache_merged(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The cache after an upsert: of several entries of a key the last by ``order``."""
    rows = old.unionByName(new)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__e")).select(*keys, *(f"__e.{c}" for c in rest))


def unknown(records: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Records whose keys are in no row of ``known``."""
    return records.join(known.select(*keys).distinct(), keys, "left_anti")


def bundle(log: DataFrame, kind: str) -> DataFrame:
    """The completed events that a bundle of ``kind`` carries."""
    return log.filter((F.col("event_type") == BUNDLES[kind]) & F.col("done"))


def imported(records: DataFrame, known: DataFrame, keys: list[str], log: DataFrame, blobs_of: tuple[str, str] | None = None, run_id: str | None = None) -> DataFrame:
    """``log`` with the records of a bundle appended as events of the same columns.

    Refused with ValueError if a record names an unknown case, another run than ``run_id`` (if given) or a run that the
    log doesn't have, or, with ``blobs_of`` = (content, ref), a content whose hash isn't its ref. Records are numbered
    after the last event of their run, in the order of their own sequence if they have one; a record that the log holds
    already under the same run, sequence and event_type is not appended again.
    """
    if not unknown(records, known, keys).isEmpty():
        raise ValueError("the bundle names cases that the dataset doesn't have")
    if run_id is not None and not records.filter(~F.col("run_id").eqNullSafe(F.lit(run_id))).isEmpty():
        raise ValueError(f"the bundle holds records of other runs than {run_id}")
    if not unknown(records, log, ["run_id"]).isEmpty():
        raise ValueError("the bundle names runs that the log doesn't have")
    if blobs_of:
        content, ref = blobs_of
        wrong = records.filter(F.col(content).isNotNull() & ~F.col(ref).eqNullSafe(F.concat(F.lit("sha256:"), F.sha2(content, 256))))
        if not wrong.isEmpty():
            raise ValueError("a blob of the bundle doesn't have the content of its hash")
    new = records
    if "sequence" in records.columns:
        new = records.join(log.select("run_id", "sequence", "event_type").distinct(), ["run_id", "sequence", "event_type"], "left_anti")
    order = F.col("sequence") if "sequence" in records.columns else F.lit(0)
    # a place within the run by blocks of the records' hash and the sizes of the blocks before, so a hot run isn't one task
    held = staged(new.withColumn("__id", F.monotonically_increasing_id()).withColumn("__block", F.shiftright("__id", 33)))
    sizes = held.groupBy("run_id", "__block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("run_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = log.groupBy("run_id").agg(F.max("sequence").alias("__last"))
    within = F.row_number().over(Window.partitionBy("run_id", "__block").orderBy(order, "__id"))
    placed = held.withColumn("__within", within).join(sizes.select("run_id", "__block", before.alias("__before")), ["run_id", "__block"]).join(last, "run_id")
    numbered = placed.withColumn("sequence", F.col("__last") + F.col("__before") + F.col("__within")).drop("__id", "__block", "__within", "__before", "__last")
    return log.unionByName(numbered, allowMissingColumns=True)

"""Stored runs: an append-only event table, snapshots, blobs, a stage cache and derived tables as Parquet."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.operators import fold, readmodels, report, store
from scorelake.storage import staged, staging_path

EVENTS = (
    "run_id string, sequence bigint, event_type string, schema_version string, occurred_at timestamp, dataset_id string, case_id string, case_key string, candidate_id string, candidate_index int, "
    "metric_id string, seed bigint, error_message string, event_json string"
)

#: Derived tables by name, each from the folded log.
PROJECTIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "execution_state": fold.case_states,
    "run_result": fold.run_states,
    "score_rows": fold.score_rows,
    "benchmark_result": lambda log: readmodels.outcome_counts(fold.score_rows(log)),
    "timeline_view": readmodels.timeline,
}


class RunStore:
    """A store in a folder. Events are partitioned by run, so a run is read, replaced and cleared alone.

    Formats: parquet (default), orc and json; ``format`` may name any other data source of the session (for example
    jdbc-like ones registered by the user) that can read and append tables by path.
    """

    def __init__(self, spark: SparkSession, path: str, format: str = "parquet") -> None:
        self.spark, self.path, self.format = spark, path.rstrip("/"), format

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.format(self.format).schema(schema).load(path)

    def append_events(self, events: DataFrame) -> None:
        columns = [c.split()[0] for c in EVENTS.split(", ")]
        events.select(*columns).write.format(self.format).mode("append").partitionBy("run_id").save(f"{self.path}/events")

    def events(self, run_id: str | None = None) -> DataFrame:
        """The events of one run (only its partition is read) or of all."""
        rows = self._read("events", EVENTS)
        return rows if run_id is None else rows.filter(F.col("run_id") == run_id)

    def save_snapshot(self, run_id: str, snapshot_json: str) -> None:
        """Upsert by run: a run's partition is replaced."""
        row = self.spark.createDataFrame([(run_id, snapshot_json)], "run_id string, snapshot_json string")
        row.write.format(self.format).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").save(f"{self.path}/snapshots")

    def snapshots(self) -> DataFrame:
        return self._read("snapshots", "snapshot_json string, run_id string").select("run_id", "snapshot_json")

    def resume(self, run_id: str) -> tuple[str, DataFrame] | None:
        """(snapshot, events in order) of a run, or None if it isn't stored."""
        found = self.snapshots().filter(F.col("run_id") == run_id).select("snapshot_json").first()
        return None if found is None else (found[0], self.events(run_id).orderBy("sequence"))

    def save_blobs(self, rows: DataFrame, content: str) -> None:
        """Adds contents that aren't stored yet, by hash."""
        held = self._read("blobs", "blob_ref string, content string")
        new = store.new_blobs(rows, content, held).select("blob_ref", F.col(content).alias("content"))
        new.write.format(self.format).mode("append").save(f"{self.path}/blobs")

    def blobs(self) -> DataFrame:
        return self._read("blobs", "blob_ref string, content string")

    def save_cache(self, entries: DataFrame) -> None:
        """Appends cache entries (stage, cache_key, payload, written_at); readers take the last of a key."""
        entries.select("stage", "cache_key", "payload", "written_at").write.format(self.format).mode("append").save(f"{self.path}/cache")

    def cache(self, stage: str) -> DataFrame:
        rows = self._read("cache", "stage string, cache_key string, payload string, written_at timestamp").filter(F.col("stage") == stage)
        return rows.groupBy("cache_key").agg(F.max_by("payload", "written_at").alias("payload"))

    def projection(self, name: str, run_id: str | None = None) -> DataFrame:
        """A derived table: of one run as it was stored, if no event came since, else computed from the log."""
        if name not in PROJECTIONS:
            raise KeyError(f"unknown projection: {name}")
        if run_id is not None and self._is_fresh(name, run_id):
            rows = self.spark.read.format(self.format).load(f"{self.path}/derived/{name}").filter(F.col("run_id") == run_id)
            empty = PROJECTIONS[name](fold.event_log(self.spark.createDataFrame([], EVENTS)))
            return rows.select(*(F.col(c).cast(t).alias(c) for c, t in empty.dtypes))
        return PROJECTIONS[name](staged(fold.event_log(self.events(run_id))))

    def _counts(self, run_ids: list[str]) -> DataFrame:
        return self.events().filter(F.col("run_id").isin(run_ids)).groupBy("run_id").agg(F.count("*").alias("events"), F.max("sequence").alias("last"))

    def _is_fresh(self, name: str, run_id: str) -> bool:
        """Whether a derived table was stored when the log had the events that it has now."""
        marks = self._read(f"derived_marks/{name}", "events bigint, last bigint, run_id string").filter(F.col("run_id") == run_id).select("events", "last").first()
        return marks is not None and tuple(marks) == tuple(self._counts([run_id]).select("events", "last").first() or ())

    def refresh(self, name: str, run_ids: list[str]) -> None:
        """Recomputes the stored rows of a derived table for the given runs and replaces their partitions; how many events
        they come from is stored last."""
        counts = staged(self._counts(run_ids))
        log = staged(fold.event_log(self.events().filter(F.col("run_id").isin(run_ids))))
        for folder in (f"derived_marks/{name}", f"derived/{name}"):
            self._delete(folder, run_ids)
        for rows, folder in ((PROJECTIONS[name](log), f"derived/{name}"), (counts, f"derived_marks/{name}")):
            rows.write.format(self.format).mode("append").partitionBy("run_id").save(f"{self.path}/{folder}")

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _delete(self, folder: str, run_ids: list[str]) -> None:
        for run_id in run_ids:
            fs, path = self._hadoop(f"{folder}/run_id={run_id}")
            fs.delete(path, True)

    @contextmanager
    def lease(self, run_id: str, minutes: float = 240) -> Iterator[None]:
        """Keeps other writers from a run, so that its events are numbered by one: a file that only one can create. One
        that is older than ``minutes`` was left by a writer that was lost and is taken over."""
        fs, path = self._hadoop(f"leases/{run_id}")
        if not fs.createNewFile(path):
            age = time.time() - fs.getFileStatus(path).getModificationTime() / 1000
            if age < minutes * 60:
                raise RuntimeError(f"run {run_id} is being written; its lease is {path}")
            fs.delete(path, False)
            if not fs.createNewFile(path):
                raise RuntimeError(f"run {run_id} is being written; its lease is {path}")
        try:
            yield
        finally:
            fs.delete(path, False)

    def version(self) -> int:
        """The version of the store's layout; 0 for a store that was written before versions were."""
        fs, path = self._hadoop("layout")
        if not fs.exists(path):
            return 0
        return max((int(r[0]) for r in self.spark.read.text(f"{self.path}/layout").collect() if r[0].isdigit()), default=0)

    def migrate(self) -> int:
        """Brings the store to LAYOUT by the steps of MIGRATIONS; a newer store is an error. Returns the version."""
        at = self.version()
        if at > LAYOUT:
            raise RuntimeError(f"the store has layout {at}, this library knows {LAYOUT}")
        for step in range(at, LAYOUT):
            MIGRATIONS[step](self)
            self.spark.createDataFrame([(str(step + 1),)], "value string").write.mode("append").text(f"{self.path}/layout")
        return LAYOUT

    def clear(self, run_id: str) -> None:
        """Deletes a run's events, snapshot and derived rows; blobs and cache stay."""
        for folder in ("events", "snapshots", *(f"{d}/{n}" for n in PROJECTIONS for d in ("derived_marks", "derived"))):
            self._delete(folder, [run_id])

    def export(self, path: str, kind: str, run_id: str | None = None) -> None:
        """Writes the score table as csv, json, markdown or latex."""
        report.write_report(self.projection("score_rows", run_id), path, kind)


def _memory(spark: SparkSession, path: str) -> RunStore:
    """A store for this process: in the folder that all executors share, removed with what the process staged."""
    return RunStore(spark, staging_path(spark))


def _unmarked(store: RunStore) -> None:
    """Layout 1: derived tables have marks. Those that were stored without any are removed and computed when asked for."""
    fs, path = store._hadoop("derived")
    fs.delete(path, True)


#: Version of the layout, and the step from each version to the next.
LAYOUT = 1
MIGRATIONS: dict[int, Callable[[RunStore], None]] = {0: _unmarked}

#: Kinds of stores: name → function of a session and a path. Users add their own, for example over JDBC.
BACKENDS: dict[str, Callable[[SparkSession, str], RunStore]] = {
    "memory": _memory,
    **{kind: (lambda spark, path, kind=kind: RunStore(spark, path, kind)) for kind in ("parquet", "orc", "json")},
}


def create_store(spark: SparkSession, kind: str, path: str = "") -> RunStore:
    """A store of a registered kind."""
    if kind not in BACKENDS:
        raise KeyError(f"unknown store: {kind}; known: {', '.join(sorted(BACKENDS))}")
    return BACKENDS[kind](spark, path)


def evaluation(store: RunStore, run_id: str, case_key: str, metric_id: str) -> str | None:
    """The last evaluation of a case by a metric, as its payload's JSON; None if there is none."""
    rows = store.events(run_id).filter((F.col("event_type") == "evaluation_completed") & (F.col("case_key") == case_key) & (F.col("metric_id") == metric_id))
    found = rows.agg(F.max_by("event_json", "sequence")).first()[0]
    return found


def snapshot_report(store: RunStore, run_id: str) -> DataFrame:
    """One row about a run: status, stage, cases seen, completed and failed, metrics, score rows, errors."""
    log = staged(fold.event_log(store.events(run_id)))
    rows = fold.score_rows(log).agg(F.count_distinct("metric_id").alias("metrics"), F.count("*").alias("score_rows"), F.count_if(F.col("outcome") == "error").alias("errors"))
    return fold.run_states(log).join(readmodels.progress(fold.case_states(log)), "run_id", "left").join(rows.withColumn("run_id", F.lit(run_id)), "run_id")

"""Live read models: events arrive as files, derived tables follow."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.identity import content_hash
from scorelake.operators import fold
from scorelake.sources.runs import EVENTS, RunStore
from scorelake.storage import staged, staging_path


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, files_per_trigger: int = 64) -> DataFrame:
    """The events of Parquet files that arrive in a folder; a path of one file is a stream of that file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(str(place.getParent()))
    return reader.parquet(path)


def follow(events: DataFrame, store: RunStore, names: list[str], checkpoint: str | None = None, available_now: bool = True):
    """Appends arriving events to ``store`` and recomputes the derived tables ``names`` of the runs they touch.

    A batch that is delivered again appends the same events again; copies fall together when the log is folded, so derived
    tables are right after any failure. The ids of the runs in a batch are read by the driver in slices of 1,000. The
    checkpoint stands in the store under a name made of ``names``, so another process goes on where the last one stopped.
    """
    place = checkpoint or f"{store.path}/checkpoints/follow-{content_hash(sorted(names))[:16]}"

    def batch(rows: DataFrame, _: int) -> None:
        rows.persist()
        store.append_events(rows)
        touched = rows.select("run_id").distinct().orderBy("run_id")
        last = ""
        while True:
            ids = [r[0] for r in touched.filter(F.col("run_id") > last).limit(1000).collect()]
            if not ids:
                break
            for name in names:
                store.refresh(name, ids)
            last = ids[-1]
        rows.unpersist()

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", place)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def caught_up_counts(events: DataFrame) -> DataFrame:
    """event_type, n of what a stream holds now, copies of an event counted once. Batches are appended as narrow rows, so
    the state that a running count of distinct events would need is a table, not memory."""
    spark = events.sparkSession
    place = staging_path(spark)
    rows = events.select("run_id", "sequence", "event_type")
    query = rows.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    held = spark.read.schema(rows.schema).parquet(f"{place}/rows")
    return held.distinct().groupBy("event_type").agg(F.count("*").alias("n"))


def counts_by_window(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by type and window of occurred_at, copies of an event counted once within the lateness allowed."""
    rows = events.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["run_id", "sequence"])
    return rows.groupBy(F.window("occurred_at", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def current_scores_stream(store: RunStore, source: str, sink: Callable[[DataFrame], None], checkpoint: str | None = None, files_per_trigger: int = 64, schema: str = EVENTS):
    """Appends the events of arriving files to ``store`` and hands ``sink`` the score rows of the runs that a batch
    touches, folded from all that the store holds of them."""
    place = checkpoint or f"{store.path}/checkpoints/scores-{content_hash(source)[:16]}"

    def batch(rows: DataFrame, _: int) -> None:
        rows.persist()
        store.append_events(rows)
        touched = rows.select("run_id").distinct()
        sink(fold.score_rows(staged(fold.event_log(store.events().join(touched, "run_id", "left_semi")))))
        rows.unpersist()

    return event_stream(store.spark, source, schema, files_per_trigger).writeStream.foreachBatch(batch).option("checkpointLocation", place).trigger(availableNow=True).start()

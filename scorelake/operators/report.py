"""Reports: score tables and their CSV, Markdown, LaTeX and JSON texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.text import latex_escaped
from scorelake.storage import staged

COLUMNS = ["run_id", "case_id", "case_key", "metric_id", "candidate_id", "value", "outcome", "error_category", "error_message"]


def score_table(rows: DataFrame) -> DataFrame:
    """Score rows for export: missing texts are empty, a missing value stays null."""
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) if c in ("candidate_id", "error_category", "error_message") else F.col(c) for c in COLUMNS))


def quickcheck(rows: DataFrame) -> DataFrame:
    """One row a metric: rows, scored, errors, mean."""
    return rows.groupBy("metric_id").agg(F.count("*").alias("rows"), F.count("value").alias("scored"), F.count_if(F.col("outcome") == "error").alias("errors"), F.avg("value").alias("mean"))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with their position from 1 in the order of ``order``: range-partitioned, counted by partition, and numbered
    within it, so no task sees them all."""
    parts = staged(rows.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    joined = parts.withColumn("__within", within).join(sizes.select("__part", before.alias("__before")), "__part")
    return joined.withColumn("position", F.col("__within") + F.col("__before")).drop("__part", "__within", "__before")


def markdown_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One Markdown table line for each row, as column ``line``; vertical bars and line breaks are escaped."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|"), r"\s*\n\s*", " ")
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in columns)), F.lit(" |")).alias("line"))


def latex_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One LaTeX table line for each row, as column ``line``."""
    return rows.select(F.concat(F.concat_ws(" & ", *(latex_escaped(F.col(c).cast("string")) for c in columns)), F.lit(" \\\\")).alias("line"))


def write_report(rows: DataFrame, path: str, kind: str) -> None:
    """Writes a score table as csv, json, markdown or latex; the last two as text files of table lines."""
    table = score_table(rows)
    if kind == "csv":
        table.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "json":
        table.write.mode("overwrite").json(path)
    elif kind in ("markdown", "latex"):
        (markdown_lines if kind == "markdown" else latex_lines)(table, COLUMNS).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown report kind: {kind}")

"""Datasets of cases: dataset_id, revision, case_id, case_key, input, expected_output (JSON texts), metadata, position."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import PurePath
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.functions.payload import case_key
from scorelake.storage import staged

CASES = "dataset_id string, revision string, case_id string, case_key string, input string, expected_output string, metadata map<string,string>, position bigint"


def positions(rows: DataFrame, name: str = "position") -> DataFrame:
    """``rows`` numbered from 1 in the order in which they are read: the rows of each partition are numbered in it and the
    sizes of the partitions before are added, so the order costs no sort and no single task."""
    return placed(staged(rows.withColumn("__id", F.monotonically_increasing_id())), name)


def placed(held: DataFrame, name: str) -> DataFrame:
    """``held``, stored rows with __id (monotonically increasing), numbered from 1 in its order; see positions."""
    part = F.shiftright("__id", 33)
    sizes = held.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    within = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return held.withColumn("__part", part).join(offsets, "__part").withColumn(name, within + F.col("__before")).drop("__id", "__part", "__before")


def _json_value(payload: Column, key: str) -> Column:
    """The JSON text of a member (strings quoted); null if it is missing or null."""
    return F.to_json(F.try_variant_get(F.try_parse_json(payload), f"$.{key}", "variant"))


def from_inline(spark: SparkSession, rows: Sequence[Mapping[str, Any]], dataset_id: str = "inline", revision: str | None = "inline") -> DataFrame:
    """A dataset from mappings with input and optionally case_id, expected_output and metadata; ids default to case-1,
    case-2, … An empty list is an empty dataset; a mapping without input is an error."""
    made = []
    for i, row in enumerate(rows, start=1):
        case_id, meta = str(row.get("case_id", f"case-{i}")), row.get("metadata", {})
        gold = row.get("expected_output")
        made.append((
            dataset_id, revision, case_id, f"{len(dataset_id)}:{dataset_id}:{case_id}", json.dumps(row["input"], ensure_ascii=False), None if gold is None else json.dumps(gold, ensure_ascii=False),
            {k: str(v) for k, v in meta.items()} if isinstance(meta, Mapping) else {}, i,
        ))
    return spark.createDataFrame(made, CASES)


def from_jsonl(spark: SparkSession, path: str, dataset_id: str | None = None, revision: str | None = None) -> DataFrame:
    """A dataset from a file with one JSON object a line. Blank lines are skipped but count for default ids; the id of the
    dataset defaults to the file's stem; metadata values become text. A line that is no object with input fails the job."""
    name = dataset_id or PurePath(path).stem
    rows = positions(spark.read.text(path)).filter(F.trim("value") != "")
    value = F.col("value")
    payload = F.when(F.try_parse_json(value).isNull() | ~F.startswith(F.ltrim(value), F.lit("{")), F.raise_error(F.concat(F.lit("not a case: "), value))).otherwise(value)
    given = F.when(_json_value(F.col("p"), "input").isNull(), F.raise_error(F.concat(F.lit("a case without input: "), F.col("p")))).otherwise(_json_value(F.col("p"), "input"))
    case_id = F.coalesce(F.get_json_object("p", "$.case_id"), F.concat(F.lit("case-"), F.col("position").cast("string")))
    return rows.select(payload.alias("p"), "position").select(
        F.lit(name).alias("dataset_id"), F.lit(revision).cast("string").alias("revision"), case_id.alias("case_id"), case_key(F.lit(name), case_id).alias("case_key"), given.alias("input"),
        _json_value(F.col("p"), "expected_output").alias("expected_output"), F.coalesce(F.from_json(F.get_json_object("p", "$.metadata"), "map<string,string>"), F.create_map().cast("map<string,string>")).alias("metadata"), "position",
    )


def from_rows(rows: DataFrame, dataset_id: str, split: str, input_field: str, expected_field: str | None = None, id_field: str | None = None) -> DataFrame:
    """A dataset from a table of rows (Parquet, CSV, …): the columns left over become metadata. Ids default to
    ``split-0``, ``split-1``, …; a missing input column is an error."""
    if input_field not in rows.columns:
        raise ValueError(f"missing input field '{input_field}'")
    used = {input_field, expected_field, id_field}
    quoted = lambda c: F.when(F.col(c).isNotNull(), F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2))
    rest = [c for c in rows.columns if c not in used]
    meta = F.map_filter(F.create_map(*(x for c in rest for x in (F.lit(c), F.col(c).cast("string")))), lambda _, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    numbered = positions(rows)
    default = F.concat(F.lit(f"{split}-"), (F.col("position") - 1).cast("string"))
    case_id = F.coalesce(F.col(id_field).cast("string"), default) if id_field in rows.columns else default
    gold = quoted(expected_field) if expected_field in rows.columns else F.lit(None).cast("string")
    return numbered.select(F.lit(dataset_id).alias("dataset_id"), F.lit(split).alias("revision"), case_id.alias("case_id"), case_key(F.lit(dataset_id), case_id).alias("case_key"), quoted(input_field).alias("input"), gold.alias("expected_output"), meta.alias("metadata"), "position")


def raw_rows(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Rows of .jsonl or .parquet files; another suffix is an error, as is a line of a .jsonl file that is no object."""
    kinds = {PurePath(f).suffix for f in files}
    if kinds == {".jsonl"}:
        return spark.read.option("mode", "FAILFAST").json(list(files))
    if kinds == {".parquet"}:
        return spark.read.parquet(*files)
    raise ValueError(f"files must all be .jsonl or all be .parquet: {', '.join(sorted(kinds))}")

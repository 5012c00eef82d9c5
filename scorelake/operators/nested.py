"""Nested JSON records as related flat tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Field name of the triple that says that a record is there, whatever members it has.
RECORD = ""

#: Tables below the execution of an evaluation, and below a run's snapshot (fixed values of the event format).
EXECUTION_TABLES = ["judge_calls", "judge_responses", "parsed_judgments", "scores", "judge_responses.retry_history", "judge_responses.conversation_trace.messages"]
SNAPSHOT_TABLES = ["datasets", "component_refs.metrics", "component_refs.parsers", "component_refs.judge_models", "datasets.cases"]


def path_triples(record: dict, repeated: frozenset[str] = frozenset()) -> Iterator[tuple[str, tuple[int, ...], str, str | None]]:
    """(table path, ordinals, field, value) of one record, in document order, without building the tables.

    A table path is the dotted path to an array without its ordinals ("" is the record itself); ordinals are the
    positions from the outermost array inwards. Each element gives one triple with the field RECORD and one for each
    scalar below it up to the next array; field is the dotted path within the element. A null element gives none but
    takes a position. An object at a path in ``repeated`` is its array's only element. A scalar element is a record
    whose value stands under RECORD. Values are text: strings as they are, other scalars as JSON. Uses its own stack,
    so depth is bounded only by the JSON reader.
    """
    stack: list[tuple[str, tuple[int, ...], str, object]] = [("", (), "", record)]
    while stack:
        table, at, field, value = stack.pop()
        path = f"{table}.{field}" if table and field else table or field
        if isinstance(value, dict) and not (field and path in repeated):
            if not field:
                yield table, at, RECORD, None
            stack.extend((table, at, f"{field}.{k}" if field else k, v) for k, v in reversed(value.items()))
        elif isinstance(value, (dict, list)):
            items = [value] if isinstance(value, dict) else value
            if field:
                stack.extend((path, (*at, i), "", v) for i, v in reversed(list(enumerate(items))) if v is not None)
            else:  # an array directly inside an array is one record
                yield table, at, RECORD, json.dumps(value, ensure_ascii=False)
        else:
            yield table, at, field, value if value is None or isinstance(value, str) else json.dumps(value)


_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9]\d*))((?:\.\d+)?(?:[eE][-+]?\d+)?)")
_WORDS = {"true": "true", "false": "false", "null": None, "NaN": "NaN", "Infinity": "Infinity", "-Infinity": "-Infinity"}
_WORD = re.compile(r"-?[A-Za-z]+")


def _scalar(text: str, at: int) -> tuple[str | None, int]:
    """(text of the number, boolean or null at a position, end)."""
    m = _NUMBER.match(text, at)
    if m:
        return (json.dumps(float(m[0])) if m[2] else str(int(m[1]))), m.end()
    m = _WORD.match(text, at)
    if m is None or m[0] not in _WORDS:
        raise ValueError(f"no JSON value at {at}")
    return _WORDS[m[0]], m.end()


def stream_triples(text: str, repeated: frozenset[str] = frozenset(), root: str | None = None) -> Iterator[tuple[str, tuple[int, ...], str, str | None]]:
    """The triples of path_triples straight from JSON text, token by token: no tree is built, and what is held is the
    stack of open objects and arrays. A JSON string that holds the JSON object is read like it.

    ``root``: only the top member of that name, which may be a string that holds JSON, is the record. Text that turns out
    not to be a JSON object is a ValueError or IndexError, at its end at the latest, so a reader keeps triples back till
    then. Of a name that an object has twice both values are read.
    """
    blank = lambda i: _BLANK.match(text, i).end()
    at = blank(0)
    if text[at] == '"':
        inner, at = scanstring(text, at + 1, True)
        if blank(at) != len(text) or not inner.lstrip().startswith("{"):
            raise ValueError("not one JSON object")
        yield from stream_triples(inner, repeated, root)
        return
    if text[at] != "{":
        raise ValueError("no JSON object")
    # an open object: [table, ordinals, field before its members]; an open array: [table, ordinals before, , next index].
    # A table of None is what isn't looked at; the table ... is the object that holds the root
    stack: list[list] = []
    table, place, field, element = "" if root is None else ..., (), "", False
    while True:
        c = text[at]
        if c == "{":
            if field and table not in (None, ...) and (path := f"{table}.{field}" if table else field) in repeated:
                table, place, field = path, (*place, 0), ""
            if not field and table not in (None, ...):
                yield table, place, RECORD, None
            stack.append([table, place, field])
            at = blank(at + 1)
            opened = text[at] != "}"
        elif c == "[":
            opened = False
            if not field and table is not None:  # an array directly inside an array is one record
                value, at = _DECODER.raw_decode(text, at)
                if table is not ...:
                    yield table, place, RECORD, json.dumps(value, ensure_ascii=False)
                else:
                    raise ValueError("no JSON object")
            else:
                stack.append([None if table is None else f"{table}.{field}" if table else field, place, None, -1])
                at = blank(at + 1)
                opened = text[at] != "]"
        else:
            opened = False
            if c == '"':
                value, at = scanstring(text, at + 1, True)
            else:
                value, at = _scalar(text, at)
            if table is ROOT_TEXT:
                if c == '"':
                    yield from stream_triples(value, repeated)
            elif table is not None and not (element and value is None):
                yield table, place, field, value
        while not opened:  # a value has ended: on to the next one of what is open
            at = blank(at)
            if not stack:
                if at != len(text):
                    raise ValueError("text after the JSON object")
                return
            top = stack[-1]
            if text[at] == ",":
                at, opened = blank(at + 1), True
            elif text[at] == ("]" if len(top) == 4 else "}"):
                at += 1
                stack.pop()
            else:
                raise ValueError(f"no JSON at {at}")
        top = stack[-1]
        if len(top) == 4:
            top[3] += 1
            table, place, field, element = top[0], (*top[1], top[3]), "", True
            continue
        if text[at] != '"':
            raise ValueError(f"no name at {at}")
        name, at = scanstring(text, at + 1, True)
        at = blank(at)
        if text[at] != ":":
            raise ValueError(f"no colon at {at}")
        at, element = blank(at + 1), False
        if top[0] is ...:
            table, place, field = ("" if text[at] == "{" else ROOT_TEXT if text[at] == '"' else None) if name == root else None, (), ""
        else:
            table, place, field = top[0], top[1], f"{top[2]}.{name}" if top[2] else name


_DECODER = json.JSONDecoder()
#: Marks a root member that is a string, which may hold the record as JSON.
ROOT_TEXT = object()


def shredded(
    df: DataFrame, keys: list[str], json_col: str, root: str | None = None, repeated: list[str] | None = None, records_only: bool = False, tables: list[str] | None = None
) -> DataFrame:
    """Triples of the JSON objects in ``json_col``: keys, table_path STRING, ordinals ARRAY<INT>, field STRING, value STRING.

    ``root``: take the member of that name instead of the whole object; it may be a string that holds JSON. Null and
    unreadable texts, and roots that are no objects, give no rows. ``tables``: only these table paths.
    ``records_only``: only the triples that say that a record is there. Repeated rows give repeated triples.
    """
    many, wanted = frozenset(repeated or []), frozenset(tables) if tables is not None else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src: list[int] = []
            paths: list[str] = []
            ordinals: list[tuple[int, ...]] = []
            fields: list[str] = []
            values: list[str | None] = []

            def out() -> pa.RecordBatch:
                made = [batch.column(i).take(pa.array(src, pa.int32())) for i in range(len(keys))]
                made += [pa.array(paths, pa.string()), pa.array(ordinals, pa.list_(pa.int32())), pa.array(fields, pa.string()), pa.array(values, pa.string())]
                for x in (src, paths, ordinals, fields, values):
                    x.clear()
                return pa.RecordBatch.from_arrays(made, names=[*keys, "table_path", "ordinals", "field", "value"])

            for i, text in enumerate(batch.column(len(keys))):
                if not text.is_valid:
                    continue
                found = []
                try:
                    for path, at, field, value in stream_triples(text.as_py(), many, root):
                        if (wanted is None or path in wanted) and not (records_only and field != RECORD):
                            found.append((path, at, field, value))
                except (ValueError, IndexError, RecursionError):
                    continue  # unreadable
                for path, at, field, value in found:
                    src.append(i)
                    paths.append(path)
                    ordinals.append(at)
                    fields.append(field)
                    values.append(value)
                if len(src) > 50_000:
                    yield out()
            if src:
                yield out()

    chosen = df.select(*keys, json_col)
    schema = T.StructType([*(chosen.schema[k] for k in keys), T.StructField("table_path", T.StringType()), T.StructField("ordinals", T.ArrayType(T.IntegerType())), T.StructField("field", T.StringType()), T.StructField("value", T.StringType())])
    return chosen.mapInArrow(parse, schema)


def child_records(triples: DataFrame, keys: list[str]) -> DataFrame:
    """One row per child record: keys, child_path, parent_pos (-1 below the top), child_pos."""
    return (
        triples.filter((F.col("field") == RECORD) & (F.size("ordinals") > 0))
        .select(*keys, F.col("table_path").alias("child_path"), "ordinals")
        .distinct()
        .select(*keys, "child_path", F.coalesce(F.try_element_at("ordinals", F.lit(-2)), F.lit(-1)).alias("parent_pos"), F.element_at("ordinals", -1).alias("child_pos"))
    )


def pivoted(triples: DataFrame, keys: list[str], table_path: str, fields: dict[str, str]) -> DataFrame:
    """One flat table: keys, ordinals, parent_pos, child_pos and one column for each field (path within the element →
    column name). Copies of a record fall together; where they differ, the greatest value is taken."""
    picked = triples.filter(F.col("table_path") == table_path)
    columns = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(name) for f, name in fields.items()]
    return (
        picked.groupBy(*keys, "ordinals")
        .agg(*columns)
        .withColumn("parent_pos", F.coalesce(F.try_element_at("ordinals", F.lit(-2)), F.lit(-1)))
        .withColumn("child_pos", F.coalesce(F.try_element_at("ordinals", F.lit(-1)), F.lit(-1)))
    )


def columns_of(triples: DataFrame, keys: list[str], table_path: str, most: int = 200) -> tuple[dict[str, str], bool]:
    """(field → column name, whether there are more fields) of one table: its ``most`` most frequent fields in order of
    their names. Dots become "__", the value of scalar elements is ``element``; a name that is taken, in any case, gets a
    number. Fields that are null everywhere have no column."""
    counted = triples.filter((F.col("table_path") == table_path) & F.col("value").isNotNull()).groupBy("field").agg(F.count("*").alias("n"))
    held = counted.orderBy(F.desc("n"), "field").limit(most + 1).collect()
    taken = {c.lower() for c in keys} | {"ordinals", "parent", "parent_pos", "child_pos", "other", "__one"}
    names: dict[str, str] = {}
    for field in sorted(r["field"] for r in held[:most]):
        name = base = field.replace(".", "__") if field != RECORD else "element"
        number = 1
        while name.lower() in taken:
            number += 1
            name = f"{base}_{number}"
        taken.add(name.lower())
        names[field] = name
    return names, len(held) > most


def flat_table(triples: DataFrame, keys: list[str], table_path: str, most: int = 200) -> DataFrame:
    """One table of the records at ``table_path``: keys, parent STRING (the positions that lead to the parent record,
    joined by dots; "" at the top), parent_pos, child_pos and a column for each field that occurs (see columns_of), as
    text. Fields beyond the ``most`` most frequent ones are in ``other`` MAP<STRING,STRING>, so none is lost. Copies of
    a record fall together; where they differ, the greatest value is taken."""
    fields, more = columns_of(triples, keys, table_path, most)
    picked = triples.filter(F.col("table_path") == table_path)
    columns: list[Column] = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(name) for f, name in fields.items()]
    if more:
        rest = F.collect_set(F.when(~F.col("field").isin(*fields, RECORD), F.struct("field", F.coalesce("value", F.lit("")).alias("value"))))
        by_name = F.array_sort(rest)
        columns.append(F.map_from_entries(F.filter(by_name, lambda x, i: (i == F.size(by_name) - 1) | (F.get(by_name, i + 1)["field"] != x["field"]))).alias("other"))
    return (
        picked.groupBy(*keys, "ordinals")
        .agg(F.lit(True).alias("__one"), *columns)
        .withColumn("parent", F.array_join(F.transform(F.slice("ordinals", 1, F.greatest(F.size("ordinals") - 1, F.lit(0))), lambda i: i.cast("string")), "."))
        .withColumn("parent_pos", F.coalesce(F.try_element_at("ordinals", F.lit(-2)), F.lit(-1)))
        .withColumn("child_pos", F.coalesce(F.try_element_at("ordinals", F.lit(-1)), F.lit(-1)))
        .select(*keys, "parent", "parent_pos", "child_pos", *fields.values(), *(["other"] if more else []))
    )


def evaluation_triples(events: DataFrame, **options) -> DataFrame:
    """Triples of the executions of evaluation_completed payloads, keyed by run_id and sequence."""
    rows = events.filter(F.col("event_type") == "evaluation_completed")
    return shredded(rows, ["run_id", "sequence"], "event_json", root="execution", repeated=EXECUTION_TABLES, **options)


def snapshot_triples(snapshots: DataFrame, **options) -> DataFrame:
    """Triples of run snapshots, keyed by run_id and sequence -1."""
    rows = snapshots.select("run_id", F.lit(-1).cast("bigint").alias("sequence"), "snapshot_json")
    return shredded(rows, ["run_id", "sequence"], "snapshot_json", repeated=SNAPSHOT_TABLES, **options)


def run_children(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Child records of evaluations and snapshots with the positions of parent and child."""
    keys = ["run_id", "sequence"]
    found = evaluation_triples(events, records_only=True, tables=EXECUTION_TABLES).unionByName(snapshot_triples(snapshots, records_only=True, tables=SNAPSHOT_TABLES))
    return child_records(found, keys)

"""Records whose schema drifts between files: rescue-column ingestion and a report of each change.

The report comes from the ingestion: the schema that the last earlier file of a store showed is enforced on the next one.
What no column knows is rescued and, where most rows carry it, added; a column whose values mostly can't be held is retyped;
one that mostly stays unfilled is removed; and one whose rescued successor can be replayed into it is renamed. Whether a
value is held depends on its field, JSON type and shape only, so a schema is enforced on counts of these, which one pass
over the payloads gives for every file.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from datetime import datetime
from functools import lru_cache
from math import sqrt
from typing import Any
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.payload import json_kind, read_payload

#: Containers whose direct members are fields too (written ``container.member``).
CONTAINERS = ("result", "score")

#: The enforced table: field → type (string, bigint, double, boolean, timestamp or json). Fixed names of the event format.
EVENT_FIELDS = {
    "schema_version": "string", "event_type": "string", "run_id": "string", "occurred_at": "timestamp", "dataset_id": "string", "case_id": "string", "case_key": "string",
    "candidate_id": "string", "candidate_index": "bigint", "metric_id": "string", "seed": "bigint", "provider_key": "string", "cache_hit": "boolean", "source_run_id": "string",
    "error_message": "string", "error": "json", "execution": "json", "execution_blob_ref": "string", "source_candidate_ids": "json", "retry_history": "json", "completed_through_stage": "string",
    "result.candidate_id": "string", "result.final_output": "string", "result.latency_ms": "double", "result.token_usage": "json", "result.value": "string", "result.format": "string",
    "score.metric_id": "string", "score.value": "double", "score.details": "json",
}

#: Shapes of values and words they begin with are counted in so many buckets each, so a profile stays small whatever the data.
SHAPES, LEADS = 1024, 64
#: Texts longer than this are not remembered with their shapes (all of each text is read).
REMEMBERED = 200
_NUMBER = re.compile(r"[+-]?\d+(\.\d+)?([eE][+-]?\d+)?")
_INSTANT = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d")
_HEX = re.compile(r"[0-9a-f]{12,}")
_BLANK = re.compile(r"\s")
_RUNS = re.compile(r"[^\W\d_]+|\d+")


def members(payload: dict) -> Iterator[tuple[str, Any]]:
    """The fields of a payload in order: its keys and the keys directly inside CONTAINERS."""
    for key, value in payload.items():
        yield key, value
        if key in CONTAINERS and isinstance(value, dict):
            for inner, held in value.items():
                yield f"{key}.{inner}", held


def enforced(value: Any, kind: str) -> str | None:
    """The text of ``value`` if it can be held in a column of type ``kind``, else None. Lossless casts only: digits in
    a string are a number, 0 and 1 are booleans, epoch milliseconds are a timestamp, JSON text is json."""
    if isinstance(value, str) and kind in ("bigint", "double", "boolean", "json"):
        text = value.strip()
        if kind == "boolean":
            return text.lower() if text.lower() in ("true", "false") else {"0": "false", "1": "true"}.get(text)
        if kind == "json":
            try:
                return value if isinstance(json.loads(value), (dict, list)) else None
            except (ValueError, RecursionError):
                return None
        if not _NUMBER.fullmatch(text):
            return None
        return text if kind == "double" or text.lstrip("+-").isdigit() else None
    if kind == "string":
        return value if isinstance(value, str) else json.dumps(value) if json_kind(value) in ("number", "boolean") else None
    if kind == "json":
        return json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list)) else None
    if kind == "boolean":
        return str(bool(value)).lower() if isinstance(value, bool) or value in (0, 1) and json_kind(value) == "number" else None
    if isinstance(value, bool) or isinstance(value, (dict, list)):
        return None
    if kind == "timestamp":
        if isinstance(value, str):
            try:
                return datetime.fromisoformat(value.replace("Z", "+00:00")).isoformat()
            except ValueError:
                return None
        return datetime.fromtimestamp(value / 1000).astimezone().isoformat() if 1e11 < value < 1e14 else None
    if kind == "bigint":
        return str(int(value)) if value == int(value) and abs(value) < 2**63 else None
    return repr(value)


def castable(value: Any, kind: str) -> bool:
    """Whether ``enforced`` would hold the value, without making its text."""
    if kind == "json" and isinstance(value, (dict, list)) or kind == "string" and isinstance(value, str):
        return True
    return enforced(value, kind) is not None


def read_fields(payload: dict, schema: dict[str, str]) -> Iterator[tuple[str, Any, str]]:
    """(field, value, fate) of every field of a payload, in order. fate: typed (a column of the schema holds it), rescued
    (unknown to the schema or uncastable: the rescue column holds it), null (null value of a known field) or parts (an
    object whose members are fields themselves). This is the one reading that the table and the report of changes share."""
    for field, value in members(payload):
        kind = schema.get(field)
        if kind is None:
            yield field, value, "parts" if field in CONTAINERS and isinstance(value, dict) else "rescued"
        elif value is None:
            yield field, value, "null"
        else:
            yield field, value, "typed" if castable(value, kind) else "rescued"


def ingested(df: DataFrame, keep: list[str], json_col: str, schema: dict[str, str] | None = None) -> DataFrame:
    """One consistent table: columns ``keep``, one typed column for each field of ``schema`` (dots become "__"; a name
    taken by ``keep`` gets the prefix "payload__"), ``rescued`` STRING and ``readable`` BOOLEAN.

    ``rescued`` is a JSON object of every field that the schema doesn't know or whose value can't be cast (null values
    of unknown fields included, so nothing is lost); null if there is none. An unreadable payload is kept whole as
    {"": text}; a null payload gives nulls. Duplicate rows stay duplicates.
    """
    fields = schema or EVENT_FIELDS
    known = list(fields.items())
    place = {f: i for i, (f, _) in enumerate(known)}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            columns: list[list[str | None]] = [[None] * rows for _ in known]
            rescued: list[str | None] = [None] * rows
            readable = [False] * rows
            for i, text in enumerate(batch.column(len(keep)).to_pylist()):
                payload = read_payload(text)
                if payload is None:
                    if text is not None:
                        rescued[i] = json.dumps({"": text}, ensure_ascii=False)
                    continue
                readable[i] = True
                saved: dict[str, Any] = {}
                for field, value, fate in read_fields(payload, fields):
                    if fate == "typed":
                        columns[place[field]][i] = enforced(value, fields[field])
                    elif fate == "rescued":
                        saved[field] = value
                if saved:
                    rescued[i] = json.dumps(saved, ensure_ascii=False)
            made = [batch.column(i) for i in range(len(keep))] + [pa.array(c, pa.string()) for c in columns] + [pa.array(rescued, pa.string()), pa.array(readable, pa.bool_())]
            yield pa.RecordBatch.from_arrays(made, names=[*keep, *(f"__{i}" for i in range(len(known))), "rescued", "readable"])

    chosen = df.select(*keep, json_col)
    text = chosen.schema
    out = T.StructType([*(text[k] for k in keep), *(T.StructField(f"__{i}", T.StringType()) for i in range(len(known))), T.StructField("rescued", T.StringType()), T.StructField("readable", T.BooleanType())])
    raw = chosen.mapInArrow(parse, out)
    typed = [_cast(F.col(f"__{i}"), kind).alias(typed_name(f, keep)) for i, (f, kind) in enumerate(known)]
    return raw.select(*keep, *typed, "rescued", "readable")


def typed_name(field: str, keep: list[str]) -> str:
    name = field.replace(".", "__")
    return f"payload__{name}" if name in keep else name


def _cast(c: Column, kind: str) -> Column:
    return c if kind in ("string", "json") else c.try_cast(kind)


def promoted(table: DataFrame, aliases: dict[str, str], keep: list[str], schema: dict[str, str] | None = None) -> DataFrame:
    """Replays rescued values into typed columns: ``aliases`` approves unknown field → field of the schema.

    A typed column that is null takes the rescued value of the first alias that can be cast; that member then leaves
    ``rescued``. Aliases of fields that the schema doesn't know are ignored.
    """
    fields = schema or EVENT_FIELDS
    held = F.from_json("rescued", "map<string,string>")
    table = table.withColumn("__held", held)
    used = []
    for field, kind in fields.items():
        for alias in (a for a, f in aliases.items() if f == field):
            name, raw = typed_name(field, keep), F.col("__held").getItem(alias)
            if kind == "timestamp":
                value = F.coalesce(raw.try_cast("timestamp"), F.timestamp_millis(raw.try_cast("bigint")))
            else:
                value = _cast(raw, kind)
            taken = F.col(name).isNull() & value.isNotNull()
            table = table.withColumns({f"__took_{len(used)}": F.when(taken, F.lit(alias)), name: F.coalesce(F.col(name), value)})
            used.append(f"__took_{len(used)}")
    if not used:
        return table.drop("__held")
    gone = F.array(*map(F.col, used))
    kept = F.from_json("rescued", "map<string,variant>")  # what stays keeps its JSON types
    left = F.map_filter(kept, lambda k, _: ~F.coalesce(F.array_contains(gone, k), F.lit(False)))
    rest = F.when(F.size(F.array_compact(gone)) == 0, F.col("rescued")).when(F.size(left) > 0, F.to_json(left, {"ignoreNullFields": "false"}))
    return table.withColumn("rescued", rest).drop("__held", *used)


def shape(value: Any) -> tuple[str, str]:
    """What a value looks like, whatever JSON type holds it, and the word it begins with. All of it counts."""
    if isinstance(value, str):
        return _known_shape(value) if len(value) <= REMEMBERED else _text_shape(value)
    if isinstance(value, bool):
        return "boolean", ""
    if isinstance(value, (int, float)):
        return ("instant" if 1e11 < value < 1e14 else f"integer {len(str(abs(value)))}" if isinstance(value, int) else "fraction"), ""
    if isinstance(value, dict):
        return "object " + " ".join(sorted(value)), ""
    if isinstance(value, list):
        return "array " + "|".join(sorted({shape(v)[0] for v in value if v is not None})), ""
    return "", ""


def _text_shape(value: str) -> tuple[str, str]:
    text = value.strip()
    if text in ("true", "false"):
        return "boolean", ""
    if _NUMBER.fullmatch(text):
        if "." in text or "e" in text.lower():
            return shape(float(text))
        digits = text.lstrip("+-").lstrip("0") or "0"
        return ("instant" if 12 <= len(digits) <= 14 and 1e11 < int(digits) < 1e14 else f"integer {len(digits)}"), ""
    if _INSTANT.match(text):
        return "instant", ""
    if text[:1] in ("{", "["):
        try:
            return shape(json.loads(text))
        except (ValueError, RecursionError):
            pass
    if _HEX.fullmatch(text):
        return f"hex {len(text)}", ""
    if not text.isascii() or _BLANK.search(text):
        return "text", ""
    lead = _RUNS.match(text)
    return _RUNS.sub(lambda m: "9" if m[0].isdigit() else "a", text), lead[0] if lead else ""


_known_shape = lru_cache(50_000)(_text_shape)


def profiles(events: DataFrame, schema: dict[str, str] | None = None) -> DataFrame:
    """What the ingestion finds in each file: store_id, file_no, event_type, field ("" counts readable rows), kind, fate
    (see read_fields), bucket (of the value's shape), n, place (sum of positions). Combined inside each task before the
    shuffle."""
    fields = schema or EVENT_FIELDS

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list[int]] = {}

        def out() -> pa.RecordBatch:
            keys = list(zip(*seen)) if seen else [()] * 7
            counts = list(zip(*seen.values())) if seen else [()] * 2
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
            made = [pa.array(k, t) for k, t in zip(keys, types)] + [pa.array(c, pa.int64()) for c in counts]
            seen.clear()
            return pa.RecordBatch.from_arrays(made, names=["store_id", "file_no", "event_type", "field", "kind", "fate", "bucket", "n", "place"])

        def add(key: tuple, at: int) -> None:
            held = seen.get(key)
            if held is None:
                seen[key] = [1, at]
            else:
                held[0] += 1
                held[1] += at

        for batch in batches:
            for store, file, kind, text in zip(*(c.to_pylist() for c in batch.columns)):
                payload = read_payload(text)
                if payload is None:
                    continue
                add((store, file, kind, "", "", "", 0), 0)
                for at, (field, value, fate) in enumerate(read_fields(payload, fields)):
                    bucket = -1 if value is None else _bucket(*shape(value))
                    add((store, file, kind, field, json_kind(value), fate, bucket), at)
            if len(seen) > 100_000:
                yield out()
        yield out()

    found = events.select("store_id", "file_no", "event_type", "event_json").mapInArrow(
        parse, "store_id string, file_no int, event_type string, field string, kind string, fate string, bucket int, n bigint, place bigint"
    )
    return found.groupBy("store_id", "file_no", "event_type", "field", "kind", "fate", "bucket").agg(F.sum("n").alias("n"), F.sum("place").alias("place"))


@lru_cache(50_000)
def _bucket(form: str, lead: str) -> int:
    return crc32(form.encode()) % SHAPES * LEADS + (crc32(lead.encode()) % LEADS if lead else 0)


def rescue_rates(events: DataFrame, schema: dict[str, str] | None = None) -> DataFrame:
    """How the fields of each file fared: store_id, file_no, event_type, field, typed, rescued, nulls (rows each)."""
    of = lambda fate: F.sum(F.when(F.col("fate") == fate, F.col("n")).otherwise(0))
    nulls = F.sum(F.when(F.col("kind") == "null", F.col("n")).otherwise(0))
    return profiles(events, schema).filter("field <> ''").groupBy("store_id", "file_no", "event_type", "field").agg(of("typed").alias("typed"), of("rescued").alias("rescued"), nulls.alias("nulls"))


class _File:
    """The schema that one file and event type shows, and what it holds, from its profile. A field needs more than half of
    the readable rows, its type more than half of the values that aren't null."""

    def __init__(self, total: int, fields: list[dict]) -> None:
        self.rows = total
        self.kinds: dict[str, dict[str, int]] = {}
        self.forms: dict[str, dict[int, int]] = {}
        place: dict[str, float] = {}
        for f in fields:
            if 2 * f["n"] > total:
                name = f["field"]
                place[name] = f["place"] / f["n"]
                self.kinds[name], self.forms[name] = defaultdict(int), defaultdict(int)
                for form in f["forms"]:
                    if form["kind"] != "null":
                        self.kinds[name][form["kind"]] += form["n"]
                        self.forms[name][form["bucket"]] += form["n"]
        self.fields = sorted(place, key=lambda f: (place[f], f))
        self.type = {f: next((k for k, n in self.kinds[f].items() if 2 * n > sum(self.kinds[f].values())), "unknown") for f in self.fields}

    def content(self, field: str, coarse: bool) -> dict[int, int]:
        held: dict[int, int] = defaultdict(int)
        for bucket, n in self.forms[field].items():
            held[bucket // LEADS if coarse else bucket] += n
        return held


class _Enforced:
    """One file read with the schema of an earlier one: typed (column → values it holds), rescued (field → values that no
    column holds: of unknown fields, or of another type than the column's), unfilled (columns without values)."""

    def __init__(self, schema: dict[str, str], file: _File) -> None:
        self.typed: dict[str, int] = {}
        self.rescued: dict[str, int] = {}
        for field in file.fields:
            values, kind = sum(file.kinds[field].values()), schema.get(field)
            held = 0 if kind is None else values if kind == "unknown" else file.kinds[field].get(kind, 0)
            if kind is not None:
                self.typed[field] = held
            if kind is None or held < values:
                self.rescued[field] = values - held
        self.unknown = [f for f in file.fields if f not in schema]
        self.unfilled = [f for f in schema if f not in self.typed]
        self.uncastable = [f for f, n in self.typed.items() if self.rescued.get(f, 0) > n and file.type[f] != "unknown"]


def _cosine(a: dict[int, int], b: dict[int, int]) -> float:
    norm = sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    return sum(n * b.get(k, 0) for k, n in a.items()) / norm if norm else 0.0


def _alike(a: dict[int, int], b: dict[int, int]) -> float:
    """How far two contents agree: by proportion (cosine) or, where other runs shift proportions, by the smaller share of
    either side whose forms the other side has too."""
    common = a.keys() & b.keys()
    shared = min((sum(x[k] for k in common) / max(1, sum(x.values())) for x in (a, b)), default=0.0)
    return max(_cosine(a, b), shared)


def _words(field: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", field.rpartition(".")[2])}


def compared(before: _File, after: _File, alike: float = 0.5) -> list[tuple[str, str, str]]:
    """(change, field, new_field) between two files, from reading ``after`` with the schema of ``before``.

    A rescued field that no column knows is replayed into an unfilled column between the same lasting neighbours of the
    same container: the column was renamed if it holds the values, that is, if their shapes agree with those that it had
    (at least ``alike``), or if the values were retyped as well and nothing else fits the place. Unknown fields that
    replay nowhere are added, unfilled columns removed; columns whose values mostly were rescued are retyped.
    """
    read = _Enforced(before.type, after)
    lasting = set(read.typed)

    def slots(fields: list[str]) -> dict[str, tuple[str, str, str]]:
        found = {}
        for c in {f.rpartition(".")[0] for f in fields}:
            inside = [f for f in fields if f.rpartition(".")[0] == c]
            for i, f in enumerate(inside):
                found[f] = (c, next((x for x in reversed(inside[:i]) if x in lasting), ""), next((x for x in inside[i + 1 :] if x in lasting), ""))
        return found

    old, new = slots(before.fields), slots(after.fields)
    pairs = []
    for a in read.unfilled:
        for b in read.unknown:
            if old[a][0] != new[b][0] or (old[a][1] != new[b][1] and old[a][2] != new[b][2]):
                continue
            same = _alike(before.content(a, True), after.content(b, True))
            exact = _alike(before.content(a, False), after.content(b, False))
            words = len(_words(a) & _words(b)) / max(1, len(_words(a) | _words(b)))
            retyped = before.type[a] != after.type[b] and "unknown" not in (before.type[a], after.type[b])
            unseen = "unknown" in (before.type[a], after.type[b])
            if same >= alike or (retyped or unseen) and words >= 0.3 or same > 0.2 and words >= 0.5:
                pairs.append((same + exact + words + (old[a][1:] == new[b][1:]), a, b))
    replayed: dict[str, str] = {}
    for _, a, b in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if a not in replayed and b not in replayed.values():
            replayed[a] = b
    found = [("renamed", a, b) for a, b in replayed.items()]
    found += [("removed", a, "") for a in read.unfilled if a not in replayed]
    found += [("added", b, b) for b in read.unknown if b not in replayed.values()]
    found += [("retyped", f, f) for f in read.uncastable if before.type[f] != "unknown"]
    # a replayed column is read again under its old name: what it can't hold was retyped, too
    found += [("retyped", a, b) for a, b in replayed.items() if before.type[a] != "unknown" and _Enforced({b: before.type[a]}, after).uncastable]
    return found


def aliases(report: DataFrame, schema: dict[str, str] | None = None, most: int = 1000) -> dict[str, str]:
    """Approved promotions from a report: every unknown name that replaced a field of the schema, directly or over other
    names. Names are few (``most`` at most, else an error): they are the vocabulary of the writers, not data."""
    fields = schema or EVENT_FIELDS
    pairs = report.filter("change = 'renamed'").select("field", "new_field").distinct().limit(most + 1).collect()
    if len(pairs) > most:
        raise ValueError("too many names; pass the aliases to promote")
    known = {f: f for f in fields}
    for _ in pairs:  # names follow names
        for a, b in sorted((r["field"], r["new_field"]) for r in pairs):
            if a in known and b not in known:
                known[b] = known[a]
            elif b in known and a not in known:
                known[a] = known[b]
    return {a: f for a, f in known.items() if a not in fields}


def consistent(events: DataFrame, keep: list[str], schema: dict[str, str] | None = None, approved: dict[str, str] | None = None) -> DataFrame:
    """One event table over all files: ingested, with what drifted under other names replayed into the typed columns.
    ``approved``: unknown field → field of the schema; if not given, every rename that the report finds is approved."""
    return promoted(ingested(events, keep, "event_json", schema), aliases(drift_report(events), schema) if approved is None else approved, keep, schema)


def schemas(events: DataFrame) -> DataFrame:
    """What each file shows: store_id, file_no, event_type, total (readable rows) and fields, a list of those that more than
    half of the rows carry, with n, place and the counts of their values' types and shapes. Fields of fewer rows (stray
    keys) leave before anything is listed, so a list is as long as a row is wide."""
    file = ["store_id", "file_no", "event_type"]
    found = profiles(events).repartition(*file)
    total = F.max(F.when(F.col("field") == "", F.col("__n"))).over(Window.partitionBy(*file))
    by_field = found.groupBy(*file, "field").agg(F.sum("n").alias("__n"), F.sum("place").alias("place"), F.collect_list(F.struct("kind", "bucket", "n")).alias("forms"))
    kept = by_field.withColumn("total", total).filter((F.col("field") != "") & (2 * F.col("__n") > F.col("total")) | (F.col("field") == ""))
    listed = F.collect_list(F.when(F.col("field") != "", F.struct("field", F.col("__n").alias("n"), "place", "forms")))
    return kept.groupBy(*file).agg(F.max("total").alias("total"), listed.alias("fields"))


def drift_report(events: DataFrame) -> DataFrame:
    """Each change of a store's files against the last earlier file that has readable rows of the event type:
    store_id, file_no, event_type, change, field, new_field. Rows without a store, file or type form files of their own
    (null keys are equal); an empty table gives no rows."""
    w = Window.partitionBy("store_id", "event_type").orderBy("file_no")
    files = schemas(events).select("store_id", "file_no", "event_type", F.struct("total", "fields").alias("after"))
    pairs = files.withColumn("before", F.lag("after").over(w)).filter("before is not null")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for store, file, kind, after, before in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(store, file, kind, *c) for c in compared(_File(**_sides(before)), _File(**_sides(after)))]
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
            made = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)]
            yield pa.RecordBatch.from_arrays(made, names=["store_id", "file_no", "event_type", "change", "field", "new_field"])

    return pairs.select("store_id", "file_no", "event_type", "after", "before").mapInArrow(
        report, "store_id string, file_no int, event_type string, change string, field string, new_field string"
    )


def _sides(side: dict) -> dict:
    return {"total": side["total"], "fields": side["fields"]}


def version(told: Column) -> Column:
    """The number in what a writer says about its schema ("1", "v1", "1.0", "schema-1"); null if there is none."""
    return F.regexp_extract(F.lower(F.trim(told)), r"^(?:[a-z]+[-_ ]?)?(\d{1,9})(?:\.0+)?$", 1).try_cast("int")


def versions(events: DataFrame, meta: DataFrame) -> DataFrame:
    """What is told of each file: store_id, file_no, declared (the greatest version in the store's own records of the file;
    null if they name none), in_rows (the most frequent version of its rows, of equals the greatest), rows, unversioned."""
    said = meta.filter("key = 'schema_version'").groupBy("store_id", "file_no").agg(F.max(version(F.col("value"))).alias("declared"))
    counts = events.groupBy("store_id", "file_no", version(F.col("schema_version")).alias("v")).agg(F.count("*").alias("n"))
    known = F.when(F.col("v").isNotNull(), F.struct("n", "v"))
    rows = counts.groupBy("store_id", "file_no").agg(F.max(known)["v"].alias("in_rows"), F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("unversioned"))
    return rows.join(said, ["store_id", "file_no"], "left").select("store_id", "file_no", "declared", "in_rows", "rows", "unversioned")


def changes_by_file(report: DataFrame, told: DataFrame) -> DataFrame:
    """told (see versions) with the number of changes of each file, version_changed (declared or in_rows differs from the
    file before) and undeclared (there are changes, but no version changed)."""
    n = report.groupBy("store_id", "file_no").agg(F.count("*").alias("changes"))
    w = Window.partitionBy("store_id").orderBy("file_no")
    differs = lambda c: F.coalesce(F.col(c) != F.lag(c).over(w), F.lit(False))
    rows = told.join(n, ["store_id", "file_no"], "left").withColumns({"changes": F.coalesce("changes", F.lit(0)), "version_changed": differs("declared") | differs("in_rows")})
    return rows.withColumn("undeclared", (F.col("changes") > 0) & ~F.col("version_changed"))

"""Event payloads as text: decoding, kinds of JSON values, derived identities."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def read_payload(text: str | None) -> dict | None:
    """The JSON object in ``text``, also if it is a JSON string that holds JSON text; None if unreadable."""
    if text is None:
        return None
    try:
        value = json.loads(text)
        if isinstance(value, str):
            value = json.loads(value)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def json_kind(value: Any) -> str:
    """string, number, boolean, object, array or null."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "object" if isinstance(value, dict) else "array"


def blank_to_null(c: Column) -> Column:
    """Null where the text is empty or white space."""
    return F.when(F.trim(c) != "", c)


def case_key(dataset_id: Column, case_id: Column) -> Column:
    """``<length of dataset_id>:<dataset_id>:<case_id>``; length counts code points. Null if either is null."""
    return F.concat(F.length(dataset_id).cast("string"), F.lit(":"), dataset_id, F.lit(":"), case_id)


def case_key_or_derived(key: Column, dataset_id: Column, case_id: Column) -> Column:
    """The key as given; if null or blank, derived; if the dataset is null too, the bare case id."""
    return F.coalesce(blank_to_null(key), case_key(dataset_id, case_id), case_id)


def unwrapped(payload: Column) -> Column:
    """Payload text without a second encoding as a JSON string (JVM side)."""
    return F.when(F.startswith(F.ltrim(payload), F.lit('"')), F.get_json_object(F.concat(F.lit("["), payload, F.lit("]")), "$[0]")).otherwise(payload)


def first_member(payload: Column, paths: list[str]) -> Column:
    """The first member of ``paths`` (dotted) that the JSON object holds as a non-null value, as text."""
    return F.coalesce(*(F.get_json_object(payload, f"$.{p}") for p in paths))

"""Content identities: canonical JSON hashes, seeds, run ids."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(value: Any) -> str:
    """Sorted keys, no white space, ASCII escapes, no NaN: equal values have equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def content_hash(value: Any) -> str:
    """SHA-256 of the canonical JSON, in hex."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def _canonical(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            return canonical_json(json.loads(t))
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


def canonical_text(c: Column) -> Column:
    """Canonical JSON of a JSON text; null if unreadable."""
    return F.pandas_udf(_canonical, "string")(c)


def python_value(value: Any) -> Any:
    """1, 1.0 and true are equal, as are keys in any order; a string never equals a number."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, list):
        return [python_value(v) for v in value]
    return {k: python_value(v) for k, v in value.items()} if isinstance(value, dict) else value


def _comparable(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(python_value(json.loads(t)), sort_keys=True)
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


def comparable_text(c: Column) -> Column:
    """A text that is equal where the values of JSON texts are equal; null if unreadable."""
    return F.pandas_udf(_comparable, "string")(c)


def first_32_bits(text: Column) -> Column:
    """The first eight hex digits of the SHA-256 of ``text`` as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def candidate_seed(run_id: Column, index: Column) -> Column:
    """Seed of a candidate: hash of ``run_id:index``."""
    return first_32_bits(F.concat_ws(":", run_id, index.cast("string")))


def judge_seed(run_id: Column, case_key: Column, metric_id: Column, judge: Column, judge_index: Column, repeat: Column, dimension: Column, candidates: Column) -> Column:
    """Seed of a judge's call: hash of the eight axes of its fan-out joined by colons; ``candidates`` is an array of indices."""
    joined = F.coalesce(F.array_join(F.transform(candidates, lambda x: x.cast("string")), ","), F.lit(""))
    return first_32_bits(F.concat_ws(":", run_id, case_key, metric_id, judge, judge_index.cast("string"), repeat.cast("string"), F.coalesce(dimension, F.lit("")), joined))

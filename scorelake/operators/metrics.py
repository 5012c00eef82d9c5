"""Deterministic metrics as columns over (prediction, expected)."""

from __future__ import annotations

import json
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions import text
from scorelake.functions.identity import comparable_text, python_value


def exact_match(prediction_json: Column, expected_json: Column) -> Column:
    """1 if both JSON values are equal (numbers by value, keys in any order; null equals null), else 0."""
    return comparable_text(prediction_json).eqNullSafe(comparable_text(expected_json)).cast("double")


def choice_accuracy(choice: Column, expected_json: Column) -> Column:
    return (F.upper(text.stripped(choice)) == F.upper(text.stripped(text.expected_text(expected_json, "choice")))).cast("double")


def math_equivalence(answer: Column, expected_json: Column) -> Column:
    """Equality without blanks and case; 0 if either side is empty."""
    mine, gold = text.stripped(answer), text.stripped(text.expected_text(expected_json, "answer"))
    return F.when((mine == "") | (gold == "") | mine.isNull(), 0.0).otherwise((text.math_text(mine) == text.math_text(gold)).cast("double"))


def _trimmed(value: object) -> object:
    if isinstance(value, str):
        return value.strip()
    return [_trimmed(v) for v in value] if isinstance(value, list) else value


def _equal_values(mine: pa.Array, gold: pa.Array) -> pa.Array:
    def one(a: str | None, b: str | None) -> float:
        try:
            x, y = (None if t is None else json.loads(t) for t in (a, b))
        except (ValueError, RecursionError):
            return 0.0
        y = y["answer"] if isinstance(y, dict) and "answer" in y else y
        return float(python_value(_trimmed(x)) == python_value(_trimmed(y)))

    return pa.array([one(a, b) for a, b in zip(mine.to_pylist(), gold.to_pylist())], pa.float64())


def final_value_match(value_json: Column, expected_json: Column) -> Column:
    """1 if the values are equal after white space around texts, and lists item by item; whole numbers equal their
    fractions of zero; null equals null. ``expected_json`` may be an object with a member answer. 0 for unreadable JSON."""
    return F.arrow_udf(_equal_values, "double")(value_json, expected_json)


def _overlap(mine: pa.Array, gold: pa.Array) -> pa.Array:
    """Size of the multiset intersection of two lists of words, for each pair."""
    return pa.array([sum((Counter(a) & Counter(b)).values()) if a and b else 0 for a, b in zip(mine.to_pylist(), gold.to_pylist())], pa.int64())


def token_scores(rows: DataFrame, keys: list[str], prediction: str, expected: str) -> DataFrame:
    """keys, overlap, n_predicted, n_expected, f1, precision of each row: token overlap as multisets.

    Both texts stand in one row, so their words are counted there, in one pass over them, and nothing is shuffled. Both
    empty give f1 1 and precision 0. Repeated keys are rows of their own.
    """
    split = rows.select(*keys, text.tokens(F.col(prediction)).alias("__p"), text.tokens(F.col(expected)).alias("__e"))
    sums = split.select(*keys, F.arrow_udf(_overlap, "bigint")("__p", "__e").alias("overlap"), F.size("__p").cast("bigint").alias("n_predicted"), F.size("__e").cast("bigint").alias("n_expected"))
    f1 = F.when((F.col("n_predicted") == 0) & (F.col("n_expected") == 0), 1.0).otherwise(F.when(F.col("overlap") == 0, 0.0).otherwise(2 * F.col("overlap") / (F.col("n_predicted") + F.col("n_expected"))))
    return sums.withColumns({"f1": f1, "precision": F.when(F.col("n_predicted") == 0, 0.0).otherwise(F.col("overlap") / F.col("n_predicted"))})


def pass_rates(tests: DataFrame, keys: list[str], passed: Column) -> DataFrame:
    """Share of the tests of each case that passed, and both counts."""
    return tests.groupBy(*keys).agg(F.count("*").alias("tests_total"), F.count_if(passed).alias("tests_passed")).withColumn("pass_rate", F.col("tests_passed") / F.col("tests_total"))


def outcome(value: Column) -> Column:
    return F.when(value >= 1.0, "correct").otherwise("incorrect")

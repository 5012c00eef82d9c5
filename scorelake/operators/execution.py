"""Scores of code by tests, with an injected executor."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.operators.metrics import pass_rates

#: executor(code, language, stdin) → (stdout, return code)
Executor = Callable[[str, str, str], tuple[str, int]]


def executed(tests: DataFrame, executor: Executor, keep: list[str]) -> DataFrame:
    """``keep``, passed: whether each test's output equals the expected one (line ends and white space at the end aside).
    ``tests`` has code, language, stdin and expected columns. Equal runs are executed once a batch; a run that raises or
    returns another code than 0 fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: dict[tuple, tuple[str, int]] = {}
            passed = []
            for code, language, stdin, expected in zip(batch["code"], batch["language"], batch["stdin"], batch["expected"]):
                key = (code, language, stdin)
                if key not in held:
                    try:
                        held[key] = executor(*key) if code and code.strip() else ("", 1)
                    except Exception:  # noqa: BLE001 - a failing run is a failed test
                        held[key] = ("", 1)
                out, status = held[key]
                passed.append(status == 0 and _plain(out) == _plain(expected or ""))
            yield batch[keep].assign(passed=passed)

    keyed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tests.select(*keep).schema)
    return tests.mapInPandas(run, f"{keyed}, passed boolean")


def _plain(text: str) -> str:
    return text.replace("\r\n", "\n").strip()


def pass_rate(cases: DataFrame, executor: Executor, keys: list[str]) -> DataFrame:
    """Share of each case's tests that its code passes. ``cases``: keys, code, language, tests ARRAY<STRUCT<input, output>>;
    cases without tests have no row."""
    tests = cases.select(*keys, "code", "language", F.explode("tests").alias("t")).select(*keys, "code", "language", F.col("t.input").alias("stdin"), F.col("t.output").alias("expected"))
    return pass_rates(executed(tests, executor, keys), keys, F.col("passed"))


def call_program(solution: str, function: str, arguments_json: str) -> str:
    """A program that calls a function with JSON arguments and prints its result as JSON."""
    return f"{solution.rstrip()}\n\nimport json\n\nprint(json.dumps({function}(*json.loads({json.dumps(arguments_json)})), sort_keys=True))\n"


def check_program(solution: str, function: str, script: str) -> str:
    """A program that runs a script's check over a function."""
    return f"{solution.rstrip()}\n\n{script.rstrip()}\n\ncheck({function})\nprint('ok')\n"


def function_pass_rate(cases: DataFrame, executor: Executor, keys: list[str]) -> DataFrame:
    """keys, tests_total, tests_passed, pass_rate of code that defines a function. ``cases``: keys, code, reference,
    function, script, inputs ARRAY<STRING> (JSON lists of arguments).

    With a script the one test is whether the candidate and the reference both pass it; else each input is a test, passed
    if both give the same output. A reference is run once for each input of a batch. Without code, function or reference,
    or without any test, the rate is 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: dict[str, tuple[str, int]] = {}

            def out(program: str) -> tuple[str, int]:
                if program not in held:
                    try:
                        text, status = executor(program, "python", "")
                    except Exception:  # noqa: BLE001 - a failing run is a failed test
                        text, status = "", 1
                    held[program] = (_plain(text), status)
                return held[program]

            total, passed = [], []
            for code, reference, function, script, inputs in zip(batch["code"], batch["reference"], batch["function"], batch["script"], batch["inputs"]):
                made = [check_program] if script else [call_program] * (0 if inputs is None else len(inputs))
                tests = [script] if script else list(inputs if inputs is not None else [])
                if not (code and code.strip() and reference and function):
                    tests, made = [], []
                pairs = [(out(f(code, function, t)), out(f(reference, function, t))) for f, t in zip(made, tests)]
                total.append(len(pairs))
                passed.append(sum(a[1] == 0 and b[1] == 0 and (bool(script) or a[0] == b[0]) for a, b in pairs))
            yield batch[keys].assign(tests_total=total, tests_passed=passed)

    keyed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cases.select(*keys).schema)
    told = cases.select(*keys, "code", "reference", "function", "script", "inputs").mapInPandas(run, f"{keyed}, tests_total bigint, tests_passed bigint")
    return told.withColumn("pass_rate", F.when(F.col("tests_total") > 0, F.col("tests_passed") / F.col("tests_total")).otherwise(0.0))

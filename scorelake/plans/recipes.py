"""The benchmark recipes over small rows of their sources' shapes, with the same cases as SQL."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.sources import benchmarks

_MATH = ("problem_idx int, problem string, answer string, problem_type array<string>, source string", [(7, "2+2?", " 4 ", ["alg", "x"], "s"), (None, "3+3?", "6", None, None)])
_LEVELS = ("item_id string, question string, options array<string>, answer_letter string, discipline string, field string, subfield string, difficulty string", [("i1", "Which?", ["red", "blue", "tan"], "b", "D", "F", "S", "easy"), (None, "Who?", ["me"], " a ", None, None, None, "hard")])
_TESTS = "array<struct<input:string,output:string>>"

#: Recipe (with its variant) → (schema, rows) of a source like the public one; rows are made up.
ROWS: dict[str, tuple[str, list[tuple]]] = {
    **{name: _MATH for name in ("aime_2025", "aime_2026", "apex_2025", "hmmt_feb_2025", "hmmt_nov_2025")},
    "beyond_aime": ("item_id string, problem string, answer string", [("x", "1+1?", "2"), ("y", "5-1?", " 4")]),
    "phybench": ("id int, tag string, content string, answer string", [(3, "optics", "n?", "1.5")]),
    "imo_answerbench": ("`Problem ID` string, Problem string, `Short Answer` string, Category string, Subcategory string, Source string", [("imo-1", "Find n.", " 3 ", "A", "B", "C")]),
    "mmlu_pro": ("item_id int, question string, options array<string>, answer string, category string, src string", [(5, "Which?", [f"o{i}" for i in range(28)], "j", "math", "web")]),
    "supergpqa": _LEVELS, "encyclo_k": _LEVELS,
    "babe": ("uuid string, text string, label int, outlet string, topic string, type string, label_opinion string", [("u1", "It rains.", 0, "o", "t", "left", "fact"), ("u2", "It's awful.", 1, "o", "t", None, "opinion")]),
    "gpqa_diamond": ("question string, answer string", [("What?\n a) red\nb) blue \nc) tan\nd) sky\nA. b\nB. a\nC. d\nD. c", " c ")]),
    "mmmlu:FR_FR": ("`Unnamed: 0` int, Question string, A string, B string, C string, D string, Answer string, Subject string", [(0, "Quoi ?", "a", "b", "c", "d", "D", "droit")]),
    "superchem:zh": ("uuid string, field string, question_type string, question_en string, question_zh string, question_images array<string>, options_zh map<string,string>, answer_zh array<string>", [("s1", "org", "single", "Q", "问", ["i.png", ""], {"B": "乙", "A": "甲"}, ["b"])]),
    "frontierscience": ("item_id string, problem string, answer string, subject string, task_group_id string", [("f1", "Why?", "Because.", "phys", "g")]),
    "healthbench": ("prompt_id string, prompt array<struct<role:string,content:string>>, rubrics array<struct<criterion:string,points:int,tags:array<string>>>, example_tags array<string>, ideal_completions_data struct<ideal_completion:string>", [("h1", [("user", "hi"), ("assistant", None), ("user", "help")], [("kind", 5, ["t"])], ["a", "b"], ("Rest.",))]),
    "lpfqa": ("prompt_id string, prompt string, response_reference string, judge_prompt_template string, judge_system_prompt string, primary_domain string", [("l1", "P?", "R", None, "sys", "law")]),
    "simpleqa_verified": ("original_index int, problem string, answer string, topic string, answer_type string, multi_step boolean, requires_reasoning boolean", [(11, "Who?", "Ada", "sci", "person", False, True)]),
    "hle:text_only": ("id string, question string, answer string, image string", [("1", "Q1", "A1", ""), ("2", "Q2", "A2", "img"), ("3", "Q3", "A3", None)]),
    "procbench:task01": ("problem_name string, prompt string, task_name string, label struct<final:string>", [("p1", "Do.", "task01", ("x",)), ("p2", "Do.", "task02", ("y",))]),
    "rolebench:role_generalization_eng": ("role string, question string, generated array<string>, desc string", [("Ann", "Who are you?", ["I am Ann.", "No."], " a nurse "), ("Bo", "Why?", [], None)]),
    "codeforces": (f"id string, contest_id string, title string, prompt string, input_mode string, interaction_format string, official_tests_complete boolean, official_tests {_TESTS}, language string, rating int", [("c1", "9", "T", "P", " STDIO ", None, True, [("1", "2"), ("3", None)], "cpp", 800), ("c2", "9", "T", "P", "file", None, True, [("1", "2")], "cpp", 800), ("c3", "9", "T", "P", "stdio", "x", True, [], "cpp", 800), ("c4", "9", "T", "P", "stdio", "", False, [], "cpp", 800)]),
    "aethercode": (f"id int, description string, test_cases {_TESTS}, difficulty string, contest_category string, contest_name string, date string, year int", [(1, "Sort.", [("2 1", "1 2")], "hard", "cat", "n", "d", 2024), (2, "None.", [], "hard", "cat", "n", "d", 2024)]),
    "livecodebench": ("question_id string, prompt string, public_tests string, language string, platform string, difficulty string", [("q1", "Add.", '[{"input": "1", "output": "2"}, {"input": "3"}]', None, "at", "easy"), ("q2", "Add.", "no json", None, "at", "easy")]),
    "humaneval_plus": ("task_id string, entry_point string, prompt string, canonical_solution string, base_input array<array<int>>, test string", [("HE/0", "f", "def f(a):\n", "  return a\n\n", [[1], [2]], " check \n")]),
}


def benchmark_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases of every recipe: benchmark, case_id, position, input, expected_output and metadata as sorted name=value."""
    found = []
    for name, (schema, rows) in ROWS.items():
        made = benchmarks.materialized(spark.createDataFrame(rows, schema).coalesce(1), name)
        shown = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
        found.append(made.select(F.lit(name).alias("benchmark"), "case_id", "position", "input", "expected_output", shown.alias("metadata")))
    return reduce(DataFrame.unionByName, found)


def _literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_literal, value)) + "]"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _source(name: str, columns: dict[int, str]) -> str:
    """Some columns of the rows of a recipe's source, with n, their number from 1."""
    values = ", ".join("(" + ", ".join([str(n), *(_literal(row[i]) for i in columns)]) + ")" for n, row in enumerate(ROWS[name][1], start=1))
    return f"(VALUES {values}) t({', '.join(['n', *columns.values()])})"


def _choices(options: list[str]) -> str:
    return " || chr(10) || ".join(f"'{chr(65 + i) if i < 26 else 'A' + chr(65 + i - 26)}. ' || {o}" for i, o in enumerate(options))


def _choice_sql(question: str, options: str) -> str:
    return f"'Question:' || chr(10) || {question} || chr(10) || chr(10) || 'Options:' || chr(10) || {options} || chr(10) || chr(10) || 'Return the best option letter only.'"


def _told(**members: str) -> str:
    """Sorted name=value of the members that aren't null."""
    return "list_aggregate(list_sort(list_filter([" + ", ".join(f"'{k}=' || {v}" for k, v in members.items()) + "], lambda x: x IS NOT NULL)), 'string_agg', ';')"


def _select(name: str, columns: dict[int, str], case_id: str, shown: str, expected: str, told: str, keep: str = "true") -> str:
    return f"SELECT '{name}' AS benchmark, {case_id} AS case_id, n::BIGINT AS position, {shown} AS input, {expected}::VARCHAR AS expected_output, coalesce({told}, '') AS metadata FROM {_source(name, columns)} WHERE {keep}"


_SOLVE = r"'Solve the following math problem. Return only the final answer in \boxed{...}.' || chr(10) || chr(10) || 'Problem:' || chr(10) || "
_NUMBERED = "list_aggregate(list_transform(o, lambda x, i: CASE WHEN i <= 26 THEN chr((64 + i)::INT) ELSE 'A' || chr((64 + i - 26)::INT) END || '. ' || x), 'string_agg', chr(10))"


def _oracle() -> str:
    parts = [_select(m, {0: "id", 1: "p", 2: "a", 3: "kinds", 4: "src"}, "coalesce(id::VARCHAR, 'train-' || n)", _SOLVE + "p", "json_object('answer', trim(a))", _told(problem_type="list_aggregate(kinds, 'string_agg', ', ')", source="src")) for m in ("aime_2025", "aime_2026", "apex_2025", "hmmt_feb_2025", "hmmt_nov_2025")]
    parts += [_select(m, {0: "id", 1: "q", 2: "o", 3: "a", 4: "d", 5: "f", 6: "s", 7: "h"}, f"coalesce(id, '{split}-' || n)", _choice_sql("q", _NUMBERED), "json_object('choice', upper(trim(a)))", _told(discipline="d", field="f", subfield="s", difficulty="h")) for m, split in (("supergpqa", "train"), ("encyclo_k", "test"))]
    parts += [
        _select("beyond_aime", {1: "p", 2: "a"}, "'test-' || n", _SOLVE + "p", "json_object('answer', trim(a))", "''"),  # the ids of this source have another name
        _select("phybench", {0: "id", 1: "tag", 2: "p", 3: "a"}, "id::VARCHAR", _SOLVE + "p", "json_object('answer', a)", _told(tag="tag")),
        _select("imo_answerbench", {0: "id", 1: "p", 2: "a", 3: "c", 4: "s", 5: "src"}, "id", _SOLVE + "p", "json_object('answer', trim(a))", _told(category="c", subcategory="s", source="src")),
        _select("mmlu_pro", {0: "id", 1: "q", 2: "o", 3: "a", 4: "c", 5: "src"}, "id::VARCHAR", _choice_sql("q", _NUMBERED), "json_object('choice', upper(a))", _told(category="c", src="src")),
        _select("babe", {0: "id", 1: "q", 2: "l", 3: "o", 4: "t", 5: "k", 6: "lo"}, "id", _choice_sql("q", _choices(["'Entirely factual'", "'Opinionated or subjective'"])), "json_object('choice', CASE l WHEN 0 THEN 'A' ELSE 'B' END)", _told(outlet="o", topic="t", type="k", label_opinion="lo")),
        _select("gpqa_diamond", {1: "a"}, "'test-' || n", _choice_sql("'What?'", _choices(["'blue'", "'red'", "'sky'", "'tan'"])), "json_object('choice', upper(trim(a)))", "''"),
        _select("mmmlu:FR_FR", {0: "id", 1: "q", 2: "a", 3: "b", 4: "c", 5: "d", 6: "l", 7: "s"}, "id::VARCHAR", _choice_sql("q", _choices(["a", "b", "c", "d"])), "json_object('choice', l)", _told(subject="s", variant="'FR_FR'")),
        _select("superchem:zh", {0: "id", 1: "f", 2: "k", 4: "q", 7: "a"}, "id", _choice_sql("q", _choices(["'甲'", "'乙'"])) + " || chr(10) || chr(10) || 'Images:' || chr(10) || 'i.png'", "json_object('choice', upper(a[1]))", _told(field="f", question_type="k", variant="'zh'")),
        _select("frontierscience", {0: "id", 1: "p", 2: "a", 3: "s", 4: "g"}, "id", "p", "json_object('rubric', a)", _told(subject="s", task_group_id="g")),
        _select("healthbench", {0: "id"}, "id", "'user: hi' || chr(10) || chr(10) || 'user: help'", """'{"rubrics":[{"criterion":"kind","points":5,"tags":["t"]}],"ideal_completion":"Rest."}'""", _told(prompt_id="id", example_tags="'a, b'")),
        _select("lpfqa", {0: "id", 1: "p", 2: "r", 4: "s", 5: "d"}, "id", "p", "json_object('response_reference', r, 'judge_prompt_template', '{response_reference}' || chr(10) || '{response}', 'judge_system_prompt', s)", _told(primary_domain="d")),
        _select("simpleqa_verified", {0: "id", 1: "p", 2: "a", 3: "t", 4: "k", 5: "m", 6: "r"}, "id::VARCHAR", "p", "json_object('answer', a)", _told(topic="t", answer_type="k", multi_step="m", requires_reasoning="r")),
        _select("hle:text_only", {0: "id", 1: "q", 2: "a", 3: "i"}, "id", "q", "json_object('answer', a)", _told(variant="'text_only'"), "coalesce(i, '') = ''"),
        _select("procbench:task01", {0: "id", 1: "p", 2: "t"}, "id", "p", "json_object('answer', 'x')", _told(task_name="t", variant="'task01'"), "t = 'task01'"),
        _select("rolebench:role_generalization_eng", {0: "r", 1: "q", 2: "g", 3: "s"}, "'test-' || n", "'You are ' || r || '.' || CASE WHEN trim(coalesce(s, '')) <> '' THEN ' Your description is: ' || trim(s) || '.' ELSE '' END || chr(10) || chr(10) || 'Answer the following question while staying fully in character.' || chr(10) || chr(10) || 'Question:' || chr(10) || q", "json_object('answer', coalesce(g[1], ''))", _told(role="r", variant="'role_generalization_eng'")),
        _select("codeforces", {0: "id", 1: "c", 3: "p", 4: "m", 5: "i", 6: "w", 8: "l", 9: "r"}, "id", "p", """'{"language":"cpp","execution_mode":" STDIO ","official_tests":[{"input":"1","output":"2"}],"time_limit":null,"memory_limit":null,"generated_checker":null,"checker_language":null}'""", _told(contest_id="c", language="l", rating="r", input_mode="m"), "lower(trim(m)) = 'stdio' AND coalesce(i, '') = '' AND w"),
        _select("aethercode", {0: "id", 1: "p", 3: "d", 4: "k", 5: "cn", 6: "dt", 7: "y"}, "id::VARCHAR", "'Write a C++17 program that solves the following problem. Return only code.' || chr(10) || chr(10) || 'Problem:' || chr(10) || p", """'{"language":"cpp","execution_mode":"stdio","official_tests":[{"input":"2 1","output":"1 2"}],"time_limit":null,"generated_checker":null,"checker_language":"cpp"}'""", _told(difficulty="d", contest_category="k", contest_name="cn", date="dt", year="y"), "id = 1"),
        _select("livecodebench", {0: "id", 1: "p", 4: "k", 5: "d"}, "id", "p", """'{"language":"python","execution_mode":"stdio","official_tests":[{"input":"1","output":"2"}],"function_name":null,"time_limit":null}'""", _told(platform="k", difficulty="d"), "id = 'q1'"),
        _select("humaneval_plus", {0: "id", 1: "f"}, "id", "'Write a complete Python solution for the following task. Return only Python code.' || chr(10) || chr(10) || 'def f(a):' || chr(10)", r"""'{"language":"python","execution_mode":"function","function_name":"f","official_tests":[{"input":"[1]"},{"input":"[2]"}],"test_script":"check","reference_solution":"def f(a):\n  return a\n","solution":"def f(a):\n  return a\n","score_variant":"plus"}'""", _told(entry_point="f")),
    ]
    return " UNION ALL ".join(parts)


QUERIES = {"benchmark_cases": benchmark_cases}
ORACLE = {"benchmark_cases": _oracle()}

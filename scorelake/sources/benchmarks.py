"""Benchmark recipes: rows of public benchmarks as cases. A recipe is data; one function applies it as column expressions."""

from __future__ import annotations

import difflib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.payload import case_key
from scorelake.functions.text import choice_prompt, stripped
from scorelake.sources.datasets import positions

# --- fixed values: the wording of prompts
MATH_PROMPT = "Solve the following math problem. Return only the final answer in \\boxed{...}.\n\nProblem:\n"
CPP_PROMPT = "Write a C++17 program that solves the following problem. Return only code.\n\nProblem:\n"
PYTHON_PROMPT = "Write a complete Python solution for the following task. Return only Python code.\n\n"
ROLE_PROMPT = "\n\nAnswer the following question while staying fully in character.\n\nQuestion:\n"
# --- end of fixed values


class Rows:
    """Columns of a source that may be missing."""

    def __init__(self, df: DataFrame, split: str, variant: str | None) -> None:
        self.df, self.split, self.variant = df, split, variant
        self.types = dict(df.dtypes)

    def text(self, *names: str, default: str = "") -> Column:
        """The first of the columns that exists, as text; the default if none does or it is null."""
        name = next((n for n in names if n in self.types), None)
        return F.lit(default) if name is None else F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(default))

    def raw(self, *names: str) -> Column | None:
        name = next((n for n in names if n in self.types), None)
        return None if name is None else F.col(f"`{name}`")

    def array(self, *names: str) -> Column:
        """An array of texts; empty if the column is missing, null or no array."""
        name = next((n for n in names if n in self.types), None)
        if name is None or not self.types[name].startswith("array"):
            return F.array().cast("array<string>")
        return F.coalesce(F.transform(F.col(f"`{name}`"), lambda x: x.cast("string")), F.array().cast("array<string>"))

    def id(self, *names: str) -> Column:
        name = next((n for n in names if n in self.types), None)
        default = F.concat(F.lit(f"{self.split}-"), F.col("__position").cast("string"))
        return default if name is None else F.coalesce(F.col(f"`{name}`").cast("string"), default)

    def tests(self, *names: str) -> Column:
        """Tests as an array of structs of input and output: from an array of structs or from JSON text; entries without
        either are left out."""
        name = next((n for n in names if n in self.types), None)
        kind = "array<struct<input:string,output:string>>"
        if name is None:
            return F.array().cast(kind)
        if self.types[name] == "string":
            held = F.from_json(F.col(f"`{name}`"), kind)
        elif "input" in self.types[name] and "output" in self.types[name]:
            held = F.transform(F.col(f"`{name}`"), lambda t: F.struct(t["input"].cast("string").alias("input"), t["output"].cast("string").alias("output")))
        else:
            return F.array().cast(kind)
        return F.coalesce(F.filter(held, lambda t: t["input"].isNotNull() & t["output"].isNotNull()), F.array().cast(kind))


def _json(**members: Column | str | None) -> Column:
    """A JSON object; null members are kept."""
    columns = [(v if isinstance(v, Column) else F.lit(v).cast("string")).alias(k) for k, v in members.items()]
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _choice(r: Rows, question: tuple[str, ...], options: Callable[[Rows], Column], answer: Callable[[Rows], Column]) -> tuple[Column, Column]:
    return choice_prompt(r.text(*question), options(r)), _json(choice=F.upper(stripped(answer(r))))


def _gpqa(r: Rows) -> tuple[Column, Column]:
    """A question text that holds its options as ``a) …`` lines and their order as ``A. a`` lines."""
    lines = F.filter(F.transform(F.split(r.text("question"), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), stripped), lambda x: x != "")
    option, order = r"^([a-z])\)\s*(.+)$", r"^([A-Z])\.\s*([a-z])$"
    start = F.array_position(F.transform(lines, lambda x: x.rlike(option)), True)
    head = F.filter(F.when(start > 0, F.slice(lines, 1, (start - 1).cast("int"))).otherwise(lines), lambda x: ~x.rlike(order))
    pick = lambda letter: F.filter(lines, lambda x: x.rlike(rf"^{letter}\.\s*[a-z]$"))
    low = lambda letter: F.regexp_extract(F.try_element_at(pick(letter), F.lit(-1)), order, 2)
    told = lambda letter: F.transform(F.filter(lines, lambda x: x.rlike(option) & (F.regexp_extract(x, option, 1) == low(letter))), lambda x: stripped(F.regexp_extract(x, option, 2)))
    options = F.array_compact(F.array(*(F.try_element_at(told(x), F.lit(-1)) for x in "ABCD")))
    return choice_prompt(stripped(F.array_join(head, "\n")), options), _json(choice=F.upper(stripped(r.text("answer"))))


def _superchem(r: Rows) -> tuple[Column, Column]:
    language = r.variant or "en"
    held = r.raw(f"options_{language}")
    kind = r.types.get(f"options_{language}", "")
    if held is None or not kind.startswith(("map", "struct")):
        options = F.array().cast("array<string>")
    else:
        as_map = held if kind.startswith("map") else F.from_json(F.to_json(held), "map<string,string>")
        options = F.filter(F.transform(F.array_sort(F.map_keys(as_map)), lambda k: as_map[k]), lambda x: x.isNotNull())
    images = F.filter(r.array("question_images"), lambda x: x.isNotNull() & (x != ""))
    prompt = choice_prompt(r.text(f"question_{language}"), options)
    shown = F.when(F.size(images) > 0, F.concat(prompt, F.lit("\n\nImages:\n"), F.array_join(images, "\n"))).otherwise(prompt)
    return shown, _json(choice=F.upper(stripped(F.coalesce(F.try_element_at(r.array(f"answer_{language}"), F.lit(1)), F.lit("")))))


def _healthbench(r: Rows) -> tuple[Column, Column]:
    turns = r.raw("prompt")
    kept = F.filter(turns, lambda m: m["role"].isNotNull() & m["content"].isNotNull()) if r.types.get("prompt", "").startswith("array<struct") else None
    prompt = F.lit("") if kept is None else F.coalesce(F.array_join(F.transform(kept, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n\n"), F.lit(""))
    ideal = r.raw("ideal_completions_data")
    done = F.coalesce(ideal["ideal_completion"], F.lit("")) if ideal is not None and "ideal_completion" in r.types["ideal_completions_data"] else F.lit("")
    rubrics = r.raw("rubrics")
    return prompt, _json(rubrics=F.array().cast("array<string>") if rubrics is None else rubrics, ideal_completion=done)


def _rolebench(r: Rows) -> tuple[Column, Column]:
    described = F.when(stripped(r.text("desc")) != "", F.concat(F.lit(" Your description is: "), stripped(r.text("desc")), F.lit("."))).otherwise("")
    prompt = F.concat(F.lit("You are "), r.text("role"), F.lit("."), described, F.lit(ROLE_PROMPT), r.text("question"))
    return prompt, _json(answer=F.coalesce(F.try_element_at(r.array("generated"), F.lit(1)), F.lit("")))


def _code(r: Rows, prompt: Column, language: Column, mode: Column, tests: Column, **more: Column | None) -> tuple[Column, Column]:
    return prompt, _json(language=language, execution_mode=mode, official_tests=tests, **{k: v if v is not None else None for k, v in more.items()})


def _input_text(x: Column) -> Column:
    """The arguments of a call as JSON text."""
    held = F.to_json(F.array(x), {"ignoreNullFields": "false"})
    return F.substring(held, F.lit(2), F.length(held) - 2)


def _humaneval(r: Rows) -> tuple[Column, Column]:
    end = lambda c: F.regexp_replace(c, r"\s+$", "")
    prompt, solution = end(r.text("prompt")), end(r.text("canonical_solution"))
    reference = F.concat(stripped(F.concat(prompt, F.lit("\n"), solution)), F.lit("\n"))
    inputs = r.raw("base_input")
    tests = F.array().cast("array<struct<input:string>>") if inputs is None or not r.types["base_input"].startswith("array") else F.transform(inputs, lambda x: F.struct(_input_text(x).alias("input")))
    expected = _json(language=F.lit("python"), execution_mode=F.lit("function"), function_name=r.text("entry_point"), official_tests=tests, test_script=stripped(r.text("test")), reference_solution=reference, solution=reference, score_variant=F.lit("plus"))
    return F.concat(F.lit(PYTHON_PROMPT), prompt, F.lit("\n")), expected


@dataclass(frozen=True)
class Recipe:
    """How a benchmark's rows become cases, and which components score them."""

    dataset: str
    split: str
    build: Callable[[Rows], tuple[Column, Column]]
    ids: tuple[str, ...]
    metadata: tuple[str, ...] = ()
    parser: str = "builtin/json_identity"
    metric: str = "builtin/llm_rubric"
    judges: int = 0
    samples: int = 1
    keep: Callable[[Rows], Column] | None = None
    variants: tuple[str, ...] | None = None  # None: none, (): any
    revision: str | None = None
    files: tuple[str, ...] = field(default=())

    @property
    def executes_code(self) -> bool:
        return self.metric.endswith("pass_rate")


def _math(dataset: str, split: str = "train") -> Recipe:
    return Recipe(
        dataset, split, lambda r: (F.concat(F.lit(MATH_PROMPT), r.text("problem", "content")), _json(answer=stripped(r.text("answer")))), ("problem_idx", "id"), ("problem_type", "source", "tag"),
        "builtin/math_answer", "builtin/math_equivalence",
    )


def _mcq(dataset: str, split: str, build: Callable[[Rows], tuple[Column, Column]], ids: tuple[str, ...], metadata: tuple[str, ...] = (), **more) -> Recipe:
    return Recipe(dataset, split, build, ids, metadata, "builtin/choice_letter", "builtin/choice_accuracy", **more)


def _answer(*names: str) -> Callable[[Rows], Column]:
    return lambda r: r.text(*names)


_OPTIONS = lambda r: r.array("options")
_FAMILY = lambda r: _choice(r, ("question",), _OPTIONS, _answer("answer_letter", "answer"))
_LEVELS = ("discipline", "field", "subfield", "difficulty")

#: The catalogue (fixed values: names, public datasets, splits, columns and components of each benchmark).
RECIPES: dict[str, Recipe] = {
    "aime_2025": _math("MathArena/aime_2025"),
    "aime_2026": _math("MathArena/aime_2026"),
    "apex_2025": _math("MathArena/apex_2025"),
    "beyond_aime": _math("ByteDance-Seed/BeyondAIME", "test"),
    "hmmt_feb_2025": _math("MathArena/hmmt_feb_2025"),
    "hmmt_nov_2025": _math("MathArena/hmmt_nov_2025"),
    "phybench": _math("Eureka-Lab/PHYBench"),
    "imo_answerbench": Recipe(
        "Hwilner/imo-answerbench", "train", lambda r: (F.concat(F.lit(MATH_PROMPT), r.text("Problem")), _json(answer=stripped(r.text("Short Answer", "answer")))), ("Problem ID",), ("Category", "Subcategory", "Source"),
        "builtin/math_answer", "builtin/math_equivalence",
    ),
    "mmlu_pro": _mcq("TIGER-Lab/MMLU-Pro", "test", lambda r: _choice(r, ("question",), _OPTIONS, _answer("answer")), ("item_id", "id"), ("category", "src")),
    "supergpqa": _mcq("m-a-p/SuperGPQA", "train", _FAMILY, ("item_id",), _LEVELS),
    "encyclo_k": _mcq("m-a-p/Encyclo-K", "test", _FAMILY, ("item_id",), _LEVELS),
    "babe": _mcq(
        "mediabiasgroup/BABE", "test",
        lambda r: (choice_prompt(r.text("text"), F.array(F.lit("Entirely factual"), F.lit("Opinionated or subjective"))), _json(choice=F.when(F.coalesce(r.text("label", default="0").try_cast("double").cast("int"), F.lit(0)) == 0, "A").otherwise("B"))),
        ("uuid",), ("outlet", "topic", "type", "label_opinion"),
    ),
    "gpqa_diamond": _mcq("fingertap/GPQA-Diamond", "test", _gpqa, ("item_id",)),
    "mmmlu": _mcq("openai/MMMLU", "test", lambda r: _choice(r, ("Question",), lambda x: F.array(*(x.text(c) for c in "ABCD")), _answer("Answer")), ("Unnamed: 0",), ("Subject",), variants=()),
    "superchem": _mcq("ZehuaZhao/SUPERChem", "train", _superchem, ("uuid",), ("field", "question_type"), variants=("en", "zh"), files=("SUPERChem-500.parquet",)),
    "frontierscience": Recipe("openai/frontierscience", "test", lambda r: (r.text("problem"), _json(rubric=r.text("answer"))), ("item_id",), ("subject", "task_group_id"), judges=1),
    "healthbench": Recipe("openai/healthbench", "test", _healthbench, ("prompt_id",), ("prompt_id", "example_tags"), judges=1, files=("2025-05-07-06-14-12_oss_eval.jsonl",)),
    "lpfqa": Recipe(
        "m-a-p/LPFQA", "train",
        lambda r: (r.text("prompt"), _json(response_reference=r.text("response_reference"), judge_prompt_template=r.text("judge_prompt_template", default="{response_reference}\n{response}"), judge_system_prompt=r.text("judge_system_prompt"))),
        ("prompt_id",), ("primary_domain",), judges=1,
    ),
    "simpleqa_verified": Recipe("google/simpleqa-verified", "eval", lambda r: (r.text("problem"), _json(answer=r.text("answer"))), ("original_index",), ("topic", "answer_type", "multi_step", "requires_reasoning"), metric="builtin/panel_of_judges", judges=2),
    "hle": Recipe(
        "cais/hle", "test", lambda r: (r.text("question"), _json(answer=r.text("answer"))), ("id",), (), metric="builtin/panel_of_judges", judges=2, variants=(),
        keep=lambda r: F.lit("text_only" not in [t.strip() for t in (r.variant or "").split(",")]) | (stripped(r.text("image")) == ""),
    ),
    "procbench": Recipe(
        "ifujisawa/procbench", "train", lambda r: (r.text("prompt"), _json(answer=r.raw("label")["final"] if "final" in r.types.get("label", "") else None)), ("problem_name",), ("task_name", "example_name"), "builtin/text", judges=1, variants=(),
        keep=lambda r: F.lit(r.variant is None) | (r.text("task_name") == F.lit(r.variant or "")), files=("combined_dataset.jsonl",),
    ),
    "rolebench": Recipe("ZenMoore/RoleBench", "test", _rolebench, ("item_id",), ("role",), judges=1, variants=("instruction_generalization_eng", "role_generalization_eng")),
    "codeforces": Recipe(
        "open-r1/codeforces", "test",
        lambda r: _code(r, r.text("prompt"), r.text("language", default="python"), r.text("input_mode", default="stdio"), r.tests("official_tests"), time_limit=r.raw("time_limit"), memory_limit=r.raw("memory_limit"), generated_checker=r.raw("generated_checker"), checker_language=r.raw("checker_language")),
        ("id",), ("contest_id", "language", "rating", "input_mode"), "builtin/code_text", "builtin/codeforces_pass_rate", 1, 2,
        keep=lambda r: (F.lower(stripped(r.text("input_mode"))) == "stdio") & (r.text("interaction_format") == "") & F.coalesce(r.text("official_tests_complete", default="false").try_cast("boolean"), F.lit(False)), revision="verifiable-prompts",
    ),
    "aethercode": Recipe(
        "m-a-p/AetherCode", "test",
        lambda r: _code(r, F.concat(F.lit(CPP_PROMPT), r.text("description", "prompt_text")), F.lit("cpp"), F.lit("stdio"), r.tests("test_cases", "official_tests"), time_limit=r.raw("time_limit"), generated_checker=r.raw("checker", "generated_checker"), checker_language=F.lit("cpp")),
        ("id",), ("difficulty", "contest_category", "contest_name", "date", "year"), "builtin/code_text", "builtin/aethercode_pass_rate", 1, 2, keep=lambda r: F.size(r.tests("test_cases", "official_tests")) > 0, revision="v1_2024",
    ),
    "livecodebench": Recipe(
        "livecodebench/code_generation_lite", "test",
        lambda r: _code(r, r.text("prompt", "question_content"), r.text("language", default="python"), r.text("execution_mode", "input_mode", default="stdio"), r.tests("public_tests", "official_tests", "public_test_cases"), function_name=r.raw("function_name"), time_limit=r.raw("time_limit")),
        ("question_id", "item_id"), ("platform", "contest_id", "difficulty", "contest_date"), "builtin/code_text", "builtin/livecodebench_pass_rate", 1, 2, keep=lambda r: F.size(r.tests("public_tests", "official_tests", "public_test_cases")) > 0,
        revision="release_v6", files=("test6.jsonl",),
    ),
    "humaneval_plus": Recipe("evalplus/humanevalplus", "test", _humaneval, ("task_id",), ("entry_point",), "builtin/code_text", "builtin/humaneval_pass_rate", 1, 2),
}


def recipe(name: str) -> tuple[Recipe, str | None]:
    """The recipe and variant of ``name`` or ``name:variant``; an unknown name or variant is an error."""
    base, _, variant = name.partition(":")
    if base not in RECIPES:
        near = difflib.get_close_matches(base, RECIPES, 3, 0.5)
        raise KeyError(f"unknown benchmark: {base}" + (f"; did you mean {', '.join(near)}?" if near else ""))
    found = RECIPES[base]
    if variant and (found.variants is None or found.variants and variant not in found.variants):
        raise ValueError(f"{base} has no variant {variant}")
    return found, variant or None


def materialized(rows: DataFrame, name: str) -> DataFrame:
    """Cases of a benchmark from its rows: dataset_id, revision, case_id, case_key, input, expected_output, metadata,
    position. Default ids count all rows, also those that the benchmark's filter leaves out. Columns that the rows lack are
    empty; rows that are null in a column are as if they lacked it; extra columns are ignored."""
    found, variant = recipe(name)
    numbered = positions(rows, "__position")
    r = Rows(numbered, found.split, variant)
    prompt, expected = found.build(r)
    joined = lambda c: F.array_join(F.transform(F.col(f"`{c}`"), lambda x: x.cast("string")), ", ") if r.types[c].startswith("array") else F.col(f"`{c}`").cast("string")
    meta = [x for c in found.metadata if c in r.types for x in (F.lit(c.lower()), joined(c))]
    if found.variants is not None:
        meta += [F.lit("variant"), F.lit(variant or "")]
    metadata = F.map_filter(F.create_map(*meta), lambda _, v: v.isNotNull()) if meta else F.create_map().cast("map<string,string>")
    kept = numbered if found.keep is None else numbered.filter(found.keep(r))
    case_id = r.id(*found.ids)
    return kept.select(
        F.lit(found.dataset).alias("dataset_id"), F.lit(found.split).alias("revision"), case_id.alias("case_id"), case_key(F.lit(found.dataset), case_id).alias("case_key"), prompt.alias("input"), expected.alias("expected_output"),
        metadata.alias("metadata"), F.col("__position").alias("position"),
    )

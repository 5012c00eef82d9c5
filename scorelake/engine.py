"""Running an evaluation: cases are fanned out, generated, reduced, parsed, scored and judged as DataFrames, and every
step is recorded as events from which all results are folded."""

from __future__ import annotations

import hashlib
import json
import random
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.adapters import Generation
from scorelake.functions import identity, text
from scorelake.operators import candidates, fold, judging, metrics, stats
from scorelake.operators import store as store_ops
from scorelake.sources import benchmarks
from scorelake.sources.datasets import placed
from scorelake.sources.runs import RunStore
from scorelake.sources.secrets import sanitized
from scorelake.storage import staged

STAGES = ["generate", "reduce", "parse", "score", "judge"]
DUEL_PROMPT = "Choose the better candidate. Reply A or B only.\nA: {}\nB: {}"  # fixed value

#: Parsers: column of the raw output (text) → column of the parsed text.
PARSERS: dict[str, Callable[[Column], Column]] = {
    "builtin/json_identity": lambda c: c,
    "builtin/text": lambda c: c,
    "builtin/choice_letter": text.choice_letter,
    "builtin/math_answer": text.math_answer,
    "builtin/code_text": text.code_text,
}

#: Pure metrics: (parsed text, parsed JSON, expected JSON) → score column. f1 and bleu are computed by token_scores.
METRICS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "builtin/exact_match": lambda _, p, e: metrics.exact_match(p, F.coalesce(e, F.lit("null"))),
    "builtin/choice_accuracy": lambda t, _, e: metrics.choice_accuracy(t, e),
    "builtin/math_equivalence": lambda t, _, e: metrics.math_equivalence(t, e),
    "builtin/procbench_final_accuracy": lambda _, p, e: metrics.final_value_match(p, F.coalesce(e, F.lit("null"))),
}
TOKEN_METRICS = {"builtin/f1": "f1", "builtin/bleu": "precision"}
JUDGED = ("builtin/llm_rubric", "builtin/panel_of_judges", "builtin/majority_vote_judge", "builtin/pairwise_judge")


def _quoted(c: Column) -> Column:
    held = F.to_json(F.array(c))
    return F.substring(held, F.lit(2), F.length(held) - 2)


def _member(payload: Column, path: str) -> Column:
    """The JSON text of a member, whatever its type; "null" if it is missing."""
    return F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json(payload), path, "variant")), F.lit("null"))


def _rendered(value_json: Column) -> Column:
    """A JSON value as text: strings as they are, null as null, other values as JSON."""
    plain = F.get_json_object(F.concat(F.lit("["), value_json, F.lit("]")), "$[0]")
    return F.when(value_json == "null", None).when(F.startswith(value_json, F.lit('"')), plain).otherwise(value_json)


def _dumped(value: Any) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def _seed(*axes: Any) -> int:
    """A seed of 32 bits from what it is for."""
    return int(hashlib.sha256(":".join(map(str, axes)).encode()).hexdigest()[:8], 16)


def demo_generator(case: dict, seed: int) -> Any:
    """Gives the expected answer back as it is, or the input where there is none."""
    return case["input"] if case.get("expected_output") is None else case["expected_output"]


def demo_judge(prompt: str, seed: int) -> str:
    return "pass" if prompt.strip() else "fail"


@dataclass
class Retry:
    attempts: int = 3
    delay: float = 0.01
    backoff: float = 2.0


def transient(error: BaseException) -> bool:
    """Errors worth another attempt: marked retryable, time-outs, lost connections, too many requests, server errors."""
    status = getattr(error, "status_code", getattr(error, "status", None))
    marked = getattr(error, "retryable", None)
    if marked is not None:
        return bool(marked)
    return isinstance(error, (TimeoutError, ConnectionError)) or status == 429 or isinstance(status, int) and 500 <= status < 600


def calling(function: Callable[..., Any], retry: Retry, per_minute: float | None = None) -> Callable[..., tuple[Any, str | None]]:
    """(result, error) of ``function``: transient errors are retried with growing delays, others are returned as text. At
    most ``per_minute`` calls a minute start, from all threads together."""
    lock, due = threading.Lock(), [0.0]

    def wait() -> None:
        with lock:
            now = time.monotonic()
            due[0] = max(now, due[0])
            pause, due[0] = due[0] - now, due[0] + 60.0 / per_minute
        time.sleep(pause)

    def call(*args: Any) -> tuple[Any, str | None]:
        for attempt in range(1, retry.attempts + 1):
            if per_minute:
                wait()
            try:
                return function(*args), None
            except Exception as error:  # noqa: BLE001 - a failing call is a result
                if attempt == retry.attempts or not transient(error):
                    return None, str(error) or type(error).__name__
                pause = retry.delay * retry.backoff ** (attempt - 1) * random.uniform(0.9, 1.1)
                time.sleep(max(float(getattr(error, "retry_after", 0) or 0), pause))
        return None, "no attempt"

    return call


def _all(call: Callable[..., Any], jobs: Iterable[tuple], threads: int) -> list[Any]:
    """Results of the calls in the order of ``jobs``, ``threads`` at a time."""
    held = list(jobs)
    if threads < 2 or len(held) < 2:
        return [call(*job) for job in held]
    with ThreadPoolExecutor(min(threads, len(held))) as pool:
        return list(pool.map(lambda job: call(*job), held))


def _case(case_id: str, raw: str, gold: str | None) -> dict[str, Any]:
    return {"case_id": case_id, "input": json.loads(raw), "expected_output": None if gold is None else json.loads(gold)}


@dataclass
class Experiment:
    """What to run over a dataset of cases (see sources.datasets).

    Callables by name, which an experiment names like built-in components: generator(case, seed) → output or Generation;
    judges[name](prompt, seed) → response; selector_functions[name](outputs, case, ask) → positions of those to keep;
    reducer_functions[name](outputs, case) → output; parser_functions[name](output, case) → value;
    metric_functions[name](parsed, case) → number; workflows[name](subject, case, ask) → number, mapping with value (and
    label) or None, where ask(prompt, judge=None) asks one judge (the first if none is named) and returns the response.
    subjects[metric] tells what a workflow sees: "candidate" (the reduced output, the default), "selection" (the list of
    all outputs that were selected) or "trace" (the trace of the reduced candidate). What a callable raises is recorded as
    the failure of that case.

    ``concurrency`` tasks call at once (as many as there are cores if None), with ``threads`` calls each; ``per_minute`` holds for all of them together.
    ``cache``: outputs of the same generator, input and seed are taken from the store. ``blobs``: executions of judges are
    stored by their hash.
    """

    cases: DataFrame
    generator: Callable[[dict, int], Any] = demo_generator
    generator_id: str = "builtin/demo_generator"
    metric_ids: list[str] = field(default_factory=lambda: ["builtin/exact_match"])
    metric_functions: dict[str, Callable[[Any, dict], float]] = field(default_factory=dict)
    parser_functions: dict[str, Callable[[Any, dict], Any]] = field(default_factory=dict)
    reducer_functions: dict[str, Callable[[list, dict], Any]] = field(default_factory=dict)
    selector_functions: dict[str, Callable[[list, dict, Callable], list[int]]] = field(default_factory=dict)
    workflows: dict[str, Callable[[Any, dict, Callable], Any]] = field(default_factory=dict)
    subjects: dict[str, str] = field(default_factory=dict)
    concurrency: int | None = None
    threads: int = 4
    cache: bool = False
    blobs: bool = False
    parser: str | None = None
    reducer: str | None = "builtin/majority_vote"
    selector: str | None = None
    judges: dict[str, Callable[[str, int], str]] = field(default_factory=dict)
    samples: int = 1
    seeds: list[int] = field(default_factory=list)
    rubric: str | None = None
    retry: Retry = field(default_factory=Retry)
    per_minute: float | None = None
    metadata: dict[str, Any] = field(default_factory=dict)
    subscribers: list[Callable[[str, str, str], None]] = field(default_factory=list)  # called with run id, stage, before or after

    def identity(self) -> dict[str, Any]:
        """What determines the results; metadata, storage and retries don't. The cases count by a hash of their contents,
        combined in any order."""
        rows = self.cases.select(F.xxhash64("dataset_id", "case_id", "input", "expected_output").alias("h"))
        digest = rows.agg(F.count("*").alias("n"), F.sum(F.shiftright("h", 20).cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
        return {
            "cases": [int(digest["n"]), str(digest["s"]), int(digest["x"] or 0)], "generator": self.generator_id, "metrics": self.metric_ids, "parser": self.parser, "reducer": self.reducer, "selector": self.selector,
            "judges": sorted(self.judges), "samples": self.samples, "seeds": self.seeds, "rubric": self.rubric,
            **({"subjects": self.subjects} if self.subjects else {}),
        }

    def compile(self) -> tuple[str, str]:
        """(run id, snapshot as JSON). A metric that is neither known nor given is an error, as is a judged one without
        judges and an empty list of metrics."""
        if not self.metric_ids:
            raise ValueError("an experiment needs a metric")
        for m in self.metric_ids:
            if m in JUDGED and not self.judges:
                raise ValueError(f"{m} needs a judge")
            if not any(m in known for known in (METRICS, TOKEN_METRICS, JUDGED, self.metric_functions, self.workflows)):
                raise ValueError(f"unknown metric: {m}")
        for kind, name, known in (("parser", self.parser, {*PARSERS, *self.parser_functions}), ("reducer", self.reducer, {"builtin/majority_vote", *self.reducer_functions}), ("selector", self.selector, {"builtin/best_of_n", *self.selector_functions})):
            if name is not None and name not in known:
                raise ValueError(f"unknown {kind}: {name}")
        for m, subject in self.subjects.items():
            if m not in self.workflows or subject not in ("candidate", "selection", "trace"):
                raise ValueError(f"no workflow sees {subject}: {m}")
        if self.selector == "builtin/best_of_n" and not self.judges:
            raise ValueError("builtin/best_of_n needs a judge")
        told = self.identity()
        run_id = identity.content_hash(told)
        return run_id, identity.canonical_json({"run_id": run_id, "identity": told, "provenance": sanitized(self.metadata, ("metadata",))})

    def run(self, store: RunStore, until: str = "judge", policy: str = "auto") -> str:
        """Runs what isn't done yet up to ``until`` and returns the run id. policy: auto takes a run that is completed up to
        there as it is and goes on with any other, rerun starts over, error refuses a run that exists."""
        if until not in STAGES:
            raise ValueError(f"unknown stage: {until}")
        run_id, snapshot = self.compile()
        if store.resume(run_id) is not None:
            if policy == "error":
                raise ValueError(f"run {run_id} exists")
            if policy == "rerun":
                store.clear(run_id)
            elif policy == "auto":
                held = fold.run_states(staged(fold.event_log(store.events(run_id)))).first()
                if held is not None and held["status"] == "completed" and held["completed_through_stage"] in STAGES[STAGES.index(until) :]:
                    return run_id
        store.save_snapshot(run_id, snapshot)
        return _Run(self, store, run_id).to(until)

    def replay(self, store: RunStore, stage: str) -> str:
        """Runs again from ``stage`` on; what was generated before stays unless the stage is generate."""
        run_id, _ = self.compile()
        if store.resume(run_id) is None:
            raise ValueError(f"run {run_id} isn't stored")
        return _Run(self, store, run_id).to("judge", again=stage)

    def rejudge(self, store: RunStore, metric_ids: list[str]) -> str:
        """Asks the judges of the named metrics again; everything else of the stored run stays."""
        if any(m not in JUDGED and m not in self.workflows or m not in self.metric_ids for m in metric_ids):
            raise ValueError("only judged metrics of the experiment can be judged again")
        run_id, _ = self.compile()
        if store.resume(run_id) is None:
            raise ValueError(f"run {run_id} isn't stored")
        return _Run(self, store, run_id).to("judge", again="judge", only=metric_ids)


class _Run:
    def __init__(self, experiment: Experiment, store: RunStore, run_id: str) -> None:
        self.x, self.store, self.run_id = experiment, store, run_id
        self.spark = store.spark

    # --- events

    def _events(self, *kinds: str) -> DataFrame:
        return self.store.events(self.run_id).filter(F.col("event_type").isin(*kinds))

    def _done(self, kind: str) -> DataFrame:
        """Payloads of the events of a kind, the last of each candidate and metric."""
        return self._events(kind).groupBy("case_key", "candidate_id", "candidate_index", "metric_id").agg(F.max_by("event_json", "sequence").alias("event_json"))

    def _last(self, kind: str) -> DataFrame:
        """The last event of a kind of each case."""
        newest = F.max_by(F.struct("candidate_id", "candidate_index", "event_json"), "sequence")
        return self._events(kind).groupBy("case_key").agg(newest.alias("e")).select("case_key", "e.*")

    def _record(self, rows: DataFrame, kind: Column | str, payload: dict[str, Column]) -> DataFrame:
        """Appends one event for each row, numbered after the events before, and returns the rows as they were recorded.
        The run's lease keeps other writers away meanwhile."""
        kind = F.lit(kind) if isinstance(kind, str) else kind
        have = {"dataset_id", "case_id", "case_key", "candidate_id", "candidate_index", "metric_id", "seed", "error_message"}
        rows = staged(rows.withColumn("__kind", kind).withColumn("__id", F.monotonically_increasing_id()))
        numbered = placed(rows, "__n")
        start = self.store.events(self.run_id).agg(F.coalesce(F.max("sequence"), F.lit(-1))).first()[0]
        now = F.current_timestamp()
        at = {c: F.col(c) if c in rows.columns else F.lit(None) for c in have}
        types = {"candidate_index": "int", "seed": "bigint"}
        base = {"schema_version": F.lit("1"), "event_type": F.col("__kind"), "run_id": F.lit(self.run_id), "occurred_at": F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")}
        shown = F.to_json(F.struct(*(v.alias(k) for k, v in (base | {c: at[c].cast(types.get(c, "string")) for c in sorted(have)} | payload).items())))
        events = numbered.select(
            F.lit(self.run_id).alias("run_id"), (F.col("__n") + F.lit(int(start))).alias("sequence"), F.col("__kind").alias("event_type"), F.lit("1").alias("schema_version"), now.alias("occurred_at"),
            *(at[c].cast(types.get(c, "string")).alias(c) for c in ("dataset_id", "case_id", "case_key", "candidate_id", "candidate_index", "metric_id", "seed", "error_message")), shown.alias("event_json"),
        )
        self.store.append_events(events)
        return rows.drop("__id")

    def _mark(self, kind: str, **members: str) -> None:
        rows = self.spark.range(1).select(F.lit(members.get("error_message")).cast("string").alias("error_message"))
        self._record(rows, kind, {k: F.lit(v) for k, v in members.items() if k != "error_message"})

    def to(self, until: str, again: str | None = None, only: list[str] | None = None) -> str:
        """Runs the stages up to ``until``. A run is started once: what resumes it doesn't start it again, so a run that
        has failed in part stays so. An error that stops a stage is recorded as the failure of the run and raised."""
        self.only = only
        with self.store.lease(self.run_id):
            if self._events("run_started").isEmpty():
                self._mark("run_started")
            fresh = STAGES.index(again) if again else len(STAGES)
            try:
                for i, stage in enumerate(STAGES[: STAGES.index(until) + 1]):
                    for told in self.x.subscribers:
                        told(self.run_id, stage, "before")
                    self.spark.sparkContext.setJobDescription(f"{stage} {self.run_id[:12]}")
                    getattr(self, stage)(fresh <= i)
                    for told in self.x.subscribers:
                        told(self.run_id, stage, "after")
            except Exception as error:
                self._mark("run_failed", error_message=str(error)[:10_000] or type(error).__name__)
                raise
            finally:
                self.spark.sparkContext.setJobDescription(None)
            self._mark("run_completed", completed_through_stage=until)
        return self.run_id

    # --- stages

    def _cases(self) -> DataFrame:
        return self.x.cases.select("dataset_id", "case_id", "case_key", "input", "expected_output")

    def _tasks(self) -> int:
        return max(1, self.x.concurrency or self.spark.sparkContext.defaultParallelism)

    def _spread(self, rows: DataFrame) -> tuple[DataFrame, float | None]:
        """Rows in as many tasks as may call at once, and each task's share of the calls a minute."""
        n = self._tasks()
        return rows.repartition(n), self.x.per_minute / n if self.x.per_minute else None

    def generate(self, again: bool) -> None:
        items = candidates.work_items(self.x.cases, self.run_id, max(1, self.x.samples), self.x.seeds or None)
        if not again:
            items = candidates.pending(items, self._events("generation_completed"), ["case_key", "candidate_index"])
        rows = items.join(self._cases().drop("dataset_id", "case_id"), "case_key")
        rows = rows.withColumn("cache_key", F.sha2(F.to_json(F.array(F.lit(self.x.generator_id), "input", F.col("seed").cast("string"))), 256))
        shape = ["dataset_id", "case_id", "case_key", "candidate_index", "candidate_id", "seed", "cache_key"]
        hits: DataFrame | None = None
        if self.x.cache:
            held = staged(store_ops.cached(rows, self.store.cache("generate").withColumnRenamed("payload", "__held"), "cache_key"))
            hits = held.filter("__held is not null").select(*shape, F.col("__held").alias("output_json"), F.lit(None).cast("string").alias("more"), F.lit(None).cast("string").alias("error_message"), F.lit(True).alias("cache_hit"))
            rows = held.filter("__held is null").drop("__held")
        rows, rate = self._spread(rows)
        call, retry, threads = getattr(self.x.generator, "generation", self.x.generator), self.x.retry, self.x.threads

        def generated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            made = calling(call, retry, rate)
            for batch in batches:
                told = _all(made, ((_case(c, i, g), int(s)) for c, i, g, s in zip(batch["case_id"], batch["input"], batch["expected_output"], batch["seed"])), threads)
                whole = [v if isinstance(v, Generation) else Generation(v) for v, _ in told]
                more = [_dumped({k: v for k, v in (("token_usage", g.token_usage), ("conversation", g.conversation), ("trace", g.trace)) if v is not None}) for g in whole]
                yield batch[shape].assign(output_json=[None if e else _dumped(g.output) for g, (_, e) in zip(whole, told)], more=more, error_message=[e for _, e in told], cache_hit=False)

        made = rows.mapInPandas(generated, "dataset_id string, case_id string, case_key string, candidate_index int, candidate_id string, seed bigint, cache_key string, output_json string, more string, error_message string, cache_hit boolean")
        made = made if hits is None else made.unionByName(hits)
        ok, extra = F.col("error_message").isNull(), F.try_parse_json("more")
        result = F.struct("candidate_id", F.try_parse_json("output_json").alias("final_output"), *(F.try_variant_get(extra, f"$.{k}", "variant").alias(k) for k in ("token_usage", "conversation", "trace")))
        rows = self._record(made, F.when(ok, "generation_completed").otherwise("generation_failed"), {"result": F.when(ok, result), "cache_hit": F.col("cache_hit")})
        if self.x.cache:
            new = rows.filter("error_message is null and not cache_hit").select(F.lit("generate").alias("stage"), "cache_key", F.col("output_json").alias("payload"), F.current_timestamp().alias("written_at"))
            self.store.save_cache(new)

    def _outputs(self) -> DataFrame:
        """case_key, candidate_id, candidate_index, output_json, output (text) of what was generated."""
        return self._done("generation_completed").select("case_key", "candidate_id", "candidate_index", _member(F.col("event_json"), "$.result.final_output").alias("output_json")).withColumn("output", _rendered(F.col("output_json")))

    def _selected(self) -> DataFrame:
        """Outputs that the selector left: all without one; none of a case whose selection failed."""
        outputs = self._outputs()
        if self.x.selector is None:
            return outputs
        kept = self._last("selection_completed").select("case_key", F.explode(F.from_json(F.get_json_object("event_json", "$.candidate_ids"), "array<string>")).alias("candidate_id"))
        return outputs.join(kept, ["case_key", "candidate_id"])

    def select(self) -> None:
        """Selects candidates of the cases without a selection: an earlier one holds whatever is run again."""
        rows = candidates.pending(self._outputs(), self._events("selection_completed"), ["case_key"]).join(self._cases(), "case_key")
        judges, retry, run_id, name, given = self.x.judges, self.x.retry, self.run_id, self.x.selector, self.x.selector_functions.get(self.x.selector)
        rate = self.x.per_minute / self._tasks() if self.x.per_minute else None

        def chosen(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("candidate_index", kind="stable").reset_index(drop=True)
            row, ask = group.iloc[0], _Asking(judges, retry, rate, f"{run_id}:{group['case_key'][0]}:{name}")
            try:
                outputs = [json.loads(o) for o in group["output_json"]]
                kept = given(outputs, _case(row["case_id"], row["input"], row["expected_output"]), ask) if given else [_best_of(list(group["output"]), ask)]
                if not kept:
                    raise ValueError("the selector left no candidate")
                told = {"ids": [str(group["candidate_id"][int(i)]) for i in kept], "error_message": None}
            except Exception as error:  # noqa: BLE001 - a failing selection is a result
                told = {"ids": None, "error_message": str(error) or type(error).__name__}
            return pd.DataFrame([{c: row[c] for c in ("dataset_id", "case_id", "case_key")} | told])

        made = rows.repartition(self._tasks(), "case_key").groupBy("case_key").applyInPandas(chosen, "dataset_id string, case_id string, case_key string, ids array<string>, error_message string")
        ok = F.col("error_message").isNull()
        self._record(made, F.when(ok, "selection_completed").otherwise("selection_failed"), {"candidate_ids": F.col("ids"), "metadata": F.when(ok, F.struct(F.lit(name).alias("selector_id")))})

    def reduce(self, again: bool) -> None:
        if self.x.selector is not None:
            self.select()
        outputs, own = self._selected(), self.x.reducer_functions.get(self.x.reducer or "")
        if not again:
            outputs = candidates.pending(outputs, self._events("reduction_completed"), ["case_key"])
        if own is not None:

            def reduced(group: pd.DataFrame) -> pd.DataFrame:
                group = group.sort_values("candidate_index", kind="stable").reset_index(drop=True)
                row = group.iloc[0]
                value, error = calling(own, Retry(1))([json.loads(o) for o in group["output_json"]], _case(row["case_id"], row["input"], row["expected_output"]))
                shown = None if error else _dumped(value)
                same = [i for i, o in zip(group["candidate_index"], group["output_json"]) if shown is not None and json.loads(o) == value]
                return pd.DataFrame([{"case_key": row["case_key"], "candidate_index": same[0] if same else int(row["candidate_index"]), "output_json": shown, "error_message": error}])

            chosen = outputs.join(self._cases().drop("dataset_id"), "case_key").groupBy("case_key").applyInPandas(reduced, "case_key string, candidate_index int, output_json string, error_message string")
        else:
            if self.x.reducer is None:
                chosen = candidates.first_candidate(outputs, ["case_key"], "candidate_index", "output_json")
            else:
                vote = candidates.majority_vote(outputs, ["case_key"], "candidate_index", "output_json").select("case_key", F.col("output_json").alias("__won"))
                won = outputs.join(vote, "case_key").filter(F.col("output_json").eqNullSafe(F.col("__won")))
                chosen = won.groupBy("case_key").agg(F.min("candidate_index").alias("candidate_index"), F.first("output_json").alias("output_json"))
            chosen = chosen.withColumn("error_message", F.lit(None).cast("string"))
        sources = outputs.groupBy("case_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("candidate_index", "candidate_id"))), lambda c: c["candidate_id"]).alias("sources"))
        rows = chosen.join(sources, "case_key").join(self._cases().drop("input", "expected_output"), "case_key").withColumn("candidate_id", F.concat("case_id", F.lit("-candidate-"), F.col("candidate_index").cast("string")))
        ok = F.col("error_message").isNull()
        result = F.struct("candidate_id", F.try_parse_json("output_json").alias("final_output"))
        self._record(rows, F.when(ok, "reduction_completed").otherwise("reduction_failed"), {"result": F.when(ok, result), "source_candidate_ids": F.col("sources")})

    def _reduced(self) -> DataFrame:
        rows = self._last("reduction_completed").select("case_key", "candidate_id", "candidate_index", _member(F.col("event_json"), "$.result.final_output").alias("output_json"))
        return rows.withColumn("output", _rendered(F.col("output_json")))

    def parse(self, again: bool) -> None:
        rows, name = self._reduced().join(self._cases(), "case_key"), self.x.parser
        if not again:
            rows = candidates.pending(rows, self._events("parse_completed"), ["case_key"])
        own = self.x.parser_functions.get(name or "")
        keep = ["dataset_id", "case_id", "case_key", "candidate_id", "candidate_index"]
        if own is not None:

            def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                made = calling(own, Retry(1))
                for batch in batches:
                    told = [made(json.loads(o), _case(c, i, g)) for o, c, i, g in zip(batch["output_json"], batch["case_id"], batch["input"], batch["expected_output"])]
                    yield batch[keep].assign(parsed_json=[None if e else _dumped(v) for v, e in told], error_message=[e for _, e in told])

            rows = rows.mapInPandas(parsed, "dataset_id string, case_id string, case_key string, candidate_id string, candidate_index int, parsed_json string, error_message string")
        else:
            same = name in (None, "builtin/json_identity")
            value = F.col("output_json") if same else F.coalesce(_quoted(PARSERS[name](F.col("output"))), F.lit("null"))
            rows = rows.select(*keep, value.alias("parsed_json"), F.lit(None).cast("string").alias("error_message"))
        ok = F.col("error_message").isNull()
        result = F.struct(F.when(F.col("parsed_json") != "null", F.try_parse_json("parsed_json")).alias("value"), F.lit(name).cast("string").alias("format"))
        self._record(rows, F.when(ok, "parse_completed").otherwise("parse_failed"), {"result": F.when(ok, result)})

    def score(self, again: bool) -> None:
        parsed = self._last("parse_completed").select("case_key", "candidate_id", "candidate_index", _member(F.col("event_json"), "$.result.value").alias("parsed_json")).withColumn("parsed", _rendered(F.col("parsed_json")))
        rows = staged(parsed.join(self._cases(), "case_key"))
        keep = ["dataset_id", "case_id", "case_key", "candidate_id", "candidate_index"]
        found: DataFrame | None = None
        for m in self.x.metric_ids:
            if m in METRICS:
                part = rows.select(*keep, METRICS[m](F.col("parsed"), F.col("parsed_json"), F.col("expected_output")).alias("value"), F.lit(None).cast("string").alias("error_message"))
            elif m in TOKEN_METRICS:
                scored = metrics.token_scores(rows.withColumn("gold", text.expected_text(F.coalesce("expected_output", F.lit("null")), "answer")), keep, "parsed", "gold")
                part = scored.select(*keep, F.col(TOKEN_METRICS[m]).alias("value"), F.lit(None).cast("string").alias("error_message"))
            elif m in self.x.metric_functions:
                part = self._called_metric(rows, keep, self.x.metric_functions[m])
            else:
                continue
            part = part.withColumn("metric_id", F.lit(m))
            found = part if found is None else found.unionByName(part)
        if found is None:
            return
        if not again:
            found = candidates.pending(found, self._events("score_completed"), ["case_key", "metric_id"])
        ok = F.col("error_message").isNull()
        self._record(found, F.when(ok, "score_completed").otherwise("score_failed"), {"score": F.when(ok, F.struct("metric_id", "value")), "error": F.when(~ok, F.struct("metric_id", F.col("error_message").alias("reason")))})

    def _called_metric(self, rows: DataFrame, keep: list[str], function: Callable[[Any, dict], float]) -> DataFrame:
        def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            made = calling(lambda p, case: float(function(p, case)), Retry(1))
            for batch in batches:
                told = [made(json.loads(p), _case(c, i, g)) for p, c, i, g in zip(batch["parsed_json"], batch["case_id"], batch["input"], batch["expected_output"])]
                yield batch[keep].assign(value=[v for v, _ in told], error_message=[e for _, e in told])

        return rows.mapInPandas(scored, "dataset_id string, case_id string, case_key string, candidate_id string, candidate_index int, value double, error_message string")

    def judge(self, again: bool) -> None:
        for m in self.x.metric_ids:
            if (m in JUDGED or m in self.x.workflows) and (self.only is None or m in self.only):
                self._judged_by_workflow(m, again) if m in self.x.workflows else self._judged(m, again)

    def _unjudged(self, subjects: DataFrame, metric: str, again: bool) -> DataFrame:
        return subjects if again else candidates.pending(subjects, self._events("evaluation_completed").filter(F.col("metric_id") == metric), ["case_key"])

    def _evaluated(self, rows: DataFrame, failed: Column, execution: Column) -> None:
        """Records steps, evaluations and scores. rows: the case's columns, metric_id, value (null for none), label,
        error_message and calls (call_id, judge_model_id, repeat_index, response, label, score, error)."""
        rows = staged(rows.withColumn("__execution", F.to_json(execution)))
        calls = rows.select("dataset_id", "case_id", "case_key", "metric_id", F.explode("calls").alias("c"))
        step = calls.select("*", F.explode(F.array(F.lit("step_started"), F.when(F.col("c.error").isNull(), "step_completed").otherwise("step_failed"))).alias("__step")).withColumn("error_message", F.when(F.col("__step") == "step_failed", F.col("c.error")))
        self._record(step.select("dataset_id", "case_id", "case_key", "metric_id", "error_message", "__step", F.col("c.call_id").alias("__call"), F.col("c.judge_model_id").alias("__judge")), F.col("__step"), {"step_type": F.lit("judge_call"), "step_id": F.col("__call"), "judge_model_id": F.col("__judge")})
        if self.x.blobs:
            self.store.save_blobs(rows.filter("error_message is null"), "__execution")
        ref = F.concat(F.lit("sha256:"), F.sha2("__execution", 256)) if self.x.blobs else F.lit(None).cast("string")
        self._record(rows, F.when(failed, "evaluation_failed").otherwise("evaluation_completed"), {"execution": F.when(~failed, F.try_parse_json("__execution")), "execution_blob_ref": F.when(~failed, ref)})
        self._record(rows.filter(~failed & F.col("value").isNotNull()), "score_completed", {"score": F.struct("metric_id", "value", F.when(F.col("label").isNotNull(), F.struct("label")).alias("details"))})

    def _judged(self, m: str, again: bool) -> None:
        names, judges, retry, threads = sorted(self.x.judges), self.x.judges, self.x.retry, self.x.threads
        rubric = F.lit(self.x.rubric).cast("string")
        if m == "builtin/pairwise_judge":
            two = self._selected().filter("candidate_index < 2").groupBy("case_key").agg(F.max(F.when(F.col("candidate_index") == 0, F.col("output"))).alias("a"), F.max(F.when(F.col("candidate_index") == 1, F.col("output"))).alias("b"))
            subjects = two.filter("a is not null and b is not null").withColumn("prompt", judging.pairwise_prompt(rubric, F.col("a"), F.col("b")))
        else:
            subjects = self._reduced().withColumn("prompt", judging.rubric_prompt(rubric, F.col("output")))
        calls = judging.fan_out(self._unjudged(subjects.select("case_key", "prompt"), m, again), names, "pairwise" if m == "builtin/pairwise_judge" else "llm")
        seeded = calls.withColumn("seed", identity.judge_seed(F.lit(self.run_id), F.col("case_key"), F.lit(m), F.col("judge_model_id"), F.lit(0), F.col("repeat_index"), F.col("dimension_id"), F.col("candidate_indices")))
        rows, rate = self._spread(seeded)

        def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            made = {n: calling(j, retry, rate) for n, j in judges.items()}
            for batch in batches:
                told = _all(lambda n, p, s: made[n](p, s), ((n, p, int(s)) for n, p, s in zip(batch["judge_model_id"], batch["prompt"], batch["seed"])), threads)
                yield batch[["case_key", "call_id", "judge_model_id", "repeat_index"]].assign(response=[r if r is None else str(r) for r, _ in told], error=[e for _, e in told])

        answered = staged(rows.mapInPandas(asked, "case_key string, call_id string, judge_model_id string, repeat_index int, response string, error string"))
        label = text.first_word(F.col("response"))
        value = judging.pairwise_score(label) if m == "builtin/pairwise_judge" else text.pass_fail_score(label)
        judged = answered.withColumns({"label": label, "score": F.when(label.isNotNull(), value)})
        means = judging.mean_score(judged, ["case_key"])
        if m == "builtin/majority_vote_judge":
            means = means.join(judging.majority_score(judged, ["case_key"], "repeat_index").select("case_key", F.col("value").alias("__v"), F.col("winner").alias("label")), "case_key", "left").withColumn("mean", F.coalesce("__v", "mean")).drop("__v")
        else:
            means = means.withColumn("label", F.lit(None).cast("string"))
        listed = judged.groupBy("case_key").agg(F.array_sort(F.collect_list(F.struct("repeat_index", "call_id", "judge_model_id", "response", "label", "score", "error"))).alias("calls"), F.max("score").alias("__single"))
        rows = means.join(listed, "case_key").join(self._cases().drop("input", "expected_output"), "case_key")
        rows = rows.withColumns({"metric_id": F.lit(m), "value": judging.final_score(F.col("mean"), F.col("__single"), F.col("n"), F.col("failures")), "error_message": F.lit(None).cast("string")})
        status = F.when(F.col("failures") > 0, "partial_failure").otherwise("completed")
        self._evaluated(rows, F.lit(False), _execution(status))

    def _judged_by_workflow(self, m: str, again: bool) -> None:
        seen, kind = self._reduced().select("case_key", "candidate_index", "output_json"), self.x.subjects.get(m, "candidate")
        if kind == "selection":
            listed = self._selected().groupBy("case_key").agg(F.array_sort(F.collect_list(F.struct("candidate_index", "output_json"))).alias("l"))
            seen = listed.select("case_key", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["output_json"]), ","), F.lit("]")).alias("output_json"))
        elif kind == "trace":
            traces = self._done("generation_completed").select("case_key", "candidate_index", _member(F.col("event_json"), "$.result.trace").alias("output_json"))
            seen = seen.drop("output_json").join(traces, ["case_key", "candidate_index"])
        rows, rate = self._spread(self._unjudged(seen.select("case_key", "output_json"), m, again).join(self._cases(), "case_key"))
        run, judges, retry, run_id, threads = self.x.workflows[m], self.x.judges, self.x.retry, self.run_id, self.x.threads

        def worked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            limited = {n: calling(j, retry, rate) for n, j in judges.items()}

            def one(key: str, subject: str, case_id: str, raw: str, gold: str | None) -> dict[str, Any]:
                ask = _Asking(judges, retry, None, f"{run_id}:{key}:{m}", limited)
                value, error = calling(run, Retry(1))(json.loads(subject), _case(case_id, raw, gold), ask)
                told = value if isinstance(value, dict) else {"value": value}
                number = told.get("value")
                return {"value": None if error or number is None else float(number), "label": told.get("label") if not error else None, "error_message": error, "calls": ask.calls}

            for batch in batches:
                told = _all(one, zip(batch["case_key"], batch["output_json"], batch["case_id"], batch["input"], batch["expected_output"]), threads)
                yield batch[["dataset_id", "case_id", "case_key"]].assign(**{k: [t[k] for t in told] for k in ("value", "label", "error_message", "calls")})

        calls = "array<struct<repeat_index:int,call_id:string,judge_model_id:string,response:string,label:string,score:double,error:string>>"
        made = staged(rows.mapInPandas(worked, f"dataset_id string, case_id string, case_key string, value double, label string, error_message string, calls {calls}")).withColumn("metric_id", F.lit(m))
        status = F.when(F.exists("calls", lambda c: c["error"].isNotNull()), "partial_failure").otherwise("completed")
        self._evaluated(made, F.col("error_message").isNotNull(), _execution(status))


def _execution(status: Column) -> Column:
    """The record of an evaluation: what was asked, answered and understood."""
    scores = F.when(F.col("value").isNotNull(), F.array(F.struct("metric_id", "value")))
    return F.struct(
        status.alias("status"), F.transform("calls", lambda c: F.struct(c["call_id"], c["judge_model_id"], c["repeat_index"])).alias("judge_calls"),
        F.transform("calls", lambda c: F.struct(c["judge_model_id"], c["response"].alias("raw_response"))).alias("judge_responses"), F.transform("calls", lambda c: F.struct(c["label"], c["score"])).alias("parsed_judgments"),
        F.transform(F.filter("calls", lambda c: c["error"].isNotNull()), lambda c: F.struct(c["call_id"], c["error"])).alias("failures"), scores.alias("scores"),
    )


class _Asking:
    """ask(prompt, judge=None) of selectors and workflows: the response of a judge, with a seed derived from what is asked;
    a judge that fails raises. Calls are kept."""

    def __init__(self, judges: dict[str, Callable], retry: Retry, rate: float | None, purpose: str, limited: dict[str, Callable] | None = None) -> None:
        self.made = limited or {n: calling(j, retry, rate) for n, j in judges.items()}
        self.names, self.purpose, self.calls = sorted(judges), purpose, []

    def __call__(self, prompt: str, judge: str | None = None) -> str:
        name = judge or (self.names[0] if self.names else None)
        if name not in self.made:
            raise ValueError(f"unknown judge: {name}")
        n = len(self.calls)
        response, error = self.made[name](prompt, _seed(self.purpose, name, n))
        told = None if response is None else str(response)
        self.calls.append({"repeat_index": n, "call_id": f"call-{n}", "judge_model_id": name, "response": told, "label": None, "score": None, "error": error})
        if error:
            raise RuntimeError(error)
        return told or ""


def _best_of(outputs: list[str], ask: _Asking) -> int:
    """The winner of duels in the order of candidates, in which a challenger needs more than half of the judges; a judge
    that fails has no vote."""
    best = 0
    for i in range(1, len(outputs)):
        votes = 0
        for name in ask.names:
            try:
                votes += ask(DUEL_PROMPT.format(outputs[best], outputs[i]), name).lower().split()[:1] == ["b"]
            except RuntimeError:
                continue
        if votes > len(ask.names) / 2:
            best = i
    return best


def evaluate(store: RunStore, cases: DataFrame, metric: str | list[str], generator: Callable[[dict, int], Any] = demo_generator, **options: Any) -> str:
    """Runs an experiment over ``cases`` with default settings and returns its run id."""
    return Experiment(cases, generator, metric_ids=[metric] if isinstance(metric, str) else metric, **options).run(store)


def compare(store: RunStore, baseline: str, candidate: str) -> DataFrame:
    """Paired comparison of two runs by case and metric."""
    side = lambda r: stats.last_by_case(fold.score_rows(fold.event_log(store.events(r))), ["case_id", "metric_id"], "case_key")
    return stats.paired_compare(side(baseline), side(candidate), ["case_id", "metric_id"], ["metric_id"])


def estimate(experiment: Experiment) -> dict[str, int]:
    """Planned tasks and tokens of an experiment."""
    cases, n = experiment.cases.count(), len(experiment.seeds) or max(1, experiment.samples)
    judged = [m for m in experiment.metric_ids if m in JUDGED]
    calls = cases * len(judged) * max(1, len(experiment.judges)) if judged else 0
    tokens_in, tokens_out = cases * n * judging.INPUT_TOKENS, cases * n * judging.OUTPUT_TOKENS
    return {
        "total_cases": cases, "candidate_count": n, "generation_tasks": cases * n, "reduction_tasks": cases if n > 1 else 0, "parse_tasks": cases if experiment.parser else 0, "score_tasks": cases * len(experiment.metric_ids),
        "judge_calls": calls, "total_tokens": tokens_in + tokens_out + calls * judging.JUDGE_TOKENS,
    }


def run_benchmark(store: RunStore, rows: DataFrame, name: str, generator: Callable[[dict, int], Any] = demo_generator, judge: Callable[[str, int], str] = demo_judge, **options: Any) -> str:
    """Runs a benchmark's recipe over its rows with the components it names and returns the run id. Recipes that execute
    code are scored by operators.execution with an executor of the user's; their other metrics must be given."""
    recipe, _ = benchmarks.recipe(name)
    raw = benchmarks.materialized(rows, name)
    cases = raw.withColumn("input", _quoted(F.col("input")))
    if recipe.executes_code and "metric_ids" not in options:
        raise ValueError(f"{name} executes code; pass metric_ids with metric_functions, or use operators.execution")
    settings = {"metric_ids": [recipe.metric], "parser": recipe.parser, "samples": recipe.samples, "judges": {f"judge-{i}": judge for i in range(recipe.judges)}} | options
    return Experiment(cases, generator, **settings).run(store)

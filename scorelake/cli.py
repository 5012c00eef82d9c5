"""Command line: python -m scorelake.cli COMMAND … over a store folder."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from scorelake import engine, queue
from scorelake.operators import fold, report
from scorelake.operators.store import BUNDLES
from scorelake.sources import benchmarks, datasets
from scorelake.sources.config import load, overridden, symbol
from scorelake.sources.runs import PROJECTIONS, RunStore


def _session() -> SparkSession:
    return SparkSession.builder.appName("scorelake").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _experiment(spark: SparkSession, config: dict[str, Any]) -> engine.Experiment:
    cases = datasets.from_jsonl(spark, config["dataset"]["path"], config["dataset"].get("id")) if "path" in config.get("dataset", {}) else datasets.from_inline(spark, config.get("dataset", {}).get("cases", []))
    evaluation = config.get("evaluation", {})
    names = {n: symbol(n) if ":" in n else engine.demo_judge for n in evaluation.get("judges", [])}  # module:name, or the built-in one
    generator = config.get("generation", {}).get("generator", "builtin/demo_generator")
    return engine.Experiment(
        cases, symbol(generator) if ":" in generator else engine.demo_generator, generator, metric_ids=evaluation.get("metrics", ["builtin/exact_match"]), parser=evaluation.get("parser"), judges=names,
        samples=config.get("generation", {}).get("samples", 1), seeds=config.get("seeds", []), rubric=evaluation.get("rubric"), metadata=config.get("metadata", {}),
    )


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="scorelake")
    parser.add_argument("--store", default="runs", help="folder of the store")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "estimate", "replay"):
        sub = commands.add_parser(name)
        sub.add_argument("config")
        sub.add_argument("--set", nargs="*", default=[], help="overrides, a.b=value")
        if name == "run":
            sub.add_argument("--until", default="judge", choices=engine.STAGES)
        if name == "replay":
            sub.add_argument("--stage", required=True, choices=engine.STAGES)
    sub = commands.add_parser("report")
    sub.add_argument("run_id")
    sub.add_argument("--format", default="csv", choices=["csv", "json", "markdown", "latex"])
    sub.add_argument("--out", required=True)
    sub = commands.add_parser("compare")
    sub.add_argument("baseline")
    sub.add_argument("candidate")
    sub = commands.add_parser("inspect")
    sub.add_argument("run_id")
    sub.add_argument("--table", default="execution_state", choices=sorted(PROJECTIONS))
    sub = commands.add_parser("quickcheck")
    sub.add_argument("run_id")
    sub = commands.add_parser("quick-eval")
    sub.add_argument("path")
    sub.add_argument("--metric", default="builtin/exact_match")
    sub.add_argument("--kind", default="file", choices=["file", "inline", "benchmark"], help="path is a file of cases, a JSON list of cases, or NAME=ROWS of a benchmark")
    sub = commands.add_parser("resume")
    sub.add_argument("run_id")
    sub = commands.add_parser("export")
    sub.add_argument("run_id")
    sub.add_argument("--bundle", default="generation", choices=sorted(BUNDLES))
    sub.add_argument("--out", required=True)
    sub = commands.add_parser("submit")
    sub.add_argument("config")
    sub.add_argument("--queue", required=True)
    sub.add_argument("--mode", default="worker_pool", choices=["worker_pool", "batch"])
    sub.add_argument("--set", nargs="*", default=[], help="overrides, a.b=value")
    sub = commands.add_parser("worker")
    sub.add_argument("--queue", required=True)
    sub = commands.add_parser("batch")
    sub.add_argument("request")
    sub = commands.add_parser("init")
    sub.add_argument("path")
    commands.add_parser("benchmarks")
    args = parser.parse_args(argv)
    if args.command == "init":
        Path(args.path).write_text('seeds = []\n\n[dataset]\npath = "cases.jsonl"\n\n[generation]\nsamples = 1\n\n[evaluation]\nmetrics = ["builtin/exact_match"]\njudges = []\n')
        return 0
    if args.command == "benchmarks":
        for name, r in benchmarks.RECIPES.items():
            print(json.dumps({"benchmark": name, "dataset": r.dataset, "split": r.split, "parser": r.parser, "metric": r.metric, "variants": r.variants}))
        return 0
    spark = _session()
    store = RunStore(spark, args.store)
    if args.command in ("run", "estimate", "replay"):
        experiment = _experiment(spark, overridden(load(args.config), args.set))
        if args.command == "estimate":
            print(json.dumps(engine.estimate(experiment)))
        else:
            print(experiment.run(store, args.until) if args.command == "run" else experiment.replay(store, args.stage))
    elif args.command == "quick-eval":
        if args.kind == "benchmark":
            name, _, rows = args.path.partition("=")
            run_id = engine.run_benchmark(store, datasets.raw_rows(spark, [rows]), name)
        else:
            cases = datasets.from_jsonl(spark, args.path) if args.kind == "file" else datasets.from_inline(spark, json.loads(args.path))
            run_id = engine.evaluate(store, cases, args.metric)
        _show(report.quickcheck(store.projection("score_rows", run_id)))
    elif args.command == "resume":
        held = store.resume(args.run_id)
        if held is None:
            print(f"run {args.run_id} isn't stored", file=sys.stderr)
            return 1
        _show(store.projection("run_result", args.run_id))
    elif args.command == "export":
        log = store.events(args.run_id).filter(f"event_type = '{BUNDLES[args.bundle]}'")
        log.orderBy("sequence").select("run_id", "sequence", "event_type", "case_key", "candidate_id", "metric_id", "event_json").write.mode("overwrite").json(args.out)
    elif args.command == "submit":
        config = overridden(load(args.config), args.set)
        print(queue.submit(args.queue, _experiment(spark, config).compile()[0], config, args.mode))
    elif args.command in ("worker", "batch"):
        run = lambda request: _experiment(spark, request["config"]).run(store)
        done = queue.work_once(args.queue, run) if args.command == "worker" else queue.batch(args.request, run)
        print("nothing is queued" if done is None else done)
    elif args.command == "report":
        store.export(args.out, args.format, args.run_id)
    elif args.command == "compare":
        _show(engine.compare(store, args.baseline, args.candidate))
    elif args.command == "inspect":
        _show(store.projection(args.table, args.run_id))
    else:
        _show(report.quickcheck(fold.score_rows(fold.event_log(store.events(args.run_id)))))
    return 0


def _show(rows) -> None:
    for line in rows.toJSON().toLocalIterator():
        print(line)


if __name__ == "__main__":
    sys.exit(main())

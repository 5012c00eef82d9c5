"""Queries of the general problems: schema drift, change feeds, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from scorelake.operators import changes, drift, nested
from scorelake.storage import staged, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.drift_report(table(spark, d, "run_events"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return changes.current_scores(table(spark, d, "run_events"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.run_children(table(spark, d, "run_events"), table(spark, d, "run_snapshots"))


def p2_events(spark: SparkSession, d: str) -> DataFrame:
    """The consistent event table, drifted names replayed, with what is left in the rescue column."""
    return drift.consistent(table(spark, d, "run_events"), ["id", "store_id", "file_no"])


def p2_rescue_rates(spark: SparkSession, d: str) -> DataFrame:
    return drift.rescue_rates(table(spark, d, "run_events"))


#: Flat tables of nested records: query → (from evaluations or snapshots, table path).
FLAT = {
    "p5_judge_calls": ("evaluation", "judge_calls"), "p5_judge_responses": ("evaluation", "judge_responses"), "p5_parsed_judgments": ("evaluation", "parsed_judgments"), "p5_scores": ("evaluation", "scores"),
    "p5_retry_history": ("evaluation", "judge_responses.retry_history"), "p5_messages": ("evaluation", "judge_responses.conversation_trace.messages"), "p5_candidate_indices": ("evaluation", "judge_calls.candidate_indices"),
    "p5_rubric_levels": ("evaluation", "judge_calls.metadata.rubric.levels"), "p5_spans": ("evaluation", "parsed_judgments.details.spans"), "p5_executions": ("evaluation", ""),
    "p5_datasets": ("snapshot", "datasets"), "p5_cases": ("snapshot", "datasets.cases"), "p5_metrics": ("snapshot", "component_refs.metrics"), "p5_parsers": ("snapshot", "component_refs.parsers"),
    "p5_judge_models": ("snapshot", "component_refs.judge_models"), "p5_dataset_refs": ("snapshot", "identity.dataset_refs"), "p5_snapshots": ("snapshot", ""),
}


def _flat(source: str, path: str):
    def flat(spark: SparkSession, d: str) -> DataFrame:
        """A flat table of the records at a path, with parent, position and every field that occurs."""
        made = nested.evaluation_triples(table(spark, d, "run_events"), tables=[path]) if source == "evaluation" else nested.snapshot_triples(table(spark, d, "run_snapshots"), tables=[path])
        return nested.flat_table(staged(made), ["run_id", "sequence"], path)  # read twice: once for the fields

    return flat


def p2_versions(spark: SparkSession, d: str) -> DataFrame:
    """What stores and rows say about each file's schema."""
    return drift.versions(table(spark, d, "run_events"), table(spark, d, "run_store_meta"))


def p2_file_changes(spark: SparkSession, d: str) -> DataFrame:
    """p2_versions with the number of changes found in each file, and whether any version told of them."""
    events = table(spark, d, "run_events")
    return drift.changes_by_file(drift.drift_report(events), drift.versions(events, table(spark, d, "run_store_meta")))


QUERIES = {
    "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p2_events": p2_events, "p2_rescue_rates": p2_rescue_rates, "p2_versions": p2_versions, "p2_file_changes": p2_file_changes,
    **{name: _flat(*of) for name, of in FLAT.items()},
}
_DECODED = "CASE WHEN json_type(try_cast(event_json AS JSON)) = 'VARCHAR' THEN try_cast((try_cast(event_json AS JSON)->>'$') AS JSON) ELSE try_cast(event_json AS JSON) END"


def _children(source: str, column: str, paths: list[str], prefix: str = "", parent: str = "-1") -> str:
    """SQL of the elements of the arrays (or single objects) at ``paths`` of a JSON column."""
    values = ", ".join(f"('{p}')" for p in paths)
    return f"""SELECT run_id, sequence, '{prefix}' || path AS child_path, parent_pos, (i - 1)::INT AS child_pos, x FROM (SELECT run_id, sequence, path, parent_pos, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (
    SELECT run_id, sequence, path, parent_pos, CASE json_type(a) WHEN 'ARRAY' THEN from_json(a, '["JSON"]') WHEN 'OBJECT' THEN [a] ELSE [] END AS l FROM (
      SELECT run_id, sequence, path, {parent} AS parent_pos, json_extract({column}, '$.' || path) AS a FROM {source}, (VALUES {values}) v(path)))) WHERE x IS NOT NULL AND json_type(x) <> 'NULL'"""


_METRIC = ", ".join(f"p->>'$.{m}'" for m in changes.METRIC_MEMBERS)
ORACLE: dict[str, str] = {
    "p4_found": f"""WITH raw AS (SELECT *, CASE WHEN json_type(try_cast(event_json AS JSON)) = 'VARCHAR' THEN try_cast((try_cast(event_json AS JSON)->>'$') AS JSON) ELSE try_cast(event_json AS JSON) END AS p
  FROM run_events WHERE event_type IN ('score_completed', 'score_failed')),
c AS (SELECT run_id, coalesce(nullif(trim(case_key), ''), length(dataset_id) || ':' || dataset_id || ':' || case_id, case_id) AS case_key, candidate_id, coalesce(nullif(trim(metric_id), ''), {_METRIC}) AS metric_id, sequence, event_type = 'score_completed' AS ok FROM raw)
SELECT run_id, case_key, candidate_id, metric_id, max(sequence) AS sequence FROM c GROUP BY 1, 2, 3, 4 HAVING arg_max(ok, sequence)""",
    "p5_found": f"""WITH j AS (SELECT run_id, sequence, {_DECODED} AS p FROM run_events WHERE event_type = 'evaluation_completed'),
e AS (SELECT run_id, sequence, CASE json_type(p, '$.execution') WHEN 'VARCHAR' THEN try_cast(p->>'$.execution' AS JSON) ELSE json_extract(p, '$.execution') END AS x0 FROM j),
t AS ({_children("e", "x0", ["judge_calls", "judge_responses", "parsed_judgments", "scores"])}),
r AS (SELECT run_id, sequence, child_pos AS up, x AS x0 FROM t WHERE child_path = 'judge_responses'),
k AS ({_children("r", "x0", ["retry_history", "conversation_trace.messages"], "judge_responses.", "up")}),
s AS (SELECT run_id, -1::BIGINT AS sequence, try_cast(snapshot_json AS JSON) AS x0 FROM run_snapshots),
u AS ({_children("s", "x0", ["datasets", "component_refs.metrics", "component_refs.parsers", "component_refs.judge_models"])}),
d AS (SELECT run_id, sequence, child_pos AS up, x AS x0 FROM u WHERE child_path = 'datasets'),
c AS ({_children("d", "x0", ["cases"], "datasets.", "up")})
SELECT DISTINCT run_id, sequence, child_path, parent_pos::INT AS parent_pos, child_pos FROM (SELECT * FROM t UNION ALL SELECT * FROM k UNION ALL SELECT * FROM u UNION ALL SELECT * FROM c)""",
}


def flat_sql(source: str, path: str, fields: dict[str, str]) -> str:
    """SQL of a flat table: arrays on the path are unnested one after another, and ``fields`` (path → column) are taken."""
    root = (
        f"SELECT run_id, sequence, CASE json_type(p, '$.execution') WHEN 'VARCHAR' THEN try_cast(p->>'$.execution' AS JSON) ELSE json_extract(p, '$.execution') END AS x FROM (SELECT run_id, sequence, {_DECODED} AS p FROM run_events WHERE event_type = 'evaluation_completed')"
        if source == "evaluation"
        else "SELECT run_id, -1::BIGINT AS sequence, try_cast(snapshot_json AS JSON) AS x FROM run_snapshots"
    )
    rows = f"(SELECT run_id, sequence, '' AS parent, -1 AS parent_pos, -1 AS child_pos, x FROM ({root}) WHERE json_type(x) = 'OBJECT')"
    arrays = {"judge_responses": 1, "judge_calls": 1, "parsed_judgments": 1, "datasets": 1}
    steps = [path] if path else []
    if "." in path and path.partition(".")[0] in arrays:
        steps = [path.partition(".")[0], path.partition(".")[2]]
    for step in steps:
        lists = f"SELECT *, json_extract(x, '$.{step}') AS a FROM {rows}"
        lists = f"SELECT *, CASE json_type(a) WHEN 'ARRAY' THEN from_json(a, '[\"JSON\"]') WHEN 'OBJECT' THEN [a] ELSE [] END AS l FROM ({lists})"
        up = "CASE WHEN child_pos < 0 THEN '' WHEN parent = '' THEN child_pos::VARCHAR ELSE parent || '.' || child_pos END"
        rows = f"(SELECT * FROM (SELECT run_id, sequence, {up} AS parent, child_pos AS parent_pos, (generate_subscripts(l, 1) - 1)::INT AS child_pos, unnest(l) AS x FROM ({lists})) WHERE x IS NOT NULL AND json_type(x) <> 'NULL')"
    picked = "".join(f", max(x->>'$.{f}') AS {name}" if f else f", max(x->>'$') AS {name}" for f, name in fields.items())
    return f"SELECT run_id, sequence, parent, parent_pos::INT AS parent_pos, child_pos::INT AS child_pos{picked} FROM {rows} GROUP BY 1, 2, 3, 4, 5"


def _named(*fields: str) -> dict[str, str]:
    return {f: f.replace(".", "__") for f in fields}


_COMPONENT = _named("component_id", "fingerprint", "version")
ORACLE |= {
    name: flat_sql(*FLAT[name], fields)
    for name, fields in {
        "p5_judge_calls": _named("call_id", "dimension_id", "effective_seed", "judge_model_id", "metadata.rubric.id", "repeat_index"),
        "p5_judge_responses": _named("conversation_trace.trace_id", "judge_model_id", "judge_model_version", "latency_ms", "raw_response", "token_usage.completion_tokens", "token_usage.prompt_tokens"),
        "p5_executions": _named("aggregation_output.method", "aggregation_output.value.label", "aggregation_output.value.votes.fail", "aggregation_output.value.votes.pass", "execution_id", "status", "subject_kind", "trace.trace_id"),
        "p5_snapshots": _named(
            "component_refs.generator.component_id", "component_refs.generator.fingerprint", "component_refs.generator.version", "component_refs.reducer.component_id", "component_refs.reducer.fingerprint", "component_refs.reducer.version",
            "identity.candidate_policy.num_samples", "identity.generator_ref.component_id", "identity.generator_ref.fingerprint", "identity.generator_ref.version", "provenance.environment_metadata.ci", "provenance.platform",
            "provenance.python_version", "provenance.storage.parameters.path", "provenance.storage.store",
        ),
        "p5_parsed_judgments": _named("label", "score"), "p5_scores": _named("details.n", "metric_id", "value"), "p5_retry_history": _named("attempt", "error.kind", "error.wait_s"), "p5_messages": _named("content", "role"),
        "p5_candidate_indices": {"": "element"}, "p5_rubric_levels": _named("level"), "p5_spans": _named("from", "to") | {"from": '"from"', "to": '"to"'},
        "p5_datasets": _named("dataset_id", "revision"), "p5_cases": _named("case_id", "expected_output.answer", "input.question", "metadata.lang"), "p5_metrics": _COMPONENT, "p5_parsers": _COMPONENT, "p5_judge_models": _COMPONENT,
        "p5_dataset_refs": _named("dataset_id", "fingerprint"),
    }.items()
}
_VERSION = r"try_cast(regexp_extract(lower(trim({})), '^(?:[a-z]+[-_ ]?)?([0-9]{{1,9}})(?:\.0+)?$', 1) AS INT)"
ORACLE["p2_versions"] = f"""WITH m AS (SELECT store_id, file_no, max({_VERSION.format("value")}) AS declared FROM run_store_meta WHERE key = 'schema_version' GROUP BY 1, 2),
c AS (SELECT store_id, file_no, {_VERSION.format("schema_version")} AS v, count(*) AS n FROM run_events GROUP BY 1, 2, 3),
r AS (SELECT store_id, file_no, arg_max(v, n * 10000000000 + v) FILTER (v IS NOT NULL) AS in_rows, sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (v IS NULL), 0)::BIGINT AS unversioned FROM c GROUP BY 1, 2)
SELECT store_id, file_no, declared, in_rows, rows, unversioned FROM r LEFT JOIN m USING (store_id, file_no)"""

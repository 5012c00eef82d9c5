"""Queries of the evaluation pipeline and its read models, each with the same result as SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions import identity, text
from scorelake.functions.payload import case_key_or_derived
from scorelake.operators import candidates, fold, judging, metrics, nested, readmodels, report, stats, store
from scorelake.plans.general import flat_sql
from scorelake.sources.runs import EVENTS
from scorelake.storage import staged, table
from scorelake.streaming import live

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

KEY = "coalesce(nullif(trim(case_key), ''), length(dataset_id) || ':' || dataset_id || ':' || case_id, case_id)"
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
KINDS = ", ".join(f"'{k}'" for k in fold.KNOWN_EVENTS)
LOG = f"""raw AS (SELECT *, CASE WHEN json_type(try_cast(event_json AS JSON)) = 'VARCHAR' THEN try_cast((try_cast(event_json AS JSON)->>'$') AS JSON) ELSE try_cast(event_json AS JSON) END AS p
  FROM run_events WHERE event_type IN ({KINDS})),
log AS (SELECT run_id, sequence AS seq, max(event_type) AS event_type,
  max(CASE WHEN case_id IS NOT NULL THEN {KEY} END) AS case_key, max(case_id) AS case_id, max(dataset_id) AS dataset_id, max(candidate_id) AS candidate_id, max(candidate_index) AS candidate_index,
  max(coalesce(nullif(trim(metric_id), ''), CASE WHEN event_type LIKE 'score%' OR event_type LIKE 'evaluation%' THEN coalesce(p->>'$.metric_id', p->>'$.metric_name', p->>'$.metricId') END)) AS metric_id,
  max(occurred_at) AS occurred_at, max(error_message) AS error_message,
  max(CASE WHEN event_type = 'score_completed' THEN try_cast(coalesce(p->>'$.score.value', p->>'$.score.val') AS DOUBLE) END) AS value,
  max(CASE WHEN event_type = 'score_failed' THEN p->>'$.error.reason' END) AS reason,
  max(CASE WHEN event_type = 'run_completed' THEN coalesce(p->>'$.completed_through_stage', p->>'$.last_stage') END) AS stage,
  max(CASE WHEN event_type = 'evaluation_completed' THEN p->>'$.execution.status' END) AS status,
  max(CASE WHEN event_type IN ('generation_completed', 'reduction_completed', 'parse_completed') THEN (p->>'$.event_type') IS NULL OR (p->>'$.result') IS NOT NULL
    WHEN event_type = 'evaluation_completed' THEN (p->>'$.event_type') IS NULL OR (p->>'$.execution') IS NOT NULL
    WHEN event_type = 'score_completed' THEN (p->>'$.event_type') IS NULL OR (p->>'$.score') IS NOT NULL
    WHEN event_type = 'score_failed' THEN (p->>'$.event_type') IS NULL OR (p->>'$.error') IS NOT NULL END) AS done,
  max(CASE WHEN event_type = 'parse_completed' THEN (p->>'$.event_type') IS NOT NULL AND (p->>'$.result') IS NOT NULL AND (p->>'$.result.value') IS NULL END) AS parsed_null
  FROM raw GROUP BY 1, 2)"""
# a failing candidate is popped by its own completion, or by one at the index whose last failure (since the completion
# before) is the candidate's
FAILED = """gen AS (SELECT run_id, case_key, candidate_id, candidate_index AS i, seq, event_type = 'generation_failed' AS bad FROM log
  WHERE case_key IS NOT NULL AND (event_type = 'generation_failed' OR event_type = 'generation_completed' AND done)),
pops AS (SELECT run_id, case_key, candidate_id, seq FROM gen WHERE NOT bad
  UNION ALL SELECT g.run_id, g.case_key, (SELECT arg_max(f.candidate_id, f.seq) FROM gen f WHERE f.bad AND f.run_id = g.run_id AND f.case_key = g.case_key AND f.i = g.i AND f.seq < g.seq
    AND f.seq > coalesce((SELECT max(h.seq) FROM gen h WHERE NOT h.bad AND h.run_id = g.run_id AND h.case_key = g.case_key AND h.i = g.i AND h.seq < g.seq), -1)), g.seq FROM gen g WHERE NOT g.bad AND g.i IS NOT NULL),
marks AS (SELECT run_id, case_key, 'generation' AS kind, candidate_id AS slot, seq, true AS bad FROM gen WHERE bad
  UNION ALL SELECT run_id, case_key, 'generation', candidate_id, seq, false FROM pops WHERE candidate_id IS NOT NULL
  UNION ALL SELECT run_id, case_key, 'evaluation', metric_id, seq, event_type = 'evaluation_failed' OR status IS NOT DISTINCT FROM 'partial_failure' FROM log WHERE event_type = 'evaluation_failed' OR event_type = 'evaluation_completed' AND done
  UNION ALL SELECT run_id, case_key, 'score', metric_id, seq, event_type = 'score_failed' FROM log WHERE event_type IN ('score_failed', 'score_completed') AND done
  UNION ALL SELECT run_id, case_key, 'selection', '', seq, event_type = 'selection_failed' FROM log WHERE event_type IN ('selection_failed', 'selection_completed')
  UNION ALL SELECT run_id, case_key, split_part(event_type, '_', 1), '', seq, true FROM log WHERE event_type IN ('reduction_failed', 'parse_failed'))"""
STATES = f"""WITH {LOG}, {FAILED},
now AS (SELECT run_id, case_key, kind, slot, arg_max(bad, seq * 2 + bad::INT) AS bad FROM marks WHERE case_key IS NOT NULL GROUP BY ALL),
last_score AS (SELECT run_id, case_key, metric_id, arg_max(event_type = 'score_completed', seq) AS ok, arg_max({{v: value}}, seq).v AS value, arg_max({{v: coalesce(reason, error_message)}}, seq).v AS reason
  FROM log WHERE event_type IN ('score_completed', 'score_failed') AND done AND case_key IS NOT NULL GROUP BY ALL),
last_eval AS (SELECT run_id, case_key, metric_id, arg_max(event_type = 'evaluation_completed', seq) AS ok, arg_max({{v: coalesce(reason, error_message)}}, seq).v AS reason, arg_max({{v: status}}, seq).v AS status
  FROM log WHERE (event_type = 'evaluation_completed' AND done OR event_type = 'evaluation_failed') AND case_key IS NOT NULL GROUP BY ALL),
base AS (SELECT run_id, case_key, min(case_id) AS case_id,
  count(DISTINCT candidate_id) FILTER (event_type = 'generation_completed' AND done) AS n_generated, count(DISTINCT candidate_index) FILTER (event_type = 'generation_completed' AND done) AS n_generated_indices,
  (arg_max({{v: candidate_id}}, seq) FILTER (event_type = 'reduction_completed' AND done)).v AS reduced_candidate_id, (arg_max({{v: error_message}}, seq) FILTER (event_type = 'reduction_failed')).v AS reduction_error,
  (arg_max({{v: parsed_null}}, seq) FILTER (event_type = 'parse_completed' AND done)).v AS parsed_null, (arg_max({{v: error_message}}, seq) FILTER (event_type = 'parse_failed')).v AS parse_error, max(seq) AS last_seq
  FROM log WHERE case_key IS NOT NULL GROUP BY 1, 2),
states AS (SELECT b.*, (SELECT count(*) FROM last_score s WHERE s.run_id = b.run_id AND s.case_key = b.case_key AND s.ok) AS n_scores, (SELECT count(*) FROM last_score s WHERE s.run_id = b.run_id AND s.case_key = b.case_key AND NOT s.ok) AS n_score_failures,
  (SELECT count(*) FROM last_eval s WHERE s.run_id = b.run_id AND s.case_key = b.case_key AND s.ok) AS n_evaluations, (SELECT count(*) FROM last_eval s WHERE s.run_id = b.run_id AND s.case_key = b.case_key AND NOT s.ok) AS n_evaluation_failures,
  (SELECT count(*) FROM now n WHERE n.run_id = b.run_id AND n.case_key = b.case_key AND n.kind = 'generation' AND n.bad) AS n_generation_failures,
  EXISTS (SELECT 1 FROM now n WHERE n.run_id = b.run_id AND n.case_key = b.case_key AND n.bad) AS has_failure FROM base b)"""
SCORES = STATES + """,
slots AS (SELECT run_id, case_key, metric_id FROM last_score UNION SELECT run_id, case_key, metric_id FROM last_eval),
pre AS (SELECT b.run_id, b.case_key, b.case_id, m.metric_id, b.reduced_candidate_id AS candidate_id, s.ok AS sok, s.value AS svalue, s.reason AS sreason, e.ok AS eok, e.reason AS ereason, b.parse_error,
  CASE WHEN b.parse_error IS NOT NULL THEN 'parse_failure' WHEN b.parsed_null THEN 'parse_null' WHEN NOT e.ok THEN 'evaluation_failure' WHEN e.status = 'partial_failure' THEN 'evaluation_partial_failure' WHEN NOT s.ok THEN 'score_failure' END AS error_category
  FROM base b JOIN slots m USING (run_id, case_key) LEFT JOIN last_score s ON s.run_id = b.run_id AND s.case_key = b.case_key AND s.metric_id IS NOT DISTINCT FROM m.metric_id
  LEFT JOIN last_eval e ON e.run_id = b.run_id AND e.case_key = b.case_key AND e.metric_id IS NOT DISTINCT FROM m.metric_id),
score_rows AS (SELECT run_id, case_key, case_id, metric_id, candidate_id, CASE WHEN error_category IS NULL AND sok THEN svalue END AS value,
  CASE WHEN error_category IS NOT NULL THEN 'error' WHEN svalue >= 1 THEN 'correct' ELSE 'incorrect' END AS outcome, error_category,
  CASE error_category WHEN 'parse_failure' THEN parse_error WHEN 'parse_null' THEN 'Parser returned null output' WHEN 'evaluation_failure' THEN ereason WHEN 'evaluation_partial_failure' THEN 'Evaluation completed with workflow failures' WHEN 'score_failure' THEN sreason END AS error_message
  FROM pre WHERE error_category IS NOT NULL OR sok)"""
SAID = f"""asked AS (SELECT {KEY} AS k, arg_min(expected_output, record_id) AS expected FROM cases WHERE expected_output IS NOT NULL GROUP BY 1),
said AS (SELECT DISTINCT r.response_id, a.k AS case_key, r.raw_response AS prediction, a.expected FROM (SELECT *, {KEY} AS k2 FROM judge_responses) r JOIN asked a ON r.k2 = a.k)"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The log, written once: read models use it several times with different columns, and payloads are parsed only once."""
    return staged(fold.event_log(table(spark, d, "run_events")))


def _said(spark: SparkSession, d: str) -> DataFrame:
    """response_id, case_key, prediction and the case's expected output as JSON text."""
    key = case_key_or_derived(F.col("case_key"), F.col("dataset_id"), F.col("case_id"))
    asked = table(spark, d, "cases").filter("expected_output is not null").groupBy(key.alias("case_key")).agg(F.min_by("expected_output", "record_id").alias("expected"))
    said = table(spark, d, "judge_responses").select("response_id", key.alias("case_key"), F.col("raw_response").alias("prediction")).distinct()
    return said.join(asked, "case_key")


def _json_string(c):
    quoted = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


# --- identities and fan-out


@query(f"SELECT DISTINCT record_id, {KEY} AS case_key FROM cases")
def case_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases").select("record_id", case_key_or_derived(F.col("case_key"), F.col("dataset_id"), F.col("case_id")).alias("case_key")).distinct()


@query("SELECT run_id, i::INT AS candidate_index, ('0x' || left(sha256(run_id || ':' || i), 8))::BIGINT AS seed FROM (SELECT DISTINCT run_id FROM run_snapshots), range(4) t(i)")
def candidate_seeds(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "run_snapshots").select("run_id").distinct()
    return runs.select("run_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("candidate_index")).withColumn("seed", identity.candidate_seed(F.col("run_id"), F.col("candidate_index")))


@query()
def run_identities(spark: SparkSession, d: str) -> DataFrame:
    """run_id, identity_hash: the content hash of the identity of each snapshot. The canonical text needs a JSON writer
    with sorted keys, which SQL lacks."""
    rows = table(spark, d, "run_snapshots").select("run_id", identity.canonical_text(F.get_json_object("snapshot_json", "$.identity")).alias("c")).distinct()
    return rows.select("run_id", F.sha2("c", 256).alias("identity_hash"))


@query(f"SELECT 'run-0' AS run_id, dataset_id, case_id, case_key, i::INT AS candidate_index, case_id || '-candidate-' || i AS candidate_id, ('0x' || left(sha256('run-0:' || i), 8))::BIGINT AS seed FROM (SELECT DISTINCT dataset_id, case_id, {KEY} AS case_key FROM cases), range(4) t(i)")
def work_items(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "cases").select("dataset_id", "case_id", case_key_or_derived(F.col("case_key"), F.col("dataset_id"), F.col("case_id")).alias("case_key")).distinct()
    return candidates.work_items(cases, "run-0", 4)


@query(f"WITH {LOG} SELECT DISTINCT a.run_id, a.case_key, i::INT AS candidate_index FROM (SELECT DISTINCT run_id, case_key FROM log WHERE case_key IS NOT NULL) a, range(3) t(i) WHERE NOT EXISTS (SELECT 1 FROM log g WHERE g.event_type = 'generation_completed' AND g.done AND g.run_id = a.run_id AND g.case_key = a.case_key AND g.candidate_index = i)")
def pending_work(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    items = log.filter("case_key is not null").select("run_id", "case_key").distinct().select("run_id", "case_key", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("candidate_index"))
    done = log.filter("event_type = 'generation_completed' and done and candidate_index is not null")
    return candidates.pending(items, done, ["run_id", "case_key", "candidate_index"])


_CALLS = f"""SELECT DISTINCT judgment_id, {KEY} AS case_key, candidate_id, metric_id, judge_model_id, call_id, dimension_id, repeat_index FROM parsed_judgments"""


@query(f"""SELECT judgment_id, case_key, candidate_id, row_number() OVER (PARTITION BY case_key, candidate_id ORDER BY call_id, coalesce(dimension_id, ''), judge_model_id, repeat_index, judgment_id) - 1 AS position,
  ('0x' || left(sha256('run-0:' || case_key || ':' || metric_id || ':' || judge_model_id || ':0:' || repeat_index || ':' || coalesce(dimension_id, '') || ':' || regexp_extract(candidate_id, '[0-9]+$')), 8))::BIGINT AS seed FROM ({_CALLS})""")
def judge_call_plan(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "parsed_judgments").select("judgment_id", case_key_or_derived(F.col("case_key"), F.col("dataset_id"), F.col("case_id")).alias("case_key"), "candidate_id", "metric_id", "judge_model_id", "call_id", "dimension_id", "repeat_index").distinct()
    calls = calls.withColumn("indices", F.array(F.regexp_extract("candidate_id", "[0-9]+$", 0)))
    return judging.planned(calls, F.lit("run-0")).select("judgment_id", "case_key", "candidate_id", "position", "seed")


@query("""WITH s AS (SELECT run_id, max(snapshot_json) AS j FROM run_snapshots GROUP BY 1), t AS (SELECT run_id, json(j) AS j FROM s),
d AS (SELECT run_id, unnest(from_json(json_extract(j, '$.datasets'), '["JSON"]')) AS ds FROM t),
c AS (SELECT run_id, CASE json_type(ds, '$.cases') WHEN 'OBJECT' THEN 1 WHEN 'ARRAY' THEN len(list_filter(from_json(json_extract(ds, '$.cases'), '["JSON"]'), lambda x: x IS NOT NULL AND json_type(x) <> 'NULL')) ELSE 0 END AS n FROM d),
n AS (SELECT t.run_id, coalesce((SELECT sum(n) FROM c WHERE c.run_id = t.run_id), 0)::BIGINT AS total_cases, greatest(1, coalesce(try_cast(j->>'$.identity.candidate_policy.num_samples' AS INT), 1)) AS candidate_count,
  coalesce(json_array_length(j, '$.component_refs.metrics'), 0)::INT AS metric_count, coalesce(json_array_length(j, '$.component_refs.parsers'), 0) > 0 AS parses FROM t)
SELECT run_id, total_cases, candidate_count, metric_count, total_cases * candidate_count AS generation_tasks, CASE WHEN candidate_count > 1 THEN total_cases ELSE 0 END AS reduction_tasks, CASE WHEN parses THEN total_cases ELSE 0 END AS parse_tasks,
  total_cases * metric_count AS score_tasks, total_cases * candidate_count * 4 AS input_tokens, total_cases * candidate_count * 256 AS output_tokens FROM n""")
def run_estimates(spark: SparkSession, d: str) -> DataFrame:
    return judging.estimates(table(spark, d, "run_snapshots"))


# --- parsers and metrics


@query(f"WITH {SAID} SELECT response_id, (json_type(expected) = 'VARCHAR' AND prediction IS NOT NULL AND (expected->>'$') = prediction)::INT::DOUBLE AS value FROM said")
def exact_match_scores(spark: SparkSession, d: str) -> DataFrame:
    said = _said(spark, d)
    mine = F.when(F.col("prediction").isNull(), "null").otherwise(_json_string(F.col("prediction")))
    return said.select("response_id", metrics.exact_match(mine, F.col("expected")).alias("value"))


_TOKENS = f"""e AS (SELECT response_id, list_filter(regexp_split_to_array(lower(coalesce(prediction, '')), '{WS}+'), lambda x: x <> '') AS p, list_filter(regexp_split_to_array(lower(CASE WHEN json_type(expected) = 'OBJECT' THEN coalesce(expected->>'$.answer', '') ELSE expected->>'$' END), '{WS}+'), lambda x: x <> '') AS g FROM said),
t AS (SELECT response_id, unnest(p) AS token, 1 AS p, 0 AS g FROM e UNION ALL SELECT response_id, unnest(g), 0, 1 FROM e), u AS (SELECT response_id, token, sum(p) AS p, sum(g) AS g FROM t GROUP BY 1, 2),
v AS (SELECT response_id, sum(least(p, g)) AS o, sum(p) AS p, sum(g) AS g FROM u GROUP BY 1), w AS (SELECT e.response_id, coalesce(v.o, 0) AS o, coalesce(v.p, 0) AS p, coalesce(v.g, 0) AS g FROM e LEFT JOIN v USING (response_id))"""


@query(f"WITH {SAID}, {_TOKENS} SELECT response_id, o::BIGINT AS overlap, round(CASE WHEN p = 0 AND g = 0 THEN 1 WHEN o = 0 THEN 0 ELSE 2 * o / (p + g) END::DOUBLE, 9) AS f1, round(CASE WHEN p = 0 THEN 0 ELSE o / p END::DOUBLE, 9) AS unigram_precision FROM w")
def token_scores(spark: SparkSession, d: str) -> DataFrame:
    said = _said(spark, d).withColumn("gold", text.expected_text(F.col("expected"), "answer"))
    found = metrics.token_scores(said, ["response_id"], "prediction", "gold")
    return found.select("response_id", "overlap", F.round("f1", 9).alias("f1"), F.round("precision", 9).alias("unigram_precision"))


_LETTER = r"coalesce(regexp_extract(upper(text), '(?s)^(?:.*[^\p{L}\p{N}_])?([A-J])(?:[^\p{L}\p{N}_].*)?$', 1), '')"


@query(f"SELECT doc_id, {_LETTER} AS choice, ({_LETTER} = chr((65 + doc_id % 10)::INT))::INT::DOUBLE AS value FROM documents")
def choice_scores(spark: SparkSession, d: str) -> DataFrame:
    choice = text.choice_letter(F.col("text"))
    gold = F.concat(F.lit('{"choice": "'), F.char(65 + F.col("doc_id") % 10), F.lit('"}'))
    return table(spark, d, "documents").select("doc_id", choice.alias("choice"), metrics.choice_accuracy(choice, gold).alias("value"))


@query(f"""WITH {SAID}, m AS (SELECT response_id, regexp_replace(coalesce(list_last(regexp_extract_all(prediction, '\\\\boxed\\{{([^{{}}]+)\\}}', 1)), prediction), '^{WS}+|{WS}+$', '', 'g') AS answer,
  regexp_replace(CASE WHEN json_type(expected) = 'OBJECT' THEN coalesce(expected->>'$.answer', '') ELSE expected->>'$' END, '^{WS}+|{WS}+$', '', 'g') AS gold FROM said)
SELECT response_id, answer, CASE WHEN answer IS NULL OR answer = '' OR gold = '' THEN 0.0 ELSE (lower(replace(answer, ' ', '')) = lower(replace(gold, ' ', '')))::INT::DOUBLE END::DOUBLE AS value FROM m""")
def math_scores(spark: SparkSession, d: str) -> DataFrame:
    answer = text.math_answer(F.col("prediction"))
    return _said(spark, d).select("response_id", answer.alias("answer"), metrics.math_equivalence(answer, F.col("expected")).alias("value"))


@query(f"SELECT DISTINCT response_id, regexp_replace(coalesce(list_last(regexp_extract_all(raw_response, '(?is)```(?:python|py|cpp|c\\+\\+)?\\s*(.+?)\\s*```', 1)), raw_response), '^{WS}+|{WS}+$', '', 'g') AS code FROM judge_responses WHERE raw_response NOT LIKE '{{%'")
def code_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "judge_responses").filter("raw_response not like '{%'")
    return rows.select("response_id", text.code_block(F.col("raw_response")).alias("code")).distinct()


@query()
def code_texts(spark: SparkSession, d: str) -> DataFrame:
    """Code of every response, those wrapped in JSON included; null for a null response. SQL lacks a reader that takes
    whatever isn't JSON as text."""
    return table(spark, d, "judge_responses").select("response_id", text.code_text(F.col("raw_response")).alias("code")).distinct()


@query("SELECT l_orderkey, count(*) AS tests_total, count(*) FILTER (l_returnflag = 'N') AS tests_passed, round(count(*) FILTER (l_returnflag = 'N') / count(*), 9) AS pass_rate FROM lineitem GROUP BY 1")
def pass_rates(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.pass_rates(table(spark, d, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "N")
    return found.withColumn("pass_rate", F.round("pass_rate", 9))


# --- choice among candidates


_ANSWERS = f"SELECT DISTINCT response_id, {KEY} AS case_key, raw_response, latency_ms FROM judge_responses"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "judge_responses").select("response_id", case_key_or_derived(F.col("case_key"), F.col("dataset_id"), F.col("case_id")).alias("case_key"), "raw_response", "latency_ms").distinct()


@query(f"WITH a AS ({_ANSWERS}), c AS (SELECT case_key, raw_response, count(*) AS votes, min(response_id) AS f FROM a GROUP BY 1, 2) SELECT case_key, raw_response, votes, n FROM (SELECT *, sum(votes) OVER (PARTITION BY case_key)::BIGINT AS n, row_number() OVER (PARTITION BY case_key ORDER BY votes DESC, f) AS r FROM c) WHERE r = 1")
def majority_votes(spark: SparkSession, d: str) -> DataFrame:
    return candidates.majority_vote(_answers(spark, d), ["case_key"], "response_id", "raw_response")


@query(f"SELECT case_key, response_id, raw_response FROM (SELECT *, row_number() OVER (PARTITION BY case_key ORDER BY response_id) AS r FROM ({_ANSWERS})) WHERE r = 1")
def first_candidates(spark: SparkSession, d: str) -> DataFrame:
    return candidates.first_candidate(_answers(spark, d), ["case_key"], "response_id", "raw_response")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def best_of_n(spark: SparkSession, d: str) -> DataFrame:
    return candidates.best_of_n(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_partkey", "l_extendedprice")


# --- the fold and its read models


_STATE_COLUMNS = "run_id, case_key, case_id, n_generated, n_generated_indices, reduced_candidate_id, reduction_error, parsed_null, parse_error, last_seq, n_scores, n_score_failures, n_evaluations, n_evaluation_failures, n_generation_failures, has_failure"


@query(f"{STATES} SELECT {_STATE_COLUMNS} FROM states")
def case_states(spark: SparkSession, d: str) -> DataFrame:
    return fold.case_states(_log(spark, d)).select(*_STATE_COLUMNS.split(", "))


@query(f"""WITH {LOG}, {FAILED},
m AS (SELECT run_id, seq, event_type, stage FROM log WHERE event_type IN ('run_started', 'run_completed', 'run_failed')),
s AS (SELECT m.* FROM m JOIN (SELECT run_id, coalesce(max(seq) FILTER (event_type = 'run_started'), -1) AS st FROM m GROUP BY 1) x USING (run_id) WHERE seq > st),
hot AS (SELECT DISTINCT run_id FROM (SELECT s.run_id, s.seq, k.case_key, k.kind, k.slot, arg_max(k.bad, k.seq * 2 + k.bad::INT) AS bad FROM s JOIN marks k ON k.run_id = s.run_id AND k.case_key IS NOT NULL AND k.seq < s.seq WHERE s.event_type = 'run_completed' GROUP BY ALL) WHERE bad),
late AS (SELECT DISTINCT k.run_id FROM marks k JOIN (SELECT run_id, min(seq) AS fd FROM s WHERE event_type = 'run_completed' GROUP BY 1) f USING (run_id) WHERE k.bad AND k.case_key IS NOT NULL AND k.seq > fd),
f AS (SELECT run_id, arg_max(event_type, seq) AS last, max(seq) AS ls, min(seq) FILTER (event_type = 'run_failed') AS ff FROM s GROUP BY 1)
SELECT r.run_id, CASE WHEN f.last IS NULL THEN CASE WHEN r.started THEN 'running' ELSE 'pending' END WHEN f.last = 'run_failed' THEN 'failed'
  WHEN r.run_id IN (SELECT run_id FROM hot) OR r.run_id IN (SELECT run_id FROM late) OR coalesce(f.ff < f.ls, false) THEN 'partial_failure' ELSE 'completed' END AS status, r.stage AS completed_through_stage
FROM (SELECT run_id, bool_or(event_type = 'run_started') AS started, (arg_max({{v: stage}}, seq) FILTER (event_type = 'run_completed')).v AS stage FROM log GROUP BY 1) r LEFT JOIN f USING (run_id)""")
def run_states(spark: SparkSession, d: str) -> DataFrame:
    return fold.run_states(_log(spark, d))


@query(f"{SCORES} SELECT * FROM score_rows")
def score_rows(spark: SparkSession, d: str) -> DataFrame:
    return fold.score_rows(_log(spark, d))


@query(f"{SCORES}, wanted AS (SELECT DISTINCT run_id, metric_id FROM log WHERE event_type LIKE 'score%' AND metric_id IS NOT NULL), pre2 AS (SELECT b.run_id, b.case_key, b.case_id, m.metric_id, b.parse_error, b.parsed_null, s.ok AS sok, s.value AS sv, e.ok AS eok, e.status FROM base b JOIN wanted m USING (run_id) LEFT JOIN last_score s ON s.run_id = b.run_id AND s.case_key = b.case_key AND s.metric_id = m.metric_id LEFT JOIN last_eval e ON e.run_id = b.run_id AND e.case_key = b.case_key AND e.metric_id = m.metric_id), cat AS (SELECT *, CASE WHEN parse_error IS NOT NULL THEN 'parse_failure' WHEN parsed_null THEN 'parse_null' WHEN NOT eok THEN 'evaluation_failure' WHEN status = 'partial_failure' THEN 'evaluation_partial_failure' WHEN NOT sok THEN 'score_failure' END AS error_category FROM pre2) SELECT run_id, case_key, metric_id, CASE WHEN error_category IS NULL AND sok THEN sv END AS value, error_category FROM cat WHERE error_category IS NOT NULL OR sok")
def score_rows_direct(spark: SparkSession, d: str) -> DataFrame:
    """Score rows with the metrics of each run named: a case whose parse failed has a row for each of them."""
    log = _log(spark, d)
    wanted = log.filter("event_type like 'score%' and metric_id is not null").select("run_id", "metric_id").distinct()
    return fold.score_rows(log, wanted).select("run_id", "case_key", "metric_id", "value", "error_category")


@query(f"{SCORES} SELECT run_id, metric_id, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'incorrect') AS incorrect, count(*) FILTER (outcome = 'error') AS error FROM score_rows GROUP BY 1, 2")
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return readmodels.outcome_counts(fold.score_rows(_log(spark, d)))


@query(f"{SCORES} SELECT run_id, metric_id, error_category, count(*) AS n FROM score_rows WHERE error_category IS NOT NULL GROUP BY 1, 2, 3")
def error_counts(spark: SparkSession, d: str) -> DataFrame:
    return readmodels.error_counts(fold.score_rows(_log(spark, d)))


@query(f"{SCORES} SELECT run_id, metric_id, count(*) AS n, round(avg(value), 9) AS mean, min(value) AS min, max(value) AS max FROM score_rows WHERE value IS NOT NULL AND outcome <> 'error' GROUP BY 1, 2")
def metric_summaries(spark: SparkSession, d: str) -> DataFrame:
    found = stats.summary(fold.score_rows(_log(spark, d)), ["run_id", "metric_id"])
    return found.withColumn("mean", F.round("mean", 9))


@query()
def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    """95 % intervals of the mean of each run and metric, by the seeded resampling, which SQL can't express."""
    rows = fold.score_rows(_log(spark, d)).filter("outcome <> 'error'")
    return stats.bootstrap(rows, ["run_id", "metric_id"], "value", ["case_key"])


_PAIRS = "one AS (SELECT run_id, case_id, metric_id, arg_max(value, case_key) AS value FROM score_rows WHERE value IS NOT NULL GROUP BY 1, 2, 3), hub AS (SELECT run_id FROM one GROUP BY 1 ORDER BY count(*) DESC, run_id LIMIT 1), pairs AS (SELECT c.run_id, c.metric_id, c.value - b.value AS delta FROM one b JOIN one c USING (case_id, metric_id) WHERE b.run_id = (SELECT run_id FROM hub) AND c.run_id <> b.run_id)"


@query(f"""{SCORES}, {_PAIRS}, g AS (SELECT run_id, metric_id, count(*) AS pairs, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses, count(*) FILTER (delta = 0) AS ties, round(avg(delta), 9) AS mean_delta FROM pairs GROUP BY 1, 2)
SELECT *, round(CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(least(wins, losses) + 1), lambda k: exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) - (wins + losses) * ln(2))))) END::DOUBLE, 6) AS p_value FROM g""")
def paired_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """Every run against the run with the most scores, by metric: what SQL can express of it (paired_intervals has all)."""
    base, others = _against_hub(spark, d)
    found = stats.paired_counts(stats.paired_deltas(base, others, ["case_id", "metric_id"]), ["run_id", "metric_id"])
    return found.withColumns({"mean_delta": F.round("mean_delta", 9), "p_value": F.round("p_value", 6)})


@query()
def paired_intervals(spark: SparkSession, d: str) -> DataFrame:
    """paired_comparisons with ci_lower and ci_upper, the seeded bootstrap of the differences, which SQL can't express."""
    base, others = _against_hub(spark, d)
    found = stats.paired_compare(base, others, ["case_id", "metric_id"], ["run_id", "metric_id"])
    return found.withColumns({"mean_delta": F.round("mean_delta", 9), "p_value": F.round("p_value", 6)})


def _against_hub(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Scores of the run with the most scores, and those of the others."""
    rows = fold.score_rows(_log(spark, d))
    one = staged(rows.filter("value is not null").groupBy("run_id", "case_id", "metric_id").agg(F.max_by("value", "case_key").alias("value")))  # read three times
    hub = one.groupBy("run_id").count().orderBy(F.desc("count"), "run_id").limit(1).select("run_id")
    return one.join(hub, "run_id", "left_semi").drop("run_id"), one.join(hub, "run_id", "left_anti")


@query(f"WITH {LOG} SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY seq) - 1 AS position, seq, event_type, occurred_at, case_key, candidate_id, metric_id FROM log")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    return readmodels.timeline(_log(spark, d))


@query(f"{STATES}, snap AS (SELECT run_id, max(snapshot_json) AS j FROM run_snapshots GROUP BY 1), ds AS (SELECT run_id, unnest(from_json(json_extract(j, '$.datasets'), '[\"JSON\"]')) AS ds FROM snap), cs AS (SELECT run_id, ds->>'$.dataset_id' AS dataset_id, unnest(CASE json_type(ds, '$.cases') WHEN 'OBJECT' THEN [json_extract(ds, '$.cases')] WHEN 'ARRAY' THEN from_json(json_extract(ds, '$.cases'), '[\"JSON\"]') ELSE [] END) AS c FROM ds), wanted AS (SELECT DISTINCT run_id, dataset_id, c->>'$.case_id' AS case_id, length(dataset_id) || ':' || dataset_id || ':' || (c->>'$.case_id') AS case_key FROM cs WHERE c IS NOT NULL AND json_type(c) <> 'NULL') SELECT w.run_id, w.dataset_id, w.case_id, w.case_key, s.case_key IS NOT NULL AS seen, coalesce(s.n_scores, 0) AS n_scores, coalesce(s.has_failure, false) AS has_failure FROM wanted w LEFT JOIN states s USING (run_id, case_key)")
def case_results(spark: SparkSession, d: str) -> DataFrame:
    planned = readmodels.planned_cases(table(spark, d, "run_snapshots"))
    return readmodels.case_results(planned, fold.case_states(_log(spark, d)))


@query(f"{STATES} SELECT run_id, count(*) AS seen_cases, count(*) FILTER (NOT has_failure) AS completed_cases, count(*) FILTER (has_failure) AS failed_cases FROM states GROUP BY 1")
def case_progress(spark: SparkSession, d: str) -> DataFrame:
    return readmodels.progress(fold.case_states(_log(spark, d)))


@query(f"WITH {LOG} SELECT DISTINCT run_id, metric_id FROM log WHERE metric_id IS NOT NULL AND (event_type LIKE 'score%' OR event_type LIKE 'evaluation%')")
def metric_ids(spark: SparkSession, d: str) -> DataFrame:
    return readmodels.metric_ids(_log(spark, d))


@query(f"{SCORES}, wanted AS (SELECT DISTINCT run_id, metric_id FROM log WHERE event_type LIKE 'score%' AND metric_id IS NOT NULL) SELECT b.run_id, b.case_key, w.metric_id FROM base b JOIN wanted w USING (run_id) WHERE NOT EXISTS (SELECT 1 FROM last_score s WHERE s.run_id = b.run_id AND s.case_key = b.case_key AND s.metric_id = w.metric_id)")
def missing_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of a run that a case has neither a score nor a failure of."""
    log = _log(spark, d)
    wanted = log.filter("event_type like 'score%' and metric_id is not null").select("run_id", "metric_id").distinct()
    cases = log.filter("case_key is not null").select("run_id", "case_key").distinct()
    have = log.filter("event_type in ('score_completed', 'score_failed') and done and case_key is not null")
    return candidates.pending(cases.join(wanted, "run_id"), have, ["run_id", "case_key", "metric_id"])


@query("SELECT case_id, count(*) AS datasets FROM (SELECT DISTINCT dataset_id, case_id FROM cases) GROUP BY 1 HAVING count(*) > 1")
def ambiguous_case_ids(spark: SparkSession, d: str) -> DataFrame:
    return readmodels.ambiguous_case_ids(table(spark, d, "cases"))


@query(f"SELECT run_id, sequence, parent_pos AS response_pos, child_pos AS message_pos, role, content FROM ({flat_sql('evaluation', 'judge_responses.conversation_trace.messages', {'role': 'role', 'content': 'content'})})")
def conversation_traces(spark: SparkSession, d: str) -> DataFrame:
    """Messages of the judges' conversations: run_id, sequence, response_pos, message_pos, role, content."""
    triples = nested.evaluation_triples(table(spark, d, "run_events"), tables=["judge_responses.conversation_trace.messages"])
    rows = nested.pivoted(triples, ["run_id", "sequence"], "judge_responses.conversation_trace.messages", {"role": "role", "content": "content"})
    return rows.select("run_id", "sequence", F.col("parent_pos").alias("response_pos"), F.col("child_pos").alias("message_pos"), "role", "content")


@query(f"{STATES} SELECT run_id, case_key, n_generated, n_scores, CASE WHEN n_generated = 0 THEN 'generate' WHEN reduced_candidate_id IS NULL THEN 'reduce' WHEN parsed_null IS NULL THEN 'parse' WHEN n_scores = 0 THEN 'score' ELSE 'judge' END AS next_stage FROM states")
def next_stages(spark: SparkSession, d: str) -> DataFrame:
    """The stage at which each case would go on."""
    return readmodels.next_stages(fold.case_states(_log(spark, d)))


@query(f"{STATES} SELECT run_id, case_key, n_generated, reduced_candidate_id, NULL::VARCHAR AS parse_error, 0::BIGINT AS n_scores, 0::BIGINT AS n_evaluations FROM states")
def replay_from_parse(spark: SparkSession, d: str) -> DataFrame:
    return fold.replayed(fold.case_states(_log(spark, d)), "parse").select("run_id", "case_key", "n_generated", "reduced_candidate_id", "parse_error", "n_scores", "n_evaluations")


@query("SELECT event_type, count(DISTINCT (run_id, sequence)) AS n FROM run_events GROUP BY 1")
def live_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by type as a stream delivers them, redelivered copies counted once: files are read as they arrive, batches
    are appended, and the counts are read when the stream has caught up."""
    return live.caught_up_counts(live.event_stream(spark, f"{d}/run_events.parquet", "id bigint, " + EVENTS))


# --- judges


_FIRST = f"list_filter(regexp_split_to_array(lower(coalesce(label, '')), '{WS}+'), lambda x: x <> '')[1]"
_LABEL_SCORE = "CASE WHEN l IN ('pass', 'yes', 'correct', 'true', '1') THEN 1.0 WHEN l IN ('fail', 'no', 'incorrect', 'false', '0') THEN 0.0 WHEN regexp_full_match(l, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN l::DOUBLE WHEN l IS NULL THEN NULL ELSE 0.0 END"
_JUDGED = f"j AS (SELECT DISTINCT judgment_id, {KEY} AS case_key, candidate_id, judge_model_id, {_FIRST} AS l FROM parsed_judgments), s AS (SELECT *, ({_LABEL_SCORE})::DOUBLE AS score FROM j)"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "parsed_judgments").select("judgment_id", case_key_or_derived(F.col("case_key"), F.col("dataset_id"), F.col("case_id")).alias("case_key"), "candidate_id", "judge_model_id", text.first_word(F.col("label")).alias("label")).distinct()
    return rows.withColumn("score", F.when(F.col("label").isNotNull(), text.pass_fail_score(F.col("label"))))


@query(f"WITH {_JUDGED} SELECT judgment_id, l AS label, score FROM s")
def judgment_scores(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("judgment_id", "label", "score")


@query(f"WITH {_JUDGED} SELECT case_key, candidate_id, count(score) AS n, count(*) FILTER (score IS NULL) AS failures, round(avg(score), 9) AS mean FROM s GROUP BY 1, 2")
def judge_means(spark: SparkSession, d: str) -> DataFrame:
    found = judging.mean_score(_judged(spark, d), ["case_key", "candidate_id"])
    return found.withColumn("mean", F.round("mean", 9))


@query(f"WITH {_JUDGED}, c AS (SELECT case_key, candidate_id, l, count(*) AS votes, min(judgment_id) AS f, max(score) AS score FROM s WHERE l IS NOT NULL GROUP BY 1, 2, 3) SELECT case_key, candidate_id, l AS winner, votes, score AS value FROM (SELECT *, row_number() OVER (PARTITION BY case_key, candidate_id ORDER BY votes DESC, f) AS r FROM c) WHERE r = 1")
def judge_majorities(spark: SparkSession, d: str) -> DataFrame:
    return judging.majority_score(_judged(spark, d), ["case_key", "candidate_id"], "judgment_id")


@query(f"WITH {_JUDGED}, m AS (SELECT case_key, judge_model_id, round(avg(score), 9) AS v FROM s GROUP BY 1, 2), p AS (SELECT a.case_key, CASE WHEN a.v > b.v THEN 'a' WHEN a.v < b.v THEN 'b' ELSE 'tie' END AS label FROM m a JOIN m b USING (case_key) WHERE a.judge_model_id = 'arbiter-s' AND b.judge_model_id = 'hearth-judge' AND a.v IS NOT NULL AND b.v IS NOT NULL) SELECT case_key, label AS winner, CASE label WHEN 'a' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0.0 END::DOUBLE AS value FROM p")
def pairwise_scores(spark: SparkSession, d: str) -> DataFrame:
    """The mean judgments of two judges about the same case against each other."""
    means = judging.mean_score(_judged(spark, d), ["case_key", "judge_model_id"]).filter("mean is not null").withColumn("mean", F.round("mean", 9))
    return judging.pairwise(means, "case_key", "judge_model_id", "mean", "arbiter-s", "hearth-judge")


@query(f"WITH {_JUDGED}, n AS (SELECT *, nullif(lower(trim(judge_model_id)), '') AS judge FROM s), m AS (SELECT case_key, judge, round(avg(score), 9) AS v FROM n WHERE score IS NOT NULL AND judge IS NOT NULL GROUP BY 1, 2), hub AS (SELECT judge FROM m GROUP BY 1 ORDER BY count(*) DESC, judge LIMIT 1), p AS (SELECT a.case_key, a.judge, CASE WHEN a.v > b.v THEN 'a' WHEN a.v < b.v THEN 'b' ELSE 'tie' END AS winner FROM m a JOIN m b USING (case_key) WHERE b.judge = (SELECT judge FROM hub) AND a.judge <> b.judge) SELECT case_key, judge, winner, CASE winner WHEN 'a' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0.0 END::DOUBLE AS value FROM p")
def judge_pairwise_scores(spark: SparkSession, d: str) -> DataFrame:
    """The mean judgments of every judge (a) against those of the judge with the most cases (b) about the same case."""
    named = _judged(spark, d).withColumn("judge", F.lower(F.trim("judge_model_id"))).filter("judge <> ''")
    means = staged(judging.mean_score(named, ["case_key", "judge"]).filter("mean is not null").select("case_key", "judge", F.round("mean", 9).alias("mean")))  # read three times
    hub = means.groupBy("judge").count().orderBy(F.desc("count"), "judge").limit(1).select("judge")
    base = means.join(hub, "judge", "left_semi").select("case_key", F.col("mean").alias("__b"))
    winner = F.when(F.col("mean") > F.col("__b"), "a").when(F.col("mean") < F.col("__b"), "b").otherwise("tie")
    return means.join(hub, "judge", "left_anti").join(base, "case_key").select("case_key", "judge", winner.alias("winner"), text.pairwise_score(winner).alias("value"))


_INDEX = "regexp_extract(candidate_id, '[0-9]+$')"


@query(f"WITH {_JUDGED}, m AS (SELECT case_key, candidate_id, try_cast({_INDEX} AS INT) AS candidate_index, round(avg(score), 9) AS strength FROM s WHERE candidate_id IS NOT NULL GROUP BY 1, 2, 3 HAVING avg(score) IS NOT NULL) SELECT case_key, candidate_index, candidate_id, strength FROM (SELECT *, row_number() OVER (PARTITION BY case_key ORDER BY strength DESC, candidate_index) AS r FROM m WHERE candidate_index IS NOT NULL) WHERE r = 1")
def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The candidate of each case that wins the duels of its judges' mean scores, in the order of candidates."""
    judged = _judged(spark, d).filter("candidate_id is not null").withColumn("candidate_index", F.regexp_extract("candidate_id", "[0-9]+$", 0).try_cast("int"))
    means = judging.mean_score(judged, ["case_key", "candidate_id", "candidate_index"]).filter("mean is not null and candidate_index is not null").withColumn("strength", F.round("mean", 9))
    return candidates.best_of_n(means, ["case_key"], "candidate_index", "candidate_id", "strength")


@query(f"WITH {_JUDGED} SELECT case_key, candidate_id, count(*) AS tests_total, count(*) FILTER (coalesce(score >= 1, false)) AS tests_passed, round(count(*) FILTER (coalesce(score >= 1, false)) / count(*), 9) AS pass_rate FROM s GROUP BY 1, 2")
def judgment_pass_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of the judgments of each candidate that pass it."""
    found = metrics.pass_rates(_judged(spark, d), ["case_key", "candidate_id"], F.coalesce(F.col("score") >= 1, F.lit(False)))
    return found.withColumn("pass_rate", F.round("pass_rate", 9))


# --- stores, caches, bundles


@query(f"WITH a AS (SELECT DISTINCT response_id, sha256(raw_response) AS h FROM judge_responses WHERE raw_response IS NOT NULL), c AS (SELECT DISTINCT sha256(expected_output->>'$.answer') AS h FROM cases WHERE expected_output IS NOT NULL AND json_type(expected_output) = 'OBJECT') SELECT response_id, c.h IS NOT NULL AS cache_hit FROM a LEFT JOIN c USING (h)")
def stage_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Which responses an earlier result (the answer of a case) stands for, by the hash of the content."""
    rows = table(spark, d, "judge_responses").filter("raw_response is not null").select("response_id", F.sha2("raw_response", 256).alias("cache_key")).distinct()
    answers = table(spark, d, "cases").filter("expected_output like '{%'").select(F.sha2(F.get_json_object("expected_output", "$.answer"), 256).alias("cache_key")).distinct()
    return store.cached(rows, answers.withColumn("cached", F.lit(True)), "cache_key").select("response_id", F.coalesce("cached", F.lit(False)).alias("cache_hit"))


@query("WITH a AS (SELECT DISTINCT response_id, sha256(raw_response) AS h FROM judge_responses WHERE raw_response IS NOT NULL), c AS (SELECT DISTINCT sha256(CASE WHEN json_type(expected_output) = 'OBJECT' THEN expected_output->>'$.answer' ELSE expected_output->>'$' END) AS h FROM cases WHERE expected_output IS NOT NULL) SELECT response_id, c.h IS NOT NULL AS cache_hit FROM a LEFT JOIN c USING (h)")
def answer_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """stage_cache_hits with the answers of all cases: those given as a JSON string or value, too."""
    rows = table(spark, d, "judge_responses").filter("raw_response is not null").select("response_id", F.sha2("raw_response", 256).alias("cache_key")).distinct()
    answers = table(spark, d, "cases").select(F.sha2(text.answer_text(F.col("expected_output"), "answer"), 256).alias("cache_key")).filter("cache_key is not null").distinct()
    return store.cached(rows, answers.withColumn("cached", F.lit(True)), "cache_key").select("response_id", F.coalesce("cached", F.lit(False)).alias("cache_hit"))


@query("SELECT 'sha256:' || sha256(text) AS blob_ref, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def blobs(spark: SparkSession, d: str) -> DataFrame:
    return store.blobs(table(spark, d, "documents"), "text", "doc_id")


@query(f"SELECT DISTINCT r.response_id FROM judge_responses r WHERE NOT EXISTS (SELECT 1 FROM cases c WHERE c.dataset_id = r.dataset_id AND c.case_id = r.case_id AND c.revision = 'r1')")
def bundle_unknown_cases(spark: SparkSession, d: str) -> DataFrame:
    """Records of a bundle whose case isn't in the dataset (here its revision r1); an import with any is refused."""
    known = table(spark, d, "cases").filter("revision = 'r1'").select("dataset_id", "case_id")
    return store.unknown(table(spark, d, "judge_responses"), known, ["dataset_id", "case_id"]).select("response_id").distinct()


@query(f"WITH {LOG} SELECT run_id, seq, case_key, candidate_id, candidate_index FROM log WHERE event_type = 'generation_completed' AND done")
def generation_bundle(spark: SparkSession, d: str) -> DataFrame:
    return store.bundle(_log(spark, d), "generation").select("run_id", "seq", "case_key", "candidate_id", "candidate_index")


@query(f"WITH {LOG} SELECT run_id, count(*) AS events, min(seq) AS first_seq, max(seq) AS last_seq, count(DISTINCT case_key) AS cases, min(occurred_at) AS first_at, max(occurred_at) AS last_at FROM log GROUP BY 1")
def run_scan(spark: SparkSession, d: str) -> DataFrame:
    return readmodels.runs(_log(spark, d))


# --- reports


@query(f"{SCORES} SELECT run_id, case_id, case_key, metric_id, coalesce(candidate_id, '') AS candidate_id, value, outcome, coalesce(error_category, '') AS error_category, coalesce(error_message, '') AS error_message FROM score_rows")
def score_table(spark: SparkSession, d: str) -> DataFrame:
    return report.score_table(fold.score_rows(_log(spark, d)))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(coalesce(text, ''), '\\', chr(57344)), '{', chr(57350)), '}', chr(57351)), '&', '\\&'), '%', '\\%'), '$', '\\$'), '#', '\\#'), '_', '\\_'), '~', '\\textasciitilde{}'), '^', '\\textasciicircum{}'), chr(57344), '\\textbackslash{}'), chr(57350), '\\{'), chr(57351), '\\}'), chr(57352), '') AS latex FROM documents""")
def latex_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.latex_escaped(F.col("text")).alias("latex"))


@query(f"{SCORES} SELECT metric_id, count(*) AS rows, count(value) AS scored, count(*) FILTER (outcome = 'error') AS errors, round(avg(value), 9) AS mean FROM score_rows GROUP BY 1")
def quickcheck(spark: SparkSession, d: str) -> DataFrame:
    found = report.quickcheck(fold.score_rows(_log(spark, d)))
    return found.withColumn("mean", F.round("mean", 9))


# --- materializers of benchmark rows


@query("SELECT p_partkey, 'Question:\n' || p_name || '\n\nOptions:\nA. ' || p_brand || '\nB. ' || p_type || '\nC. ' || p_size || '\n\nReturn the best option letter only.' AS prompt FROM part")
def choice_prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.choice_prompt(F.col("p_name"), F.array("p_brand", "p_type", F.col("p_size").cast("string"))).alias("prompt"))


@query("WITH m AS (SELECT DISTINCT record_id, from_json(json_extract(input, '$.messages'), '[{\"role\": \"VARCHAR\", \"content\": \"VARCHAR\"}]') AS ms FROM cases WHERE json_type(input, '$.messages') = 'ARRAY') SELECT record_id, array_to_string(list_transform(ms, lambda x: x.role || ': ' || x.content), chr(10) || chr(10)) AS prompt FROM m")
def chat_prompts(spark: SparkSession, d: str) -> DataFrame:
    messages = F.from_json(F.get_json_object("input", "$.messages"), "array<struct<role:string,content:string>>")
    rows = table(spark, d, "cases").select("record_id", messages.alias("m")).filter("m is not null")
    return rows.select("record_id", F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n\n").alias("prompt")).distinct()


@query("SELECT DISTINCT record_id, coalesce(metadata['lang'], '') AS lang, coalesce(metadata['difficulty'], '') AS difficulty, cardinality(metadata)::INT AS members FROM cases")
def metadata_strings(spark: SparkSession, d: str) -> DataFrame:
    m = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    return table(spark, d, "cases").select("record_id", F.coalesce(F.try_element_at(m, F.lit("lang")), F.lit("")).alias("lang"), F.coalesce(F.try_element_at(m, F.lit("difficulty")), F.lit("")).alias("difficulty"), F.size(m).alias("members")).distinct()


@query("SELECT 'test-' || row_number() OVER (ORDER BY event_id) AS case_id, event_id, event_type FROM events QUALIFY event_type = 'purchase'")
def filtered_cases(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a filter keeps, numbered as before the filter."""
    numbered = report.numbered(table(spark, d, "events"), "event_id")
    return numbered.select(F.concat(F.lit("test-"), F.col("position").cast("string")).alias("case_id"), "event_id", "event_type").filter("event_type = 'purchase'")


@query("SELECT 'customer' AS subset, 'customer-' || c_custkey AS case_id, c_name AS role FROM customer UNION ALL SELECT 'supplier', 'supplier-' || s_suppkey, s_name FROM supplier")
def united_cases(spark: SparkSession, d: str) -> DataFrame:
    part = lambda name, key, role: table(spark, d, name).select(F.lit(name).alias("subset"), F.concat(F.lit(f"{name}-"), F.col(key).cast("string")).alias("case_id"), F.col(role).alias("role"))
    return part("customer", "c_custkey", "c_name").unionByName(part("supplier", "s_suppkey", "s_name"))

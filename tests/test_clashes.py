"""Extra columns whose names clash with those that operators use, and nulls in every column."""

from pyspark.sql import functions as F

from scorelake.operators import changes, drift, fold, nested

EVENTS = "id bigint, run_id string, sequence bigint, store_id string, file_no int, event_type string, schema_version string, occurred_at timestamp, dataset_id string, case_id string, case_key string, candidate_id string, candidate_index int, metric_id string, seed bigint, error_message string, event_json string"


def clashing(df, names):
    return df.withColumns({n: F.lit(i) for i, n in enumerate(names)})


def test_clashing_names_and_nulls(spark):
    payload = '{"event_type": "score_completed", "metric_id": "m", "score": {"value": 1}}'
    row = (1, "r", 1, "s", 1, "score_completed", "1", None, "d", "c", "1:d:c", "k", 0, "m", None, None, payload)
    nulls = [tuple(None if j == i else v for j, v in enumerate(row)) for i in range(len(row))] + [(None,) * len(row)]
    plain = spark.createDataFrame([row, row, *nulls], EVENTS)
    events = clashing(plain, ["seq", "deleted", "value", "kind", "field", "fate", "bucket", "n", "place", "table_path", "ordinals", "ok", "stage", "done", "status", "reason"])
    told = lambda df: sorted(map(str, df.collect()))
    for query in (changes.current_scores, drift.drift_report, drift.rescue_rates, lambda e: drift.ingested(e, ["id", "store_id"], "event_json"), fold.event_log, lambda e: fold.score_rows(fold.event_log(e)), lambda e: fold.run_states(fold.event_log(e)), lambda e: nested.evaluation_triples(e)):
        assert told(query(events)) == told(query(plain))
        assert query(events.limit(0)).count() == 0

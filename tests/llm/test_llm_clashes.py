"""Extra columns whose names clash with those that operators use, and nulls in every column."""

import datetime as dt

from pyspark.sql import functions as F

from scorelake.llm import consensus, mixing, packing, pairs, quantiles, sentences


def clashing(df, names):
    return df.withColumns({n: F.lit(i) for i, n in enumerate(names) if n not in df.columns})


def dirty(spark, rows, schema):
    width = len(rows[0])
    nulls = [tuple(None if j == i else v for j, v in enumerate(rows[0])) for i in range(width)] + [(None,) * width]
    return spark.createDataFrame([*rows, rows[0], *nulls], schema)


def test_clashing_names_and_nulls(spark):
    told = lambda df: sorted(map(str, df.collect()))
    docs = dirty(spark, [(1, "One sentence here. Two now.", "a")], "doc_id bigint, text string, source string")
    targets = dirty(spark, [("a", 1.0, 2)], "source string, target_weight double, max_repeats int")
    judged = dirty(spark, [(1, "d", "c", "1:d:c", "k", "j", 0, "pass", 1.0)], "judgment_id bigint, dataset_id string, case_id string, case_key string, candidate_id string, judge_model_id string, repeat_index int, label string, score double")
    timed = dirty(spark, [("m", dt.date(2026, 1, 1), 5.0)], "m string, day date, v double")
    cases = dirty(spark, [(1, "d", "r", "c", "1:d:c", '{"question": "What is 1 plus 2?"}', '{"answer": "The sum of 1 and 2 is 3."}')], "record_id bigint, dataset_id string, revision string, case_id string, case_key string, input string, expected_output string")
    said = dirty(spark, [(1, "d", "c", "1:d:c", "The sum of 1 and 2 is 3.")], "response_id bigint, dataset_id string, case_id string, case_key string, raw_response string")
    names = ["answer", "word", "kind", "n", "sent_start", "piece", "block", "container", "slot", "n_tokens", "rate", "part", "place", "copies", "copy", "judge", "votes", "top", "w_pass", "sketch", "input_", "defect_type", "source_table", "__key"]
    for query, tables in (
        (lambda d: sentences.split(d), [docs]), (lambda d: packing.packed(d, capacity=64), [docs]), (lambda d, t: mixing.mixed(d, t)[0], [docs, targets]), (lambda d, t: mixing.mixed(d, t)[1], [docs, targets]),
        (lambda j: consensus.consensus(j)[0], [judged]), (lambda t: quantiles.sketches(t, ["m", "day"], "v").select("m", "day", "n"), [timed]), (lambda c, r: pairs.defective(c, r), [cases, said]),
    ):
        assert told(query(*(clashing(t, names) for t in tables))) == told(query(*tables))
        query(*(t.limit(0) for t in tables)).count()

import os

import pytest

import __spark_entry__ as entry


def test_names_and_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p2_found", "p4_found", "p5_found"} <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_results_equal_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for file in os.listdir(d):
        con.execute(f"create view {file[:-8]} as select * from read_parquet('{d}/{file}')")
    for name in ("p4_found", "case_states", "run_states", "score_rows", "paired_comparisons", "token_scores", "majority_votes", "judge_call_plan", "case_results"):
        found = entry.queries()[name](spark, d)
        told = con.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in told.description]
        plain = lambda v: round(v, 6) if isinstance(v, float) else v
        assert sorted(map(str, (tuple(map(plain, r)) for r in told.fetchall()))) == sorted(map(str, (tuple(plain(r[c]) for c in columns) for r in found.collect()))), name

"""Paths for large inputs give the results of those for small ones."""

import sys
from pathlib import Path

from scorelake.llm import consensus as C
from scorelake.llm import sentences as S

sys.path.insert(0, str(Path(__file__).parent))
from test_consensus import SCHEMA, planted  # noqa: E402


def test_a_joined_lexicon_holds_every_lookup(spark, monkeypatch):
    docs = [(i, f"The set has {i} items in Wk. Orr and then more. eBay-like, names are kept.\n\neBay-like, names are kept.\n\nwk is short, *Wk. Vale said.") for i in range(30)]
    docs += [(99, "It was in 'Wk. Orr saw it! eBay-like, names are kept. wk, it is."), (98, "It was in *Wk. Orr saw it!"), (97, None), (96, "It ended.wk. Orr saw it!\n\n“Is it?” eBay-like; so.”")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = sorted(map(tuple, S.split(df).collect()))
    assert {r["verdict"] for r in S.decided(S.corpus_evidence(df)).filter("word = 'wk'").collect()} == {"nonfinal", "opener"}
    assert [docs[30][1][a:b] for i, a, b in rows if i == 99] == ["It was in 'Wk. Orr saw it!", "eBay-like, names are kept.", "wk, it is."]
    monkeypatch.setattr(S, "LEXICON_BOUND", 0)
    assert sorted(map(tuple, S.split(df).collect())) == rows


def test_joined_judges_give_the_same_consensus(spark, monkeypatch):
    _, rows = planted(80, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    told = lambda found: [{r[0] if "judge" in r else (r[0], r[1]): tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in part.collect()} for part in found]
    held = told(C.consensus(df, rounds=8))
    monkeypatch.setattr(C, "JUDGE_BOUND", 2)
    joined = told(C.consensus(df, rounds=8))
    assert joined == held and held[1]["turned"][-2] is True

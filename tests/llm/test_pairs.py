import json
import random

from scorelake.llm import pairs as P

CASES = "record_id bigint, dataset_id string, revision string, case_id string, case_key string, input string, expected_output string, metadata map<string,string>"
RESPONSES = "response_id bigint, dataset_id string, case_id string, case_key string, raw_response string, extra string"


def make(i, code):
    n, m = 11 + i % 80, 7 + i % 31
    texts = {
        "en": (f"What is {n} plus {m}?", f"The sum of {n} and {m} is {n + m}, which you get by adding the tens first."),
        "de": (f"Wer pflegt die Liste Quant{n}, und wie oft wird sie erneuert?", f"Die Gruppe kilo-{n} pflegt die Liste Quant{n} und erneuert sie alle {m} Tage."),
        "fr": (f"Quel magasin conserve les événements de l'exécution {n} ?", f"Les événements de l'exécution {n} sont conservés dans le magasin bleu-{m}."),
        "zh": (f"运行{n}的事件保存在哪个存储中？", f"运行{n}的事件保存在存储蓝色{m}里，并且按照到达的顺序排列。"),
    }
    return texts[code]


def stock(n=240):
    return [(*make(i, ["en", "de", "fr", "zh"][i % 4]),) for i in range(n)]


def test_held_out_accuracy():
    model = P.fitted(stock())
    rng = random.Random(5)
    asked, said, want = [], [], []
    for i in range(300, 380):
        code = ["en", "de", "fr", "zh"][i % 4]
        q, a = make(i, code)
        other = make(i, ["de", "fr", "en", "en"][i % 4])[1]
        cut = a[: int(len(a) * rng.uniform(0.4, 0.9))]
        for said_, kind in ((a, None), (f"{q} {a}", None), (cut if cut[-1] not in ".。" else cut[:-2], "truncated"), (q, "copied_question"), (q.upper(), "copied_question"), (json.dumps({"answer": q}), "copied_question"), (other, "wrong_language"), (rng.choice(P.REFUSALS[code]), "refusal"), (rng.choice(P.PLACEHOLDERS), "empty"), (None, "empty")):
            asked.append(q), said.append(said_), want.append(kind)
    got = model.defects(asked, said)
    assert sum(g == w for g, w in zip(got, want)) / len(want) > 0.97, [(q, a, w, g) for q, a, w, g in zip(asked, said, want, got) if w != g][:5]


#: Neither is in the training lists.
UNSEEN_REFUSALS = {
    "en": ["I'm afraid I can't answer that question for you.", "That is not something I'm willing to help with.", "My guidelines don't let me respond to this request, sorry."],
    "de": ["Tut mir leid, diese Frage kann ich Ihnen nicht beantworten.", "Dabei möchte ich nicht helfen."],
    "fr": ["Désolé, je ne suis pas autorisé à vous aider sur ce point.", "Je ne peux malheureusement pas répondre à cette demande."],
    "zh": ["抱歉，我不能回答这个请求。", "对不起，我无法讨论这个问题。"],
}
UNSEEN_PLACEHOLDERS = ["answer: n/a", "<response> </response>", "--", "Final response:", "[no response]", "\\boxed{ }", "   \t", "```python\n```", "Ergebnis: -", "**"]


def test_unseen_refusals_placeholders_and_languages():
    model = P.fitted(stock())
    asked, said, want = [], [], []
    for i in range(400, 460):
        code = ["en", "de", "fr", "zh"][i % 4]
        q, a = make(i, code)
        for text, kind in ((UNSEEN_REFUSALS[code][i % len(UNSEEN_REFUSALS[code])], "refusal"), (UNSEEN_PLACEHOLDERS[i % len(UNSEEN_PLACEHOLDERS)], "empty"), (a, None)):
            asked.append(q), said.append(text), want.append(kind)
    got = model.defects(asked, said)
    wrong = [(q, a, w, g) for q, a, w, g in zip(asked, said, want, got) if w != g]
    assert len(wrong) / len(want) < 0.05, wrong[:6]
    q = "How many people lived in Paris in 2019?"
    answers = {
        "I'm sorry, but I can't tell you how many people lived in Paris in 2019.": "refusal",
        "About 2.1 million people lived in Paris in 2019.": None,
        "Im Jahr 2019 lebten etwa 2,1 Millionen Menschen in Paris.": "wrong_language",
        "År 2019 bodde ungefär 2,1 miljoner människor i Paris.": "wrong_language",
        "W 2019 roku w Paryżu mieszkało około 2,1 miliona ludzi.": "wrong_language",
        "About 2.1 million people lived in Par": "truncated",
        "2.1 million": None,
        "how many people lived in paris in 2019": "copied_question",
    }
    assert dict(zip(answers, model.defects([q] * len(answers), list(answers)))) == answers


def test_held_out_report_and_long_texts():
    model = P.fitted(stock())
    assert all(precision > 0.9 and recall > 0.9 for precision, recall in model.report.values()), model.report
    assert P.bare("The answer is: " * 500 + "x") == "is" and P.bare("Answer: " * 5000) == "" and P.bare("Answer: " * 5000 + "seven") == "seven"
    q, a = make(3, "zh")
    other = P.fitted(stock(40))  # a second model leaves the first as it is
    assert other.vocabulary != model.vocabulary and model.defects([q, q], [a, None]) == [None, "empty"]


def test_requested_language():
    model = P.fitted(stock())
    q, a = make(8, "en")
    german = make(9, "de")[1]
    assert model.defects([f"{q} Answer in German.", f"{q} Answer in German.", f"Responde en inglés. {make(10, 'fr')[0]}"], [german, a, a]) == [None, "wrong_language", None]


def test_parts():
    assert P.unwrapped('{"answer": "x"}') == ("x", False) and P.unwrapped('"{\\"answer\\": \\"y\\"}"') == ("y", False) and P.unwrapped('{"answer": "cut') == ("cut", True)
    assert P.unwrapped("plain") == ("plain", False) and P.unwrapped("{}") == ("", False)
    assert not any(P.bare(t) for t in P.PLACEHOLDERS) and P.bare("42") == "42"
    assert P.question_text('{"messages": [{"role": "user", "content": "hi"}]}') == "hi" and P.question_text('"q"') == "q" and P.question_text(None) == "" and P.question_text("{cut") == "{cut"
    endings = {"Done.": "whole", "so far [truncated]": "mark", "x\n```\na": "open", "The list (a-b)": "note", "all done ✅": "note", "42": "value", "a-b": "value", "and then the": "loose", "x.\n- a\n- b": "list"}
    assert {t: P._ending(t, False) for t in endings} == endings


def test_query_handles_dirty_rows(spark):
    rows = [(i, "d", None, f"c{i}", None if i % 5 else f"1:d:c{i}", json.dumps(q), json.dumps({"answer": a}), {}) for i, (q, a) in enumerate(stock(60))]
    rows += [rows[0], (900, "d", None, "c900", None, None, '"[]"', None), (901, "d", None, "c901", None, "{cut", None, None), (902, None, None, None, None, json.dumps("q" * 20000), json.dumps("The answer is 7. " * 5000), None)]
    cases = spark.createDataFrame(rows, CASES)
    said = [(1, "d", "c0", "", None, "x"), (1, "d", "c0", "", None, "x"), (2, "d", "c0", None, make(0, "en")[1], None), (3, "d", "unknown", None, "I cannot assist with this request.", None), (4, None, None, None, "...", None)]
    got = {(r["source_table"], r["record_id"], r["defect_type"]) for r in P.defective(cases, spark.createDataFrame(said, RESPONSES)).collect()}
    assert {g for g in got if g[0] == "judge_responses"} == {("judge_responses", 1, "empty"), ("judge_responses", 3, "refusal"), ("judge_responses", 4, "empty")}
    assert {g for g in got if g[0] == "cases"} == {("cases", 900, "empty")}
    assert P.defective(cases.limit(0), spark.createDataFrame([], RESPONSES)).count() == 0


def test_a_hot_case_is_split(spark):
    from pyspark.sql import functions as F

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        ids = spark.range(30_000)
        cases = ids.limit(2000).selectExpr("id as record_id", "'d' as dataset_id", "concat('c', id) as case_id", "cast(null as string) as case_key", "'\"q\"' as input", "cast(null as string) as expected_output")
        said = ids.repartition(12).selectExpr("id as response_id", "'d' as dataset_id", "if(id % 3 = 0, 'c7', concat('c', id % 2000)) as case_id", "'' as case_key", "sha2(string(id), 512) as raw_response")
        plan = P.pairs(cases, said).withColumn("n", F.length("answer"))._jdf.queryExecution().executedPlan()
        assert plan.execute().count() == 30_000 and "SortMergeJoin(skew=true)" in plan.toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

import pytest

from scorelake.llm import sentences as S

TEXTS = {
    "en": ["Dr. Vale met Mrs. Orr at 4 p.m. on Monday.|It cost approx. $1.357 per batch (see Fig. 3)!|(Nobody knew.)|“Is it done?” asked Vale.", "The file ends with ... and nothing else.|He wrote \"Fail. No answer.\" and left.|Really?!|A. Vale, B. Orr and J. R. Poe wrote it."],
    "de": ["Im 1. Quartal fiel der Wert auf 0,841.|Dr. Vale prüfte z. B. 518 Fälle.|„Fertig“, sagte Orr.|Er schrieb: „Nicht gut. Kein Ergebnis.“|Wirklich?", "Es gilt die Regel Nr. 383.|Am 3. April kam Vale."],
    "fr": ["M. Vale a relu 3 cas.|Le juge a écrit : « Échec. Pas de réponse. »|Vraiment ?!"],
    "es": ["¿De verdad?|¡Nadie lo esperaba!|El Dr. Vale leyó la pág. 3 del n.º 5.|«¿Está listo?», preguntó Orr."],
    "ru": ["Отчёт подписал И. О. Вейл в 2026 г.|Прогон занял 8 мин. на узле.|«Готово?» — спросил Орр.|Там есть шаблоны и т. д.|Конец."],
    "el": ["Γιατί λείπει η γραμμή;|Ο κ. Vale έδωσε π.χ. 9 βαθμούς."],
    "zh": ["“完成了吗？”Vale问道。|评审写道：“不通过。没有答案。”|得分是26.78，不是268。|他问：“要算两次吗？”|“好。”Orr说（见表）。|真的吗？！"],
    "ja": ["「終わったのか？」とValeは尋ねた。|本当か？！|審査員は「不合格。」と書いた。"],
    "ko": ["심사자는 \"불합격. 답이 없음.\"이라고 적었다.|box v3.1을 비교했다."],
    "hi": ["डॉ. Vale ने 3 उत्तर जाँचे।|क्या यह सच है?|मान 1.94 है।"],
    "th": ["มีการทดสอบ 894 ครั้ง|ไฟล์ plan.csv เก็บไว้|ความแม่นยำ 8.94 จุด"],
    "ar": ["راجع د. Vale نحو 3 حالة؛ وهي ثابتة.|هل هذا صحيح؟"],
}


@pytest.mark.parametrize("code", TEXTS)
def test_languages(code):
    gap = "" if code in ("zh", "ja") else " "
    for shown in TEXTS[code]:
        want = shown.split("|")
        text = gap.join(want)
        assert [text[a:b] for a, b in S.sentences(text)] == want


def test_blocks_lists_and_headings():
    text = "﻿# A heading. With a stop\n\nOne line\nwraps here. Two.\n \n1. first item. Still it\n2. second\n\n- x\n* y\n\nNotes by Dr. Vale\n\nIm\n1. Quartal war es gut."
    assert [text[a:b] for a, b in S.sentences(text)] == ["# A heading. With a stop", "One line\nwraps here.", "Two.", "1. first item. Still it", "2. second", "- x", "* y", "Notes by Dr. Vale", "Im\n1. Quartal war es gut."]


def test_scripts_that_meet_without_a_blank():
    for want in (["It ran on build 10.0.0.1 under x.", "962件が失敗した。", "Nobody expected that!", "Vale说：“好。”", "なぜ消えたのか？", "box-a v3.1を比べた。"], ["We used box-a v7.8.4 with more, e.g. on it.", "共有732个用例。"]):
        text = "".join(want)
        assert [text[a:b] for a, b in S.sentences(text)] == want
    text = "\ufeffJ. R. Orr signed it. Отчёт подписан в 2026 г. «Готово?» — спросил он. В 2026 г. 3 задания."
    assert [text[a:b] for a, b in S.sentences(text)] == ["J. R. Orr signed it.", "Отчёт подписан в 2026 г.", "«Готово?» — спросил он.", "В 2026 г.", "3 задания."]


def test_nothing_is_lost_and_edges():
    assert S.sentences(None) == S.sentences("") == S.sentences(" \n﻿ ") == []
    for text in ("…", "?!", "a" * 50_000, "No end " * 9000, "Yes. " * 20_000, '"open. quote', "x y. Z", "😀. Ok 😀!"):
        spans = S.sentences(text)
        assert all(a < b for a, b in spans) and all(p[1] <= q[0] for p, q in zip(spans, spans[1:]))
        assert "".join(text[a:b] for a, b in spans).replace(" ", "") == "".join(c for c in text if c not in "  ") or " " in text


def test_the_document_decides():
    shown = "The qvz. is small. The qvz. was read. See qvz. Then go on."
    assert [shown[a:b] for a, b in S.sentences(shown)] == ["The qvz. is small.", "The qvz. was read.", "See qvz. Then go on."]
    other = shown + "\n\nIt is a qvz."  # an unambiguous end elsewhere in the document
    assert [other[a:b] for a, b in S.sentences(other)][2:4] == ["See qvz.", "Then go on."]


def test_the_corpus_decides(spark, monkeypatch):
    docs = [(i, f"The set has {i} items in Wk. Orr and then more. eBay-like names are kept.\n\neBay-like names are kept.", "x") for i in range(30)] + [(99, "It was in Wk. Orr saw it! eBay-like names are kept.", None), (98, None, None), (97, "", None), (97, "A. B.", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, word string")
    rows = S.split(df).collect()
    got = sorted((r["sent_start"], r["sent_end"]) for r in rows if r["doc_id"] == 99)
    assert [docs[30][1][a:b] for a, b in got] == ["It was in Wk. Orr saw it!", "eBay-like names are kept."]
    monkeypatch.setattr(S, "LEXICON_BOUND", 0)  # a lexicon too large to hold is joined
    assert sorted(map(tuple, S.split(df).collect())) == sorted(map(tuple, rows))
    assert S.split(df.limit(0)).count() == 0


def test_proper_names_and_common_words_of_the_document():
    split = lambda t: [t[a:b] for a, b in S.sentences(t)]
    assert split("Prof. Xaver Wodehouse wrote to Acad. Wodehouse. Wodehouse replied.") == ["Prof. Xaver Wodehouse wrote to Acad. Wodehouse.", "Wodehouse replied."]
    assert split("Later the man Orr met Col. Orr. Orr was glad.") == ["Later the man Orr met Col. Orr.", "Orr was glad."]
    # "Rome" stands without a period too, so it is a word like others, although a name follows
    assert split("In Rome we met the man Orr. He likes Rome. Orr was glad.") == ["In Rome we met the man Orr.", "He likes Rome.", "Orr was glad."]
    # the document shows an abbreviation; a common word after it begins a sentence, a name doesn't
    shown = "It is of use in the dpt. of law and in the dpt. of art. She left the dpt. Of that we know. The man Orr saw dpt. Orr."
    assert split(shown)[1:3] == ["She left the dpt.", "Of that we know."] and split(shown)[3] == "The man Orr saw dpt. Orr."


def test_lists_are_only_a_last_resort(monkeypatch):
    monkeypatch.setattr(S, "NONFINAL", frozenset())
    monkeypatch.setattr(S, "FINAL", frozenset())
    text = "We met Mrs. Orr, Mrs. Vale and a Mrs., as the mrs. says. It took approx. ten days. It cost approx. Five were left."
    assert [text[a:b] for a, b in S.sentences(text)] == ["We met Mrs. Orr, Mrs. Vale and a Mrs., as the mrs. says.", "It took approx. ten days.", "It cost approx. Five were left."]
    lexicon = S.Lexicon(nonfinal=frozenset(["mrs"]))
    assert len(S.sentences("We met Mrs. Orr. She left.", lexicon)) == 2


def test_words_of_any_length_and_long_runs():
    long = "x" * 100_000
    for text in (f"{long}. Then it ended.", f"See {long}. {long}? Yes.", "漢字" * 50_000 + "。終。", "a.b." * 20_000 + " End."):
        spans = S.sentences(text)
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert len(S.sentences(f"{long}. Then it ended.")) == 2


def test_a_joined_lexicon_takes_two_verdicts_of_a_word(spark, monkeypatch):
    # "ab" ends blocks and stands inside (final), opens blocks (opener); "cd" is nonfinal and an opener
    docs = [(i, f"ab is {i} ab. and so on. It is cd. Orr here, ab. The end! cd goes on.\n\nab. cd follows\n\ncd follows\n\nThat was ab.") for i in range(30)] + [(99, None), (98, "x cd. Orr saw ab. Two! ab three.")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = sorted(map(tuple, S.split(df).collect()))
    monkeypatch.setattr(S, "LEXICON_BOUND", 0)
    assert sorted(map(tuple, S.split(df).collect())) == rows
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    joined = sorted(map(tuple, S.split(real).collect()))
    monkeypatch.undo()
    assert sorted(map(tuple, S.split(real).collect())) == joined

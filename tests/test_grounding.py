"""Grounding, citations, evaluation."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spindrift.operators import citations, evaluation, grounding
from spindrift.sources import golden

EVIDENCE = "answer_id int, ref int, source_id string, title string, heading string, breadcrumb string, content string"
SQL = "answer_id int, call_no int, sql string, referenced_tables array<string>, row_count_returned int"
DOCS = [(1, 1, "tides", "Tide tables", "Spring", "Coast > Harbour", "High water comes twice a day."), (1, 2, "lamps", "Lamp log", "Wicks", None, "The wick is trimmed at dusk.")]


def ground(spark, text, docs=DOCS, sql=()):
    return grounding.ground_one(
        spark.createDataFrame([(1, text)], "answer_id int, text string"), spark.createDataFrame(list(docs), EVIDENCE), spark.createDataFrame(list(sql), SQL) if sql else None
    )


CASES = [
    ("Water rises twice daily. [1]\nNobody wrote this down.", "Water rises twice daily.", ["tides"], ["Nobody wrote this down."]),
    ("The wick is short [2].", "The wick is short.", ["lamps"], []),
    ("Wick [2] before water [1], wick again [2], and a ghost [77].", "Wick before water, wick again, and a ghost.", ["lamps", "tides"], []),
    ("Calm [1] ,   dark [2] !", "Calm, dark!", ["tides", "lamps"], []),
    ("Lit [2][2][1]\nWet [1]", "Lit\nWet", ["lamps", "tides"], []),
    ("Both logs agree [1] , [2]", "Both logs agree", ["tides", "lamps"], []),
    ("등대 [2]는 밝다.", "등대는 밝다.", ["lamps"], []),
    ("물때 [1],[2]와 바람.", "물때와 바람.", ["tides", "lamps"], []),
    ("물때 [1] 그리고 바람.", "물때 그리고 바람.", ["tides"], []),
    ("# Watch\n| Hour | Note |\n|:---|---:|\n| dusk | trim [2] |\n| dawn | lost [8] |", "# Watch\n| Hour | Note |\n|:---|---:|\n| dusk | trim |", ["lamps"], ["| dawn | lost [8] |"]),
    ("| noon [1] | flood | read [2] |", "| noon [1] | flood | read |", ["lamps"], []),
    ("```\nraw [8]\n```\n> aside\n* point\nSo [1]!\nNo [1]?", "```\nraw [8]\n```\nSo!\nNo?", ["tides"], ["> aside", "* point"]),
    ("***\n\n   ## Night\nDark [2]", "***\n\n   ## Night\nDark", ["lamps"], []),
]


def test_drafts(spark):
    drafts = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "answer_id int, text string")
    known = spark.createDataFrame([(i, *d[1:]) for i in range(len(CASES)) for d in DOCS], EVIDENCE)
    got = {r.answer_id: r for r in grounding.ground(drafts, known).collect()}
    for i, (text, answer, cited, dropped) in enumerate(CASES):
        assert (got[i].answer, [c.source_id for c in got[i].citations], list(got[i].dropped)) == (answer, cited, dropped), text


def test_refusals(spark):
    for text, docs in (("Surely so.\nAnd more.", DOCS), ("Says who? [31]", DOCS), ("No log at all.", [])):
        with pytest.raises(grounding.NoEvidenceError):
            ground(spark, text, docs)


def test_sql_evidence(spark):
    out = ground(spark, "Three ships came in.", [], [(1, 1, "select 1", ["p.d.t", "p.d.u"], 3)])
    assert out["answer"] == "Three ships came in." and out["citations"][0]["source_id"] == "p.d.t" and out["citations"][0]["snippet"] == "3 rows returned"
    mixed = ground(spark, "Trimmed [2].\nGuessed.", DOCS, [(1, 1, "select 1", [], None)])
    assert [c["source_id"] for c in mixed["citations"]] == [grounding.UNKNOWN_TABLE, "lamps"] and mixed["dropped"] == ["Guessed."]


def without_markers(text):
    """The rule by characters: each is marked as gone or not, and what is left is tidied."""
    gone = [False] * len(text)
    markers = [(m.start(), m.end()) for m in re.finditer(r"\[[0-9]+\]", text)]
    for i, (a, b) in enumerate(markers):
        gap = text[b : markers[i + 1][0]] if i + 1 < len(markers) else None
        joined = gap == "" or gap is not None and gap.strip(" \t") == ","
        gone[a : b + len(gap) if joined else b] = [True] * (b - a + (len(gap) if joined else 0))
    following = ""
    for i in reversed(range(len(text))):
        if gone[i]:
            continue
        if following and i + 1 < len(text) and gone[i + 1] and "가" <= following <= "힣" and text[i] in " \t":
            gone[i] = True  # blanks between a word and the particle that its marker stood before
        else:
            following = text[i]
    kept = "".join(c for c, x in zip(text, gone) if not x)
    indent = len(text) - len(text.lstrip(" \t"))
    words = re.sub("[ \t][ \t]+", " ", kept[indent:].strip(" \t"))
    return text[:indent] + re.sub("[ \t]+(?=[.,!?])", "", words)


def test_marker_removal_by_characters(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choices(["[1]", "[22]", " ", ",", "가", "x", ".", "  "], k=rng.randrange(1, 12))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", grounding.remove_markers(F.col("t")).alias("c")).collect():
        assert r.c == without_markers(r.t), repr(r.t)


def test_last_evidence_wins_and_trace(spark):
    calls = spark.createDataFrame([(1, 1, 0, 1, "old"), (1, 2, 0, 1, "new"), (1, 1, 1, 2, "two"), (1, 3, 0, None, "x")], "answer_id int, call_no int, item_no int, ref int, content string")
    assert sorted((r.ref, r.content) for r in grounding.collect_evidence(calls).collect()) == [(1, "new"), (2, "two")]
    events = spark.createDataFrame([(1, 2, "a", "final", "x" * 100), (1, 1, "", "tool_call", "search"), (1, 3, "a", "other", "y")], "answer_id int, event_no int, agent string, kind string, detail string")
    assert [(r.step, r.agent, len(r.detail)) for r in grounding.trace(events).orderBy("step").collect()] == [(1, "unknown", 6), (2, "a", 80)]


def test_citation_rules(spark):
    s = "c struct<kind:string,source_id:string,title:string,heading:string,breadcrumb:string,sql:string,snippet:string>"
    cases = [
        (("document", "d", None, None, None, None, None), "heading or snippet"), (("document", "d", None, "h", None, None, None), None), (("bigquery", "p.d.t", None, None, None, None, None), "SQL"),
        (("bigquery", "t", None, None, None, "select 1", None), "fully-qualified"), (("bigquery", "p.d.t", None, None, None, "select 1", None), None), (("report", "r", None, None, None, None, None), None), (("other", "r", None, None, None, None, None), "kind"),
    ]
    errors = [r.e for r in spark.createDataFrame([(c,) for c, _ in cases], s).select(citations.citation_error(F.col("c")).alias("e")).collect()]
    for got, (_, want) in zip(errors, cases):
        assert (got is None) if want is None else want in got
    none = spark.sql("select 'x' as a, cast(array() as array<struct<kind:string,source_id:string,title:string,heading:string,breadcrumb:string,sql:string,snippet:string>>) as c")
    assert "citation" in none.select(citations.answer_error(F.col("a"), F.col("c"))).first()[0]


def test_evaluation(spark):
    items = golden.from_text(spark, "items:\n  - {id: a, question: q, expected_source_id: s1, expected_keywords: [[Tuesday, Thursday], UTC]}\n  - {id: b, question: q, expected_source_id: s2, expected_keywords: []}\n")
    answers = spark.createDataFrame([("a", "every tuesday", ["s1"]), ("b", "x", ["s1"])], "id string, answer string, cited_source_ids array<string>")
    got = {r.id: r for r in evaluation.evaluate(items, answers).collect()}
    assert (got["a"].keyword_hit, got["a"].source_hit, got["a"].status) == (0.5, True, "PASS") and (got["b"].keyword_hit, got["b"].status) == (0.0, "MISS")
    assert evaluation.summary(evaluation.evaluate(items, answers)).first().passed is False

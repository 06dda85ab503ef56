"""Reviewer responses: malformed answers, rounds and fusion."""

from __future__ import annotations

import pytest
from conftest import plan_of, rows
from pyspark.sql import functions as F

from clinframe.operators import consensus
from clinframe.plans.consultation import summarise_consultations

ANSWERS = [
    ('```json\n{"a": 1}\n```', "fenced", '{"a": 1}', "ok"),
    ('x ```json {"a": 1} ``` y ```json {"a": 2} ```', "fenced", '{"a": 1}', "ok"),
    ('```json\n{"a":\n [1,\n2]}\n```', "fenced", '{"a": [1,2]}', "ok"),
    ("```json {broken} ``` {\"a\": 1}", "fenced", "{broken}", "invalid"),
    ('```json {"reason": ["cut', "repaired", '{"reason": ["cut"]}', "ok"),
    ('  ```json {"reason": ["cut\n ', "repaired", '{"reason": ["cut"]}', "ok"),
    ('```json {"a": 1', "repaired", '{"a": 1"]}', "invalid"),
    ('I say {"a": 1} here', "bare", '{"a": 1}', "ok"),
    ('I say {"a": {"b": 1}} here', "bare", '{"a": {"b": 1}', "invalid"),
    ("I say {a: 1} here", "bare", "{a: 1}", "invalid"),
    ("nothing", "none", None, "missing"),
    ("", "none", None, "missing"),
]


def test_extract_json(spark):
    df = spark.createDataFrame([(k, a[0]) for k, a in enumerate(ANSWERS)], "k int, t string")
    got = df.select("k", consensus.extract_json(F.col("t")).alias("x")).orderBy("k").collect()
    for row, (text, stage, body, status) in zip(got, ANSWERS, strict=True):
        assert (row["x"]["stage"], row["x"]["json"], row["x"]["status"]) == (stage, body, status), text


def test_response_variants_hold_answers_of_any_phase(spark):
    texts = [
        '```json {"answer": "agree", "confidence": 3} ```',
        '```json {"logit": "0.25", "evidences": ["a", "b"]} ```',
        '```json {"answer": 1, "answer": 2} ```',
        '```json {"confidence": "high", "logit": 0.5} ```',
        '```json {"reason": ["cut',
        '```json {"answer": "cut',
        "nothing",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    answers = consensus.response_variants(df, "t")
    fields = {"answer_text": ("$.answer", "string"), "confidence": ("$.confidence", "int"), "logit": ("$.logit", "double"), "second": ("$.evidences[1]", "string")}
    got = consensus.response_fields(answers, fields).orderBy("n").select("status", *fields).collect()
    assert [tuple(r) for r in got] == [
        ("ok", "agree", 3, None, None),
        ("ok", None, None, 0.25, "b"),
        ("invalid", None, None, None, None),
        ("ok", None, None, 0.5, None),
        ("ok", None, None, None, None),
        ("invalid", None, None, None, None),
        ("missing", None, None, None, None),
        ("missing", None, None, None, None),
    ]
    quality = consensus.response_quality(answers, ["t"])
    assert quality.agg(F.sum("responses")).first()[0] == len(texts)
    assert consensus.response_variants(df.where("false"), "t").count() == 0


def test_parse_responses(spark):
    raw = ['```json {"answer": "agree", "confidence": 3}```', "none", '{"answer": 5}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(raw)], "k int, t string")
    got = consensus.parse_responses(df, "t", "answer string, confidence int").orderBy("k").collect()
    assert [r["status"] for r in got] == ["ok", "missing", "ok"]
    assert got[0]["answer"]["confidence"] == 3 and got[1]["answer"] is None
    assert got[2]["answer"]["confidence"] is None


def test_action_and_confidence(spark):
    df = spark.createDataFrame([("Yes, no",), ("NO",), ("maybe",), (None,)], "t string")
    assert [r[0] for r in df.select(consensus.parse_action(F.col("t"))).collect()] == [1, 0, None, None]
    df = spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("x",), (None,)], "t string")
    got = [r[0] for r in df.select(consensus.confidence_band(F.col("t"))).collect()]
    assert got == ["low", "moderate", "high", "invalid", "invalid", "low"]


PANEL = "patient_id string, round int, reviewer int, logit string, confidence string, answer string, analysis string, reason string, evidences array<string>"


@pytest.fixture(scope="module")
def panel(spark):
    data = [
        ("p", 1, 2, "0.4", "1", "agree", "A2", "R2", ["e", "f"]),
        ("p", 1, 1, "0.2", "3", "disagree", "A1", "R1", None),
        ("p", 2, 1, "0.6", "3", "agree", "A1b", "R1b", ["g"]),
        ("p", 2, 2, "bad", "1", "agree", "A2b", "R2b", []),
        ("q", 1, 1, "0.5", "0", "agree", "A", "R", None),
    ]
    return spark.createDataFrame(data, PANEL).repartition(4)


def test_statements_are_ordered_and_numbered(panel):
    text = consensus.render_statements(panel, "initial").where("patient_id = 'p' and round = 1").first()["statements"]
    assert text == (
        "Doctor 1's statement is as following:\nDiagnosis: 0.2\nAnalysis: A1\nEvidence: \n"
        "Doctor 2's statement is as following:\nDiagnosis: 0.4\nAnalysis: A2\nEvidence: e\nf\n"
    )
    text = consensus.render_statements(panel, "revision").where("patient_id = 'p' and round = 2").first()["statements"]
    assert text.startswith("Doctor 0's") and text.endswith("Analysis: A2b")
    text = consensus.render_statements(panel, "vote", header="Reviewer %d\n").where("patient_id = 'q'").first()["statements"]
    assert text.startswith("Reviewer 1\nWith invalid confidence: agree")
    with pytest.raises(ValueError):
        consensus.statement("other")


def test_peers_hear_all_others(panel):
    out = consensus.peer_opinions(panel, "reason")
    assert rows(out) == [("p", 2, 1, "R2"), ("p", 2, 2, "R1"), ("p", 3, 1, "R2b"), ("p", 3, 2, "R1b"), ("q", 2, 1, "")]
    assert "Join" not in plan_of(out)


def test_disagreement(spark):
    df = spark.createDataFrame([("a", 0.4), ("a", 0.6), ("b", 0.1), ("b", 0.9), ("c", 0.5), ("c", 0.9)], "id string, p double")
    got = {rule: [r[1] for r in rows(consensus.disagreement(df, "id", rule=rule))] for rule in ("split", "wide", "always", "other")}
    assert got == {"split": [True, True, False], "wide": [False, True, False], "always": [True] * 3, "other": [False] * 3}


def test_rounds(spark):
    data = [
        ("first", 1, 0, "r1"), ("first", 2, 1, "r2"),
        ("never", 1, 1, "r1"), ("never", 2, 1, "r2"), ("never", 3, 1, "r3"),
        ("last", 1, 1, "r1"), ("last", 2, 1, "r2"), ("last", 3, 0, "r3"),
        ("lost", 1, None, "r1"), ("lost", 3, 1, "r3"), ("lost", 4, 0, "r4"),
    ]
    df = spark.createDataFrame(data, "patient_id string, round int, action int, report string")
    assert rows(consensus.rounds_to_consensus(df)) == [
        ("first", 1, True, "r1"), ("last", 3, True, "r3"), ("lost", 3, False, "r3"), ("never", 3, False, "r3"),
    ]


def test_fusion_of_the_last_round(panel):
    mean = {r["patient_id"]: r["logit"] for r in consensus.fuse(panel).collect()}
    assert mean == {"p": 0.6, "q": 0.5}
    weighted = {r["patient_id"]: r["logit"] for r in consensus.fuse(panel, "confidence").collect()}
    assert weighted["p"] == pytest.approx(0.6) and weighted["q"] is None


def test_latest_opinion(panel):
    assert rows(consensus.latest_opinion(panel)) == [("p", 1, 2, "R1bg"), ("p", 2, 2, "R2b"), ("q", 1, 1, "R")]


def test_attach_truth(spark):
    final = spark.createDataFrame([("a", 0.3), ("b", 0.4)], "id string, logit double")
    truth = spark.createDataFrame([("a", 1, 0)], "id string, outcome int, readmission int")
    assert rows(consensus.attach_truth(final, truth, "id", "readmission")) == [("a", 0.3, 0)]


def test_summary_ignores_rounds_after_the_stop(spark):
    data = [("p", 1, 1, "0.2", "1", "yes"), ("p", 2, 1, "0.4", "2", "No"), ("p", 3, 1, "0.9", "3", "no")]
    df = spark.createDataFrame(data, "patient_id string, round int, reviewer int, logit string, confidence string, action string")
    assert tuple(summarise_consultations(df).first()) == ("p", 2, True, 0.4, 0.4)

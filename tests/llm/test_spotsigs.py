"""Signatures, neighbours and near pairs against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from clinframe.llm import spotsigs as S


def chains(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    found = set()
    for i, w in enumerate(words):
        if w in S.ANCHORS:
            content = [x for x in words[i + 1 :] if x not in S.ANCHORS][: S.CHAIN]
            if len(content) == S.CHAIN:
                found.add((w, *content))
    found = found or {tuple(words[i : i + 2]) for i in range(len(words) - 1)}
    return found or {("\n", text or "")}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def corpus():
    rng = random.Random(6)
    pool = ["the", "of", "a", "und", "la", "que", *(f"w{k}" for k in range(60))]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 80)))) for i in range(0, 90, 2)]
    base = " ".join(rng.choice(pool) for _ in range(300))
    docs += [(200 + i, base + f" the end{i} tail of") for i in range(8)]
    docs += [(300, None), (301, ""), (302, "!!"), (303, "single"), (304, "no anchors here, none"), (305, "é" * 9), (4, docs[7][1]), (None, "null id the x y")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("rows_of_range", [3, 2000])
def test_contract(spark, monkeypatch, rows_of_range):
    monkeypatch.setattr(S, "RANGE", rows_of_range)
    docs = corpus()
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_chars int").repartition(4)
    got = sorted((tuple(r) for r in S.fingerprints(df).collect()), key=str)
    order = sorted(((i, t or "") for i, t in docs), key=lambda d: (d[0] is None, -(d[0] or 0), d[1]))
    want = []
    for (i, t), (_, other) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        near = jaccard(chains(t), chains(edited)), jaccard(chains(t), chains(other))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *near))
    assert sorted((g[:3] for g in got), key=str) == sorted((w[:3] for w in want), key=str)
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert (g[5], g[6]) == pytest.approx(w[3:], abs=1e-9)


def test_equal_texts_have_equal_fingerprints(spark):
    df = S.signed(spark.createDataFrame([(t,) for _, t in corpus()], "text string"), "text", "s")
    df = df.withColumn("f", S.fingerprint(F.col("s")))
    counts = df.groupBy(F.coalesce("text", F.lit(""))).agg(F.countDistinct("f").alias("n")).where("n > 1")
    assert counts.count() == 0


def test_near_pairs(spark):
    docs = [(i, t) for i, t in corpus() if i is not None]
    classes = {}
    for i, t in docs:
        key = frozenset(chains(t))
        classes[key] = min(i, classes.get(key, i))
    want = {}
    for a, i in classes.items():
        for b, j in classes.items():
            if i < j and jaccard(a, b) >= 0.8:
                want[(i, j)] = jaccard(a, b)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(sorted((r["a"], r["b"]))): r["likeness"] for r in S.near_pairs(df).collect()}
    assert got == pytest.approx(want) and want
    named = [(r["doc_id"], r["class_id"]) for r in S.near_classes(df).collect()]
    assert len(named) == len(docs) and {c for d, c in named if 200 <= d < 208} == {200}


def test_single_and_empty(spark):
    one = S.fingerprints(spark.createDataFrame([(5, "the cat of house sat")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert S.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []

"""Planted insults are learnt from document labels and located."""

from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from clinframe.llm import toxicity as T


def planted(n=600):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["an", "the", "ion", "er", "st", "lo"]) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        parts = [" ".join(word() for _ in range(8)) for _ in range(rng.randint(2, 12))]
        bad = i % 5 == 1
        if bad:
            at = rng.randrange(len(parts))
            parts[at] += " you zorgle" + word()
        docs.append((i, ". ".join(parts) + "."))
        labels.append((i, int(bad)))
    return docs, labels


def test_learns_and_locates(spark):
    docs, labels = planted()
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, toxicity string")
    y = spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    weights = T.train(d, y, ~T.held_out(F.col("doc_id")))
    assert weights == T.train(d.repartition(3), y.repartition(2), ~T.held_out(F.col("doc_id")))
    rows = T.score(d, weights).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 50
    assert np.mean([(r["toxicity"]["score"] >= 0.5) == (r["doc_id"] % 5 == 1) for r in held]) > 0.97
    for r in held:
        if r["doc_id"] % 5 == 1 and r["toxicity"]["score"] >= 0.5:
            assert "zorgle" in r["text"][r["toxicity"]["worst_start"] : r["toxicity"]["worst_end"]]


def test_odd_texts(spark):
    docs = [(1, None), (2, ""), (None, "a b"), (3, "no marks " * 30000), (4, "...!!"), (4, "...!!")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = T.score(df, T.train(df, none, F.lit(True))).collect()
    assert len(rows) == 6 and all(0 <= r["toxicity"]["score"] <= 1 for r in rows)
    assert rows[0]["toxicity"]["score"] == rows[1]["toxicity"]["score"] == rows[4]["toxicity"]["score"]
    assert T.score(df.limit(0), T.train(df.limit(0), none, F.lit(True))).collect() == []


def test_held_out(spark):
    df = spark.createDataFrame([(i,) for i in [0, 7, 123, None]], "doc_id long")
    got = [r[0] for r in df.select(T.held_out(F.col("doc_id"))).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 5 == 0 for i in (0, 7, 123)] + [False]


def test_noisy_or_gradient():
    """One step of a document's likelihood: the share of a sentence grows with its probability."""
    weights = T.fit(["bad word. plain text here"] * 6 + ["plain text here. more plain text"] * 30, np.array([1] * 6 + [0] * 30))
    scorer = T.Scorer(weights.tobytes())
    assert scorer.document("a bad word")[0] > 0.5 > scorer.document("plain text")[0]

"""Lloyd's rounds against a plain version: ties, empty clusters, rest."""

from __future__ import annotations

import numpy as np

from clinframe.operators.similarity import lloyd_clusters

ROWS, CENTERS = "record_id long, vector array<double>", "center int, vector array<double>"


def plainly(x, centers, rounds):
    for n in range(rounds + 1):
        squared = np.round(((x[:, None] - centers[None]) ** 2).sum(-1), 10)
        codes = squared.argmin(1)
        if n == rounds or (n and (codes == before).all()):
            return codes, centers, n
        before = codes
        centers = np.array([x[codes == k].mean(0) if (codes == k).any() else centers[k] for k in range(len(centers))])


def test_equals_plain_version(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 3))
    x[:4] = 7.0
    start = np.concatenate([x[10:14], [[99.0, 99.0, 99.0]]])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], ROWS)
    given = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(start)], CENTERS)
    for rounds in (1, 40):
        facts = {}
        placed, centers = lloyd_clusters(df, given, iterations=rounds, report=facts)
        codes, want, used = plainly(x, start, rounds)
        got = {r["record_id"]: r["cluster"] for r in placed.collect()}
        assert [got[k] for k in range(150)] == codes.tolist()
        assert np.allclose([r["vector"] for r in centers.orderBy("center").collect()], want)
        assert facts["rounds"] == used and (rounds == 1 or facts["changed"] == 0)


def test_ties_and_empty_tables(spark):
    given = spark.createDataFrame([(0, [0.0]), (1, [2.0])], CENTERS)
    placed, _ = lloyd_clusters(spark.createDataFrame([(1, [1.0])], ROWS), given, iterations=0)
    assert [tuple(r) for r in placed.collect()] == [(1, 0, 1.0)]
    placed, centers = lloyd_clusters(spark.createDataFrame([], ROWS), given)
    assert placed.collect() == [] and centers.count() == 2

"""Targets are met, no document has too many copies, and reruns agree."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from clinframe.llm import mixing


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 250 * 1 / 3, 250 * 2 / 3])
    assert mixing.targets([0, 10]) == [0, 15.0]
    assert mixing.targets([]) == []
    assert sum(mixing.targets([5, 1000, 7, 300, 90])) == pytest.approx(1.5 * 1402)


@pytest.mark.parametrize("bucket", [8, 4096])
def test_words_stay_on_target(spark, bucket):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "ç", "c", None]), rng.randint(0, 60) if i % 40 else 900, "t") for i in range(3000)]
    rows += [(None, "b", 5, "t"), (7, "b", 5, "t"), (7, "b", 5, "t"), (8, "empty", 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, target0 string")
    found = mixing.mix(df, bucket=bucket).collect()
    again = mixing.mix(df.repartition(5), bucket=bucket).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, again), key=str)
    assert sorted((r["doc_id"], r["source"], r["size"]) for r in found if r["doc_id"] is not None and r["source"]) == sorted(r[:3] for r in rows if r[0] is not None and r[1])
    assert all(0 <= r["copies"] <= 2 for r in found) and len(found) == len(rows)
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r[2] for r in rows if r[1] == n) for n in names]
    for name, size, target in zip(names, sizes, mixing.targets(sizes), strict=True):
        own = [r for r in found if r["source"] == name]
        assert all(r["source_size"] == size and r["target"] == target for r in own)
        assert abs(sum(r["copies"] * r["size"] for r in own) - target) <= max(r["size"] for r in own) / 2 + 1e-6


def test_expectation(spark):
    """Over many ids a document gets its share of copies on average."""
    rows = [(i, s, 10) for s in ("a", "b") for i in range(2000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"))
    shares = {r["source"]: r["m"] for r in found.groupBy("source").agg(F.avg("copies").alias("m")).collect()}
    assert shares == pytest.approx({"a": 2.0, "b": 1.0}, abs=0.01)


def test_words_and_empty_tables(spark):
    df = spark.createDataFrame([("a  b\tc d",), (None,), ("",), (" ",)], "text string")
    assert [r[0] for r in df.select(mixing.words(F.col("text"))).collect()] == [3, 0, 0, 0]
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, size long")).collect() == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(k, "a", 5, "t", "c", "s", "b") for k in range(30)], "doc_id long, source string, size long, target string, copies string, source_size string, _bucket string")
    rows = mixing.mix(df).collect()
    assert len(rows) == 30 and all(r["_bucket"] == "b" and r["source_size"] == 150 and r["target"] == 225 for r in rows)


def test_no_workers_for_the_table_of_sources(spark, monkeypatch):
    """Rows that the driver sends as a list go through Python workers, which stay beside the others."""
    docs = spark.range(40).selectExpr("id as doc_id", "if(id % 4 = 0, null, concat('s', id % 4)) as source", "id + 1 as size")

    def fails(*_, **__):
        raise AssertionError("a list of rows was sent")

    monkeypatch.setattr(spark.sparkContext, "parallelize", fails)
    got = mixing.mix(docs)
    assert got.count() == 40 and got.select("source").distinct().count() == 4

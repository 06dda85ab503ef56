"""Every stage does what its operator says, on the smallest tables and on a literal one."""

from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_copies import groups


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf)
        rows = [r.asDict() for r in after.collect()]
        out.append((docs, after.columns, rows))
        docs = spark.createDataFrame([tuple(r.values()) for r in rows], after.schema)
    return out


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "bpe"]
    for docs, columns, _ in steps[:-1]:
        assert columns == docs.columns


def test_filters_keep_rows_as_they_are(steps):
    for docs, _, rows in steps[:2]:
        before = {r["doc_id"]: r.asDict() for r in docs.collect()}
        assert 0.5 * len(before) < len(rows) <= len(before)
        assert all(before[r["doc_id"]] == r for r in rows)


def test_one_of_each_group_stays(steps):
    """Groups by brute force over whole five-word sets, at a similarity of 0.8."""
    docs, _, rows = steps[1]
    given = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    named = groups([text for _, text in given])
    assert sorted(r["doc_id"] for r in rows) == sorted(given[k][0] for k in set(named))


def test_personal_data_are_gone(steps):
    docs, _, rows = steps[2]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    changed = [r for r in rows if r["text"] != before[r["doc_id"]]]
    assert changed and len(rows) == len(before)
    assert all(r["n_chars"] == len(r["text"]) for r in changed)


def test_mix_and_tokens(steps):
    docs, _, rows = steps[3]
    times = Counter(r["doc_id"] for r in rows)
    assert max(times.values()) == 2 and set(times) <= {r["doc_id"] for r in docs.collect()}
    words = sum(len(r["text"].split()) for r in rows)
    assert words == pytest.approx(1.5 * sum(len(r["text"].split()) for r in docs.collect()), rel=0.05)
    texts = {r["doc_id"]: r["text"] for r in rows}
    last = steps[4][2]
    assert Counter(r["doc_id"] for r in last) == times
    for r in last:
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert r["n_tokens"] == len(np.frombuffer(r["ids"], "<u4"))


def test_odd_rows_pass(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema.add("extra", "integer")
    rows = [(1, None, "en", "s", None, 1), (2, "", None, None, 0, 2), (None, "some words", "en", "s", 10, 3), (4, "x " * 300, "en", "s", 600, 4)]
    docs = spark.createDataFrame(rows, schema)
    # Null and empty texts have one fingerprint, so one of the two stays.
    for table in (docs, docs.limit(0)):
        kept = table
        for _, stage in corpus_pipeline.STAGES[:3]:
            kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns and kept.count() == (3 if table is docs else 0)
        last = corpus_pipeline.encode(spark, corpus_pipeline.mix_sources(spark, kept, sf), sf)
        assert last.where(F.col("n_tokens").isNull()).count() == 0


def test_clashing_columns_stay(spark, sf):
    names = ["size", "target", "copies", "source_size", "n_entities", "toxicity", "_row", "_id", "_found", "rest of the row", "a.b"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        rows = after.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    assert corpus_pipeline.encode(spark, docs, sf).count() == docs.count()


def test_batches_of_long_texts_are_small(spark, sf):
    """What a task holds outside the heap follows the batches that Python gets."""
    corpus_pipeline.drop_near_copies(spark, spark.read.parquet(f"{sf}/documents.parquet").limit(0), sf)

    @F.arrow_udf("long")
    def batch(column: pa.Array) -> pa.Array:
        return pa.array([sum(len(v.as_py()) for v in column)] * len(column), pa.int64())

    docs = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("word "), 8000).alias("text"))
    most = docs.select(batch("text").alias("n")).agg(F.max("n")).first()[0]
    assert 40_000 <= most <= 1_100_000

"""Nearest vectors against brute force, in every way the work may be laid out."""

from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import plan_of, rows
from pyspark.sql import functions as F

from clinframe.operators import retrieval, similarity
from clinframe.queries import retrieval as registered

RNG = np.random.default_rng(3)
CORPUS = RNG.normal(size=(60, 5))
CORPUS[10] = CORPUS[20] = CORPUS[30]  # equal vectors tie
CORPUS[40] = 0.0
QUERIES = np.vstack([RNG.normal(size=(6, 5)), CORPUS[30:31]])


@pytest.fixture(scope="module")
def frames(spark):
    corpus = spark.createDataFrame(
        [(f"d{k:02d}", "odd" if k % 2 else "even", v.tolist()) for k, v in enumerate(CORPUS)],
        "doc_id string, corpus string, vector array<double>",
    ).repartition(4)
    queries = spark.createDataFrame(
        [(k, v.tolist()) for k, v in enumerate(QUERIES)], "query_id int, vector array<double>"
    )
    return queries.cache(), corpus.cache()


def nearest(query, k, metric="ip", docs=range(60)):
    def score(d):
        return float(query @ CORPUS[d]) if metric == "ip" else -float(((query - CORPUS[d]) ** 2).sum())

    return sorted(docs, key=lambda d: (-round(score(d), 10), d))[:k]


#: Everything broadcast, and blocks of a few rows on both sides.
LAYOUTS = [{}, {"query_bytes": 0, "block_bytes": 8 * 5 * 9}]


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("k", [1, 4, 100])
def test_topk_by_brute_force(frames, layout, metric, k):
    queries, corpus = frames
    hits = retrieval.topk_inner_product(queries, corpus, k, metric=metric, **layout)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(int(r["doc_id"][1:]))
    assert got == {q: nearest(v, k, metric) for q, v in enumerate(QUERIES)}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_per_corpus_and_merged(frames, layout):
    queries, corpus = frames
    hits = retrieval.multi_corpus_topk(queries, corpus, 3, **layout).orderBy("query_id", "position").collect()
    for q, v in enumerate(QUERIES):
        mine = [int(r["doc_id"][1:]) for r in hits if r["query_id"] == q]
        assert mine == nearest(v, 3, docs=range(0, 60, 2)) + nearest(v, 3, docs=range(1, 60, 2))
    merged = retrieval.multi_corpus_topk(queries, corpus, 3, merge=True, **layout)
    scores = merged.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst")).collect()
    for r in scores:
        v = QUERIES[r["query_id"]]
        assert r["n"] == 3 and r["worst"] == pytest.approx(float(v @ CORPUS[nearest(v, 3)[-1]]))


def test_small_score_blocks_change_nothing(frames, monkeypatch):
    queries, corpus = frames
    want = rows(retrieval.topk_inner_product(queries, corpus, 4))
    monkeypatch.setattr(retrieval, "SCORE_BYTES", 8 * 7 * 3)
    assert rows(retrieval.topk_inner_product(queries, corpus, 4)) == want


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("few", [0, 10**6])
def test_either_side_may_be_sent(frames, monkeypatch, metric, few):
    queries, corpus = frames
    monkeypatch.setattr(retrieval, "FEW_QUERIES", few)
    monkeypatch.setattr(retrieval, "TILE_QUERIES", 3)
    got = {}
    for r in retrieval.topk_inner_product(queries, corpus, 4, metric=metric).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(int(r["doc_id"][1:]))
    assert got == {q: nearest(v, 4, metric) for q, v in enumerate(QUERIES)}


@pytest.mark.parametrize("few", [0, 10**6])
def test_vectors_of_one_file_are_work_for_all_tasks(frames, monkeypatch, few):
    queries, corpus = frames
    monkeypatch.setattr(retrieval, "FEW_QUERIES", few)
    plan = plan_of(retrieval.topk_inner_product(queries.coalesce(1), corpus.coalesce(1), 3))
    assert "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("few", [0, 10**6])
def test_a_vector_that_is_no_number_hides_no_other(frames, monkeypatch, spark, few):
    queries, corpus = frames
    monkeypatch.setattr(retrieval, "FEW_QUERIES", few)
    odd = spark.createDataFrame([("d99", "odd", [math.nan] * 5)], corpus.schema)
    hits = retrieval.topk_inner_product(queries, corpus.unionByName(odd).coalesce(1), 4)
    assert rows(hits) == rows(retrieval.topk_inner_product(queries, corpus, 4))


def test_passages_search_once(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(retrieval, "fetch_passages", lambda hits, *rest: seen.append(plan_of(hits)) or hits)
    registered.passages(spark, sf)
    assert not any("MapInArrow" in plan for plan in seen)


def test_nothing_to_search(frames):
    queries, corpus = frames
    assert retrieval.topk_inner_product(queries.limit(0), corpus, 3).count() == 0
    assert retrieval.topk_inner_product(queries, corpus.where("doc_id = 'x'"), 3).count() == 0


def test_no_pairs_in_the_plan(frames):
    queries, corpus = frames
    plan = plan_of(retrieval.topk_inner_product(queries, corpus, 3))
    assert "Join" not in plan and "Cartesian" not in plan and "MapInArrow" in plan
    assert "WindowGroupLimit" in plan


def test_passages_and_context(frames, spark):
    queries, corpus = frames
    docs = corpus.select("doc_id", F.upper("doc_id").alias("title"), F.lit("text").alias("content"))
    hits = retrieval.multi_corpus_topk(queries, corpus, 2)
    text = retrieval.render_context(retrieval.fetch_passages(hits, docs)).where("query_id = 6").first()["context"]
    assert text.split("\n")[0] == "Document [1] (Title: D10) text"
    assert len(text.split("\n")) == 4


@pytest.mark.parametrize("layout", LAYOUTS)
def test_patient_similarity(frames, layout):
    _, corpus = frames
    patients = corpus.withColumnRenamed("doc_id", "record_id")
    n = len(CORPUS)
    squared = ((CORPUS[:, None, :] - CORPUS[None, :, :]) ** 2).sum(axis=2)
    width = squared.sum() / (n * n - n)
    assert similarity.kernel_bandwidth(patients).first()["bandwidth"] == pytest.approx(width)
    for r in similarity.patient_similarity(patients, 3, **layout).collect():
        a, b = int(r["record_id"][1:]), int(r["neighbour"][1:])
        assert a != b and r["distance"] == pytest.approx(squared[a, b], abs=1e-9)
        assert r["kernel"] == pytest.approx(math.exp(-squared[a, b] / width))
        assert r["rank"] > 3 - 1 or b == nearest(CORPUS[a], 3, "l2", [d for d in range(n) if d != a])[r["rank"] - 1]


def test_narrow_bandwidth_becomes_one(spark):
    same = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0])], "record_id string, vector array<double>")
    assert similarity.kernel_bandwidth(same).first()["bandwidth"] == 1.0
    assert similarity.kernel_bandwidth(same.limit(1)).first()["bandwidth"] == 1.0


def test_assign_centers_takes_the_lowest_on_ties(spark):
    v = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [3.0, 0.0])], "record_id string, vector array<double>")
    c = spark.createDataFrame([(2, [1.0, 0.0]), (1, [-1.0, 0.0]), (0, [9.0, 9.0])], "center int, vector array<double>")
    assert rows(similarity.assign_centers(v, c)) == [("a", 1, 1.0), ("b", 2, 4.0)]


def test_clusters_find_separate_groups(spark):
    data = [(f"r{k}", [float(10 * (k % 2)) + 0.01 * k, float(k % 2)]) for k in range(40)]
    df = spark.createDataFrame(data, "record_id string, vector array<double>")
    got = {r["record_id"]: r["cluster"] for r in similarity.patient_clusters(df, 2).collect()}
    assert len({got[f"r{k}"] for k in range(0, 40, 2)}) == 1
    assert len(set(got.values())) == 2


def test_hashed_tfidf_makes_no_row_for_a_word(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "a \u00c4 \u00e4"), (3, None)], "doc_id int, text string").coalesce(1)
    weights = similarity.term_weights(df, "doc_id", F.col("text"), 16)
    vectors = similarity.hashed_tfidf(df, "doc_id", F.col("text"), weights, 16, keep=["text"])
    plan = plan_of(vectors)
    assert vectors.columns == ["doc_id", "text", "vector"] and vectors.count() == 3
    assert "Generate" not in plan and "Join" not in plan and "REPARTITION_BY_NUM" in plan


def test_hashed_tfidf_by_definition(spark):
    docs = [("a", "Fever cough", "fever"), ("b", "cough", "pain"), ("c", "Ödem", "pain pain")]
    df = spark.createDataFrame(docs, "doc_id string, title string, content string")
    text = F.concat_ws(" ", "title", "content")
    idf = similarity.term_weights(df, "doc_id", text, 4096)
    got = {r["doc_id"]: r["vector"] for r in similarity.hashed_tfidf(df, "doc_id", text, idf, 4096).collect()}
    none = similarity.hashed_tfidf(df.select("doc_id"), "doc_id", F.lit("unseen"), idf, 4096)
    assert all(sum(r["vector"]) == 0 for r in none.collect())
    words = {"a": ["fever", "cough", "fever"], "b": ["cough", "pain"], "c": ["ödem", "pain", "pain"]}

    def weights(doc):
        out = {}
        for w in words[doc]:
            df_count = sum(w in ws for ws in words.values())
            out[w] = words[doc].count(w) * math.log((3 + 1) / (df_count + 1))
        norm = math.sqrt(sum(v * v for v in out.values()))
        return {w: v / norm for w, v in out.items()}

    for d in "abc":
        assert sum(v * v for v in got[d]) == pytest.approx(1.0)
        assert sorted(v for v in got[d] if v) == pytest.approx(sorted(weights(d).values()))
    cosine = sum(weights("b").get(w, 0) * v for w, v in weights("c").items())
    assert sum(a * b for a, b in zip(got["b"], got["c"], strict=True)) == pytest.approx(cosine)


@pytest.mark.parametrize("query_bytes", [10**9, 1])
def test_layouts_agree_on_missing_ids_groups_and_vectors(spark, query_bytes):
    schema = "doc_id int, grp string, vector array<double>"
    data = [(1, "a", [1.0, 0.0]), (2, None, [0.5, 0.5]), (3, None, [0.0, 1.0]), (4, "a", None), (5, "b", [1.0, None]), (6, "b", [1.0])]
    corpus = spark.createDataFrame(data, schema)
    asked = spark.createDataFrame([(7, [1.0, 2.0]), (8, None), (9, [None, 1.0])], "query_id int, vector array<double>")
    out = retrieval.topk_inner_product(asked, corpus, 2, within="grp", query_bytes=query_bytes)
    assert rows(out) == [(7, None, 2, 1.5, 2), (7, None, 3, 2.0, 1), (7, "a", 1, 1.0, 1)]
    only = corpus.where("grp is null")
    assert retrieval.topk_inner_product(asked, only, 2, within="grp", query_bytes=query_bytes).count() == 2
    none = corpus.where("doc_id = 4")
    assert retrieval.topk_inner_product(asked, none, 2, within="grp", query_bytes=query_bytes).count() == 0


def test_more_centers_than_may_be_sent(spark):
    v = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [3.0, 0.0])], "record_id string, vector array<double>")
    c = spark.createDataFrame([(2, [1.0, 0.0]), (1, [-1.0, 0.0]), (0, [9.0, 9.0])], "center int, vector array<double>")
    assert rows(similarity.assign_centers(v, c, most=2)) == [("a", 1, 1.0), ("b", 2, 4.0)]

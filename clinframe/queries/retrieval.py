"""Queries on vectors: nearest passages, similar patients, clusters."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.operators import postings, radius, retrieval, similarity
from clinframe.queries import inputs as i
from clinframe.queries.cohort import rounded
from clinframe.queries.registry import query
from clinframe.session import stored

K = 3

#: All pairs of different vectors with their rounded inner product.
PAIRS_SQL = (
    "vecs AS (SELECT vec_id, label % 2 AS corpus, embedding::DOUBLE[] AS v FROM embeddings), "
    "pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, c.corpus, "
    "round(list_dot_product(q.v, c.v), 10) AS score FROM vecs q JOIN vecs c ON q.vec_id <> c.vec_id)"
)


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return i.vectors(spark, sf).select(F.col("record_id").alias("query_id"), "vector")


def corpus_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return i.vectors(spark, sf).select(
        F.col("record_id").alias("doc_id"), (F.col("label") % 2).alias("corpus"), "vector"
    )


@query(
    "topk_inner_product",
    f"WITH {PAIRS_SQL} SELECT query_id, doc_id, round(score, 6) AS score, "
    "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pairs "
    f"QUALIFY rank <= {K}",
)
def topk_inner_product(spark: SparkSession, sf: str) -> DataFrame:
    hits = retrieval.topk_inner_product(
        query_vectors(spark, sf), corpus_vectors(spark, sf), K, skip_same=True
    )
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


PER_CORPUS_SQL = (
    PAIRS_SQL + ", hits AS (SELECT *, row_number() OVER (PARTITION BY query_id, corpus ORDER BY score DESC, "
    f"doc_id) AS rank FROM pairs QUALIFY rank <= {K}), numbered AS (SELECT *, row_number() OVER "
    "(PARTITION BY query_id ORDER BY corpus, rank) AS position FROM hits)"
)


@query(
    "multi_corpus_topk",
    f"WITH {PER_CORPUS_SQL} SELECT query_id, corpus, doc_id, round(score, 6) AS score, position FROM numbered",
)
def multi_corpus_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = retrieval.multi_corpus_topk(
        query_vectors(spark, sf), corpus_vectors(spark, sf), K, skip_same=True
    )
    return hits.select("query_id", "corpus", "doc_id", F.round("score", 6).alias("score"), "position")


@query(
    "multi_corpus_merged",
    f"WITH {PER_CORPUS_SQL} SELECT query_id, corpus, doc_id, round(score, 6) AS score, row_number() OVER "
    "(PARTITION BY query_id ORDER BY score DESC, corpus, doc_id) AS position FROM numbered "
    f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY numbered.score DESC, corpus, doc_id) <= {K}",
)
def multi_corpus_merged(spark: SparkSession, sf: str) -> DataFrame:
    hits = retrieval.multi_corpus_topk(
        query_vectors(spark, sf), corpus_vectors(spark, sf), K, merge=True, skip_same=True
    )
    return hits.select("query_id", "corpus", "doc_id", F.round("score", 6).alias("score"), "position")


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """Hits, searched once, with the passages behind them: vectors and documents share their ids."""
    hits = stored(
        retrieval.multi_corpus_topk(
            query_vectors(spark, sf), corpus_vectors(spark, sf), K, skip_same=True
        )
    )
    docs = i.corpus_docs(spark, sf).select("doc_id", "title", "content")
    vecs = i.vectors(spark, sf).select(F.col("record_id").alias("doc_id"), "vector")
    return retrieval.fetch_passages(retrieval.fetch_passages(hits, docs), vecs)


DOCS_SQL = "docs AS (SELECT doc_id, substr(text, 1, 40) AS title, text AS content FROM documents)"


@query(
    "fetch_passages",
    f"WITH {PER_CORPUS_SQL}, {DOCS_SQL} SELECT query_id, n.doc_id, position, title, length(content) AS characters, "
    "round(v[1], 6) AS first_element FROM numbered n JOIN docs d ON n.doc_id = d.doc_id "
    "JOIN vecs e ON n.doc_id = e.vec_id",
)
def fetch_passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages(spark, sf).select(
        "query_id",
        "doc_id",
        "position",
        "title",
        F.length("content").cast("bigint").alias("characters"),
        F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first_element"),
    )


@query(
    "render_context",
    f"WITH {PER_CORPUS_SQL}, {DOCS_SQL} SELECT query_id, md5(string_agg('Document [' || position || '] (Title: ' "
    "|| title || ') ' || content, chr(10) ORDER BY position)) AS digest FROM numbered n JOIN docs d "
    "ON n.doc_id = d.doc_id GROUP BY 1",
)
def render_context(spark: SparkSession, sf: str) -> DataFrame:
    out = retrieval.render_context(passages(spark, sf))
    return out.select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"))


#: Buckets of the hashed texts in these queries.
TEXT_DIM = 256


def cells_sql(name: str, source: str, key: str, text: str) -> str:
    return (
        f"{name} AS (SELECT {key}, bucket, count(*) AS n FROM (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % "
        f"{TEXT_DIM} AS bucket FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[^\\x20\\x09-\\x0D]+')) AS w "
        f"FROM {source})) GROUP BY ALL)"
    )


IDF_SQL = (
    cells_sql("c_cells", "documents", "doc_id", "substr(text, 1, 40) || ' ' || text")
    + ", idf AS (SELECT bucket, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM c_cells GROUP BY 1), "
    "c_raw AS (SELECT doc_id, bucket, n * idf AS v FROM c_cells JOIN idf USING (bucket)), c_vec AS (SELECT doc_id, bucket, "
    "v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS v FROM c_raw)"
)


def text_vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of all documents, and the weights of the buckets."""
    docs = i.corpus_docs(spark, sf)
    text = F.concat_ws(" ", "title", "content")
    weights = similarity.term_weights(docs, "doc_id", text, TEXT_DIM)
    return similarity.hashed_tfidf(docs, "doc_id", text, weights, TEXT_DIM, keep=["corpus"]), weights


@query(
    "hashed_tfidf",
    f"WITH {IDF_SQL} SELECT d.doc_id, round(coalesce(sum(v * v), 0), 6) AS squared_norm, round(coalesce(sum(v * "
    "(bucket + 1)), 0), 6) AS weighted FROM documents d LEFT JOIN c_vec c ON d.doc_id = c.doc_id GROUP BY 1",
)
def hashed_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    vectors, _ = text_vectors(spark, sf)
    add = lambda a, v: a + v
    weighted = F.aggregate(F.transform("vector", lambda v, k: v * (k + 1)), F.lit(0.0), add)
    norm = F.aggregate(F.transform("vector", lambda v: v * v), F.lit(0.0), add)
    return vectors.select("doc_id", F.round(norm, 6).alias("squared_norm"), F.round(weighted, 6).alias("weighted"))


TEXT_HITS_SQL = (
    f"{IDF_SQL}, "
    + cells_sql("q_cells", "benchmark", "item_id", "text")
    + ", q_raw AS (SELECT item_id, bucket, n * idf AS v FROM q_cells JOIN idf USING (bucket)), q_vec AS (SELECT item_id, "
    "bucket, v / sqrt(sum(v * v) OVER (PARTITION BY item_id)) AS v FROM q_raw), every AS (SELECT item_id, doc_id, lang "
    "FROM benchmark, documents), scores AS (SELECT item_id, doc_id, sum(q.v * c.v) AS s FROM q_vec q JOIN c_vec c "
    "USING (bucket) GROUP BY ALL), hits AS (SELECT e.item_id AS query_id, e.lang AS corpus, e.doc_id, "
    "round(coalesce(s, 0), 8) AS score, row_number() OVER (PARTITION BY e.item_id, e.lang ORDER BY "
    "round(coalesce(s, 0), 8) DESC, e.doc_id) AS rank FROM every e LEFT JOIN scores s ON e.item_id = s.item_id AND "
    "e.doc_id = s.doc_id QUALIFY rank <= 3), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY "
    "corpus, rank) AS position FROM hits)"
)


def text_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts against all documents of each language: text to vector to hits, stored once."""
    vectors, weights = text_vectors(spark, sf)
    questions = i.table(spark, sf, "benchmark")
    asked = similarity.hashed_tfidf(questions, "item_id", F.col("text"), weights, TEXT_DIM)
    asked = asked.withColumnRenamed("item_id", "query_id")
    return stored(retrieval.multi_corpus_topk(asked, vectors, 3, decimals=8))


@query(
    "text_retrieval",
    f"WITH {TEXT_HITS_SQL} SELECT query_id, corpus, doc_id, rank, position, round(score, 6) AS score FROM placed",
)
def text_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    hits = text_hits(spark, sf)
    return hits.select("query_id", "corpus", "doc_id", "rank", "position", F.round("score", 6).alias("score"))


@query(
    "text_retrieval_context",
    f"WITH {TEXT_HITS_SQL} SELECT query_id, md5(string_agg('Document [' || position || '] (Title: ' || substr(text, 1, 40) "
    "|| ') ' || text, chr(10) ORDER BY position)) AS digest FROM placed JOIN documents USING (doc_id) GROUP BY 1",
)
def text_retrieval_context(spark: SparkSession, sf: str) -> DataFrame:
    docs = i.corpus_docs(spark, sf).select("doc_id", "title", "content")
    passages = retrieval.fetch_passages(text_hits(spark, sf), docs)
    out = retrieval.render_context(passages)
    return out.select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"))


def term_cells_sql(name: str, source: str, key: str) -> str:
    return (
        f"{name} AS (SELECT {key}, term, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), "
        f"'[^\\x20\\x09-\\x0D]+')) AS term FROM {source}) GROUP BY ALL)"
    )


@query(
    "term_retrieval",
    "WITH "
    + term_cells_sql("c_cells", "documents", "doc_id")
    + ", idf AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM c_cells GROUP BY 1), "
    "c_vec AS (SELECT doc_id, term, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY doc_id)) AS v FROM c_cells JOIN idf "
    "USING (term) WHERE idf > 0), "
    + term_cells_sql("q_cells", "benchmark", "item_id")
    + ", q_vec AS (SELECT item_id, term, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY item_id)) AS v FROM q_cells JOIN "
    "idf USING (term) WHERE idf > 0), scores AS (SELECT item_id AS query_id, doc_id, round(sum(q.v * c.v), 8) AS s FROM q_vec q JOIN "
    "c_vec c USING (term) GROUP BY ALL) SELECT query_id, doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY "
    "s DESC, doc_id) AS rank FROM scores QUALIFY rank <= 5",
)
def term_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts against all documents, over the words themselves."""
    docs = i.table(spark, sf, "documents").select("doc_id", "text")
    questions = i.table(spark, sf, "benchmark")
    index = postings.build_postings(docs, "doc_id", F.col("text"), asked=questions)
    hits = postings.search_postings(index, questions, 5, "item_id")
    return hits.select(F.col("item_id").alias("query_id"), "doc_id", F.round("score", 6).alias("score"), "rank")


# --- patients ----------------------------------------------------------------------------------------------

DISTANCE_SQL = (
    "vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), norms AS (SELECT vec_id, label, v, "
    "list_dot_product(v, v) AS n2 FROM vecs), pairs AS (SELECT a.vec_id AS record_id, b.vec_id AS neighbour, "
    "round(greatest(0, a.n2 + b.n2 - 2 * list_dot_product(a.v, b.v)), 10) AS d FROM norms a JOIN norms b ON a.vec_id <> b.vec_id)"
)


@query(
    "patient_similarity",
    f"WITH {DISTANCE_SQL}, width AS (SELECT sum(d) / (SELECT count(*) * count(*) - count(*) FROM vecs) AS w FROM pairs) "
    "SELECT record_id, neighbour, row_number() OVER (PARTITION BY record_id ORDER BY d, neighbour) AS rank, "
    "round(d, 6) AS distance, round(exp(-d / CASE WHEN w < 1e-3 THEN 1 ELSE w END), 6) AS kernel "
    "FROM pairs, width QUALIFY rank <= 5",
)
def patient_similarity(spark: SparkSession, sf: str) -> DataFrame:
    out = similarity.patient_similarity(i.vectors(spark, sf), 5)
    return out.select("record_id", "neighbour", "rank", *rounded(["distance", "kernel"]))


#: A radius that holds few of the other test vectors.
NEAR = 1.2


@query(
    "patient_radius",
    f"WITH {DISTANCE_SQL} SELECT vec_id AS record_id, count(neighbour) AS neighbours, min(neighbour) AS smallest FROM vecs "
    f"LEFT JOIN pairs ON vec_id = record_id AND d <= {round(NEAR * NEAR, 10)!r} GROUP BY 1",
)
def patient_radius(spark: SparkSession, sf: str) -> DataFrame:
    return radius.patient_radius(i.vectors(spark, sf), NEAR)


@query(
    "kernel_bandwidth",
    f"WITH {DISTANCE_SQL} SELECT (SELECT count(*) FROM vecs) AS n, round(sum(d) / (SELECT count(*) * count(*) - count(*) "
    "FROM vecs), 6) AS bandwidth FROM pairs",
)
def kernel_bandwidth(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.kernel_bandwidth(i.vectors(spark, sf)).select("n", *rounded(["bandwidth"]))


@query(
    "patient_clusters",
    "SELECT (SELECT count(*) FROM embeddings) AS placed, 8::BIGINT AS clusters, 0::BIGINT AS not_nearest, "
    "0.0::DOUBLE AS off_mean",
)
def patient_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """What holds for any fixed point of k-means: every row belongs to the nearest mean, and every
    center is the mean of its rows."""
    vecs = i.vectors(spark, sf)
    model = similarity.fit_clusters(vecs, 8)
    placed = stored(model.transform(vecs.withColumn("_v", array_to_vector("vector"))).select("record_id", "vector", "prediction"))
    rows = [(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())]
    centers = spark.createDataFrame(rows, "center int, vector array<double>")
    means = similarity.mean_vectors(placed, "prediction").withColumnRenamed("prediction", "center")
    nearest = similarity.assign_centers(placed, means).join(placed.select("record_id", "prediction"), "record_id")
    gap = F.aggregate(F.zip_with("vector", "mean", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x)
    off = centers.join(means.withColumnRenamed("vector", "mean"), "center").agg(F.round(F.max(gap), 6).alias("off_mean"))
    counts = nearest.agg(
        F.count(F.lit(1)).alias("placed"),
        F.count_distinct("prediction").alias("clusters"),
        F.count_if(F.col("center") != F.col("prediction")).alias("not_nearest"),
    )
    return counts.withColumn("off_mean", off.scalar())


#: Clusters and rounds of the row by row comparison.
LLOYD_K, LLOYD_ROUNDS = 6, 4


def _lloyd_sql() -> str:
    """The rounds one after the other: places from centers, means from places."""
    out = [
        "cells AS (SELECT vec_id, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)",
        f"c0 AS (SELECT vec_id::INTEGER AS center, k, x AS m FROM cells WHERE vec_id < {LLOYD_K})",
    ]
    for n in range(LLOYD_ROUNDS + 1):
        out.append(
            f"p{n} AS (SELECT vec_id, center, d FROM (SELECT vec_id, center, round(sum((x - m) * (x - m)), 10) AS d FROM cells "
            f"JOIN c{n} USING (k) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, center) = 1)"
        )
        out.append(
            f"c{n + 1} AS (SELECT c.center, c.k, coalesce(avg(x), min(c.m)) AS m FROM c{n} c LEFT JOIN (SELECT center, k, x FROM p{n} "
            "JOIN cells USING (vec_id)) v ON v.center = c.center AND v.k = c.k GROUP BY ALL)"
        )
    return f"WITH {', '.join(out)} SELECT vec_id AS record_id, center AS cluster, round(d, 6) AS distance FROM p{LLOYD_ROUNDS}"


@query("lloyd_clusters", _lloyd_sql())
def lloyd_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Four rounds from the first vectors as centers, row by row."""
    vecs = i.vectors(spark, sf)
    first = vecs.where(F.col("record_id") < LLOYD_K).select(F.col("record_id").alias("center"), "vector")
    placed, _ = similarity.lloyd_clusters(vecs, first, iterations=LLOYD_ROUNDS)
    return placed.select("record_id", "cluster", *rounded(["distance"]))


@query(
    "assign_centers",
    "WITH cells AS (SELECT label, vec_id, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x "
    "FROM embeddings), centers AS (SELECT label AS center, k, avg(x) AS m FROM cells GROUP BY ALL), "
    "dist AS (SELECT vec_id AS record_id, center, round(sum((x - m) * (x - m)), 10) AS d FROM cells JOIN centers USING (k) "
    "GROUP BY ALL) SELECT record_id, center, round(d, 6) AS distance FROM dist QUALIFY row_number() OVER "
    "(PARTITION BY record_id ORDER BY d, center) = 1",
)
def assign_centers(spark: SparkSession, sf: str) -> DataFrame:
    vecs = i.vectors(spark, sf)
    centers = similarity.mean_vectors(vecs.withColumnRenamed("label", "center"), "center")
    return similarity.assign_centers(vecs, centers).select(
        "record_id", "center", *rounded(["distance"])
    )

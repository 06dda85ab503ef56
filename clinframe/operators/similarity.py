"""Similar patients and clusters of patients from their embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from clinframe.operators.retrieval import DECIMALS, topk_inner_product
from clinframe.operators.skew import spread
from clinframe.schema import col
from clinframe.session import materialise, stored

#: Fixed values.
SMALL_BANDWIDTH = 1e-3
MAX_ITERATIONS = 1000
#: Centers that may be sent to every executor.
MAX_CENTERS = 4096
#: Words of a text, buckets their hashes fall into, and words whose buckets a task remembers.
TERM = r"[^\x20\x09-\x0D]+"
DIM = 256
MOST_WORDS = 1 << 18


def kernel_bandwidth(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """Mean squared distance over all ordered pairs, from sums alone: no pair is formed.

    The sum over pairs is ``2 n Σ|x|² - 2 |Σx|²``. One row; 1 where the mean is below 0.001.
    """
    parts = Summarizer.metrics("sum", "normL2", "count").summary(array_to_vector(col(vector)))
    row = vectors.agg(parts.alias("s")).select(
        F.col("s.count").alias("n"),
        vector_to_array(F.col("s.sum")).alias("sums"),
        vector_to_array(F.col("s.normL2")).alias("norms"),
    )

    def squares(c: str) -> Column:
        return F.aggregate(F.col(c), F.lit(0.0), lambda a, v: a + v * v)

    total = 2 * F.col("n") * squares("norms") - 2 * squares("sums")
    width = F.try_divide(total, F.col("n") * F.col("n") - F.col("n"))
    small = width.isNull() | (width < SMALL_BANDWIDTH)
    return row.select("n", F.when(small, F.lit(1.0)).otherwise(width).alias("bandwidth"))


def patient_similarity(
    vectors: DataFrame,
    k: int,
    id_column: str = "record_id",
    vector: str = "vector",
    bandwidth: float | None = None,
    **options,
) -> DataFrame:
    """k nearest other patients by squared distance, with their Gaussian kernel value."""
    hits = topk_inner_product(
        vectors.select(col(id_column).alias("query_id"), col(vector).alias("vector")),
        vectors.select(col(id_column).alias("neighbour"), col(vector).alias("vector")),
        k,
        doc_id="neighbour",
        metric="l2",
        skip_same=True,
        **options,
    )
    if bandwidth is None:
        width = kernel_bandwidth(vectors, vector).select("bandwidth").scalar()
    else:
        width = F.lit(float(bandwidth))
    distance = -F.col("score")
    return hits.select(
        F.col("query_id").alias(id_column),
        "neighbour",
        "rank",
        distance.alias("distance"),
        F.exp(F.col("score") / width).alias("kernel"),
    )


def fit_clusters(
    vectors: DataFrame, k: int, vector: str = "vector", seed: int = 42, iterations: int = MAX_ITERATIONS
) -> KMeansModel:
    """Lloyd's k-means from random rows until the centers rest."""
    kmeans = KMeans(k=k, seed=seed, initMode="random", maxIter=iterations, tol=0.0, featuresCol="_v")
    return kmeans.fit(vectors.select(array_to_vector(col(vector)).alias("_v")))


def patient_clusters(vectors: DataFrame, k: int, vector: str = "vector", **options) -> DataFrame:
    """Adds the ``cluster`` of every row."""
    model = fit_clusters(vectors, k, vector, **options)
    placed = model.transform(vectors.withColumn("_v", array_to_vector(col(vector))))
    return placed.withColumnRenamed("prediction", "cluster").drop("_v")


def lloyd_clusters(
    vectors: DataFrame,
    centers: DataFrame,
    id_column: str = "record_id",
    vector: str = "vector",
    iterations: int = MAX_ITERATIONS,
    report: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Lloyd's k-means from given ``centers`` (center, vector): the cluster and squared distance of
    every row, and the centers they refer to.

    A round places every row with its nearest center, the lowest on ties, and moves each center to
    the mean of its rows; a center without rows stays where it is. Rounds end when no row changes
    its cluster, or after ``iterations``. Ids are unique; vectors have the centers' length. Vectors
    are read where they lie; what is shuffled is a mean per task and center, and id and cluster to
    tell changes. An empty table gives no rows and leaves the centers. ``report`` receives rounds
    and the rows that changed in the last one.
    """
    now = materialise(centers.select(F.col("center").cast("int").alias("center"), col(vector).cast("array<double>").alias(vector)))
    rows = vectors.select(col(id_column), col(vector).cast("array<double>").alias(vector))
    before, rounds, changed = None, 0, None
    while True:
        placed = stored(assign_centers(rows, now, id_column, "center", vector))
        if before is not None:
            both = placed.join(before.select(col(id_column), F.col("center").alias("_before")), id_column)
            changed = both.where("center <> _before").count()
        if changed == 0 or rounds == iterations:
            break
        means = mean_vectors(rows.join(placed.select(col(id_column), "center"), id_column), "center", vector)
        moved = now.join(means.withColumnRenamed(vector, "_mean"), "center", "left")
        now = materialise(moved.select("center", F.coalesce("_mean", vector).alias(vector)))
        before, rounds = placed, rounds + 1
    if report is not None:
        report |= {"rounds": rounds, "changed": changed}
    return placed.withColumnRenamed("center", "cluster"), now


def mean_vectors(df: DataFrame, by: str, vector: str = "vector") -> DataFrame:
    """Mean vector per group, combined before the shuffle."""
    mean = Summarizer.mean(array_to_vector(col(vector)))
    return df.groupBy(col(by)).agg(vector_to_array(mean).alias(vector))


def assign_centers(
    vectors: DataFrame,
    centers: DataFrame,
    id_column: str = "record_id",
    center_id: str = "center",
    vector: str = "vector",
    most: int = MAX_CENTERS,
) -> DataFrame:
    """Nearest center of every row by squared distance, the lowest center on ties.

    Up to ``most`` centers go to every executor and rows stay in place; more are searched by
    blocks of both sides.
    """
    rows = centers.select(col(center_id), col(vector)).limit(most + 1).collect()
    if len(rows) > most:
        hits = topk_inner_product(vectors, centers, 1, id_column, center_id, vector, metric="l2")
        return hits.select(col(id_column), col(center_id).cast("int").alias(center_id), (-F.col("score")).alias("distance"))
    rows = sorted(rows, key=lambda r: r[0])
    names = np.asarray([r[0] for r in rows])
    matrix = np.asarray([r[1] for r in rows], dtype=np.float64)
    shipped = vectors.sparkSession.sparkContext.broadcast((names, matrix))
    out = StructType(
        [
            vectors.select(col(id_column)).schema[0],
            StructField(center_id, IntegerType()),
            StructField("distance", DoubleType()),
        ]
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shipped.value
        norms = (matrix * matrix).sum(axis=1)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = flat.reshape(batch.num_rows, -1)
            squared = (x * x).sum(axis=1)[:, None] + norms[None, :] - 2 * (x @ matrix.T)
            squared = np.round(np.maximum(squared, 0.0), DECIMALS)
            nearest = squared.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(names[nearest], pa.int32()),
                    pa.array(squared[np.arange(len(x)), nearest], pa.float64()),
                ],
                names=[id_column, center_id, "distance"],
            )

    return vectors.select(col(id_column), col(vector)).mapInArrow(assign, out)


class _Buckets(dict):
    """Buckets of words, remembered as far as ``MOST_WORDS``: the first 32 bits of their md5, modulo ``dim``."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        bucket = self[word] = int.from_bytes(hashlib.md5(word).digest()[:4], "big") % self.dim
        return bucket


def _bucket_counts(texts: pa.Array, buckets: _Buckets) -> np.ndarray:
    """How often the words of each bucket occur in every text; words end at ASCII white space only."""
    out = np.zeros((len(texts), buckets.dim), np.int64)
    for row, text in enumerate(texts):
        words = text.as_py().split()
        out[row] = np.bincount(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)), minlength=buckets.dim)
    return out


def _lists(matrix: np.ndarray) -> pa.Array:
    rows, dim = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * dim + 1, dim), pa.int32()), pa.array(matrix.ravel()))


def _dealt(df: DataFrame, id_column: str, text: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Lower-cased texts as bytes, in parts for all cores however few files they come from."""
    lower = F.lower(F.coalesce(text, F.lit(""))).cast("binary")
    return spread(df.select(col(id_column), *map(col, keep), lower.alias("_text")), [id_column])


def term_weights(corpus: DataFrame, id_column: str, text: Column, dim: int = DIM) -> DataFrame:
    """``(bucket, idf)``: ln((documents + 1) / (documents with the bucket + 1)); at most ``dim``
    rows, written once."""
    buckets = _Buckets(dim)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(dim, np.int64), 0
        for batch in batches:
            seen += (_bucket_counts(batch.column(0), buckets) > 0).sum(axis=0)
            rows += batch.num_rows
        # A row of no bucket tells how many texts the task had.
        numbers = [np.arange(-1, dim, dtype=np.int32), np.concatenate([[rows], seen])]
        yield pa.RecordBatch.from_arrays([pa.array(n) for n in numbers], names=["bucket", "_df"])

    parts = _dealt(corpus, id_column, text).select("_text").mapInArrow(count, "bucket int, _df long")
    found = materialise(parts.groupBy("bucket").agg(F.sum("_df").alias("_df")))
    documents = found.where("bucket < 0").select("_df").scalar()
    seen = found.where("bucket >= 0 AND _df > 0")
    return materialise(seen.select("bucket", F.log((documents + 1) / (F.col("_df") + 1)).alias("idf")))


def hashed_tfidf(
    df: DataFrame, id_column: str, text: Column, weights: DataFrame, dim: int = DIM, keep: Sequence[str] = ()
) -> DataFrame:
    """``(id, *keep, vector)``: unit-length hashed TF-IDF of a text as ``dim`` doubles, so that an inner
    product is a cosine. Stands in for a neural encoder. A text without known words has zeros."""
    idf, buckets = np.zeros(dim), _Buckets(dim)
    for r in weights.select("bucket", "idf").collect():  # at most ``dim`` rows
        idf[r["bucket"]] = r["idf"]

    def unit(texts: pa.Array) -> pa.Array:
        raw = _bucket_counts(texts, buckets) * idf
        norm = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
        return _lists(np.divide(raw, norm, out=np.zeros_like(raw), where=norm > 0))

    vector = F.arrow_udf(unit, "array<double>")(F.col("_text"))
    return _dealt(df, id_column, text, keep).select(col(id_column), *map(col, keep), vector.alias("vector"))

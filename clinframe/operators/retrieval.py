"""Exact nearest vectors by inner product or distance, and the passages behind the hits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from clinframe.operators.skew import BROADCAST_WIDE_ROWS, skewed_join, spread
from clinframe.schema import col

#: Bytes of query vectors that may be sent to every executor.
QUERY_BYTES = 64 * 1024 * 1024
#: Bytes of vectors of one side of a cell when both sides are partitioned.
BLOCK_BYTES = 32 * 1024 * 1024
#: Bytes of scores computed at a time, and queries they belong to at most.
SCORE_BYTES = 8 * 1024 * 1024
TILE_QUERIES = 2048
#: Queries up to which the corpus is not counted to see whether it can be sent instead.
FEW_QUERIES = 1024
#: Scores are compared at this many decimals, so that equal vectors tie whatever the order
#: in which a matrix product adds up.
DECIMALS = 10


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrow lists of one length as rows of doubles."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(vectors), -1 if len(vectors) else 0)


def _ranks(ids: np.ndarray) -> np.ndarray:
    """Numbers that sort like the ids (which may be text)."""
    return ids if ids.dtype.kind in "iuf" else np.unique(ids, return_inverse=True)[1]


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int):
    """The k best (score descending, id ascending) candidates of every query."""
    order = np.lexsort((_ranks(ids), -score, query))
    query, score, ids = query[order], score[order], ids[order]
    place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
    keep = place < k
    return query[keep], score[keep], ids[keep]


class _Nearest:
    """The k best corpus rows per query and group seen so far in one task.

    Scores are computed in tiles. A tile gives only the scores that reach the k-th best of their query
    so far; few do, once some tiles have passed."""

    def __init__(self, query_ids, queries: np.ndarray, k: int, metric: str, skip_same: bool, decimals: int):
        self.query_ids, self.queries = np.asarray(query_ids), queries
        self.k, self.metric, self.skip_same, self.decimals = k, metric, skip_same, decimals
        self.norms = (queries * queries).sum(axis=1)
        self.found: dict = {}
        self.floors: dict = {}

    def add(self, group, ids: np.ndarray, vectors: np.ndarray) -> None:
        if group not in self.found:
            none = np.empty(0, np.int64)
            self.found[group] = (none, np.empty(0), ids[:0])
            self.floors[group] = np.full(len(self.queries), -np.inf)
        finite = bool(np.isfinite(vectors).all() and np.isfinite(self.norms).all())
        size = max(1, SCORE_BYTES // (8 * min(TILE_QUERIES, max(1, len(self.queries)))))
        for start in range(0, len(ids), size):
            rows = slice(start, start + size)
            self._add(group, ids[rows], vectors[rows], finite)

    def _add(self, group, ids: np.ndarray, vectors: np.ndarray, finite: bool) -> None:
        floors, norms = self.floors[group], (vectors * vectors).sum(axis=1)
        hits = []
        for start in range(0, len(self.queries), TILE_QUERIES):
            mine = slice(start, start + TILE_QUERIES)
            scores = self.queries[mine] @ vectors.T
            if self.metric == "l2":
                scores *= 2
                scores -= self.norms[mine, None]
                scores -= norms[None, :]
                np.minimum(scores, 0.0, out=scores)
            if not finite:
                scores[np.isnan(scores)] = -np.inf
            if self.skip_same:
                same = self.query_ids[mine, None] == ids[None, :]
                scores[same] = -np.inf
            floor = floors[mine]
            some = np.flatnonzero(scores.max(axis=1) >= floor)
            scores, floor = scores[some], floor[some]
            if len(ids) > self.k and len(some):
                floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k] - self._margin())
            query, row = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
            hits.append((some[query] + start, np.round(scores[query, row], self.decimals), row))
        query, score, row = map(np.concatenate, zip(*hits, strict=True))
        if not len(query):
            return
        q0, s0, i0 = self.found[group]
        query, score, found = np.concatenate([q0, query]), np.concatenate([s0, score]), np.concatenate([i0, ids[row]])
        query, score, found = self.found[group] = _best(query, score, found, self.k)
        # Found rows are in the order of their queries, k at most of each: the k-th is the floor.
        last = np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query, side="left") == self.k - 1)
        floors[query[last]] = score[last] - self._margin()

    def _margin(self) -> float:
        """What rounding may add to a score."""
        return 10.0**-self.decimals

    def results(self) -> Iterator[tuple]:
        for group, (query, score, ids) in self.found.items():
            if len(query):
                yield group, self.query_ids[query], ids, score


def topk_inner_product(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    vector: str = "vector",
    within: str | None = None,
    metric: str = "ip",
    skip_same: bool = False,
    query_bytes: int = QUERY_BYTES,
    block_bytes: int = BLOCK_BYTES,
    decimals: int = DECIMALS,
) -> DataFrame:
    """Exact k best corpus rows per query: ``(query_id[, within], doc_id, score, rank)``.

    ``within`` searches each of its values on its own. ``metric`` is ``ip`` (inner product)
    or ``l2`` (score = minus squared distance). Every task multiplies whole blocks and emits
    only its own k best, so no pair is ever a row. Vectors that are NULL or hold NULL, and those
    of another length than the longest query, take no part; a NULL ``within`` is a group.

    One side of up to ``query_bytes`` goes to the executors, and the other is spread over all
    cores: the corpus goes where there are many queries, as each task then has the whole answer of
    its queries, else the queries. Where neither is small
    enough, both are cut into blocks, and each pair of blocks is one group.
    """
    q = queries.select(col(query_id).alias("q_id"), col(vector).alias("q_vec"))
    group = col(within) if within else F.lit(0)
    c = corpus.select(group.alias("grp"), col(doc_id).alias("c_id"), col(vector).alias("c_vec"))
    schema = StructType(
        [
            q.schema["q_id"],
            c.schema["grp"],
            c.schema["c_id"],
            StructField("score", DoubleType()),
        ]
    )
    # A vector that is missing, holds missing values or is not as long as the queries scores nothing.
    whole = lambda v: F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull())
    q = q.where(whole("q_vec") & F.col("q_id").isNotNull())
    count, dim = q.agg(F.count(F.lit(1)), F.max(F.size("q_vec"))).first()
    q = q.where(F.size("q_vec") == F.lit(dim or 0))
    c = c.where(whole("c_vec") & (F.size("c_vec") == F.lit(dim or 0)))
    most = query_bytes // (8 * (dim or 1))
    if count > FEW_QUERIES and c.limit(most + 1).count() <= most:
        local = _search_corpus(q, c, k, metric, skip_same, decimals, schema)
    elif count <= most:
        local = _search_broadcast(q, c, k, metric, skip_same, decimals, schema)
    else:
        local = _search_blocks(q, c, k, metric, skip_same, decimals, schema, count, dim, block_bytes)
    best = Window.partitionBy("q_id", "grp").orderBy(F.desc("score"), "c_id")
    ranked = local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(
        F.col("q_id").alias(query_id),
        *([F.col("grp").alias(within)] if within else []),
        F.col("c_id").alias(doc_id),
        "score",
        "rank",
    )


def _groups(groups: pa.Array) -> Iterator[tuple]:
    """Each value among ``groups``, NULL as None, and where it stands."""
    for value in pc.unique(groups):
        here = pc.is_null(groups) if not value.is_valid else pc.equal(groups, value)
        yield value.as_py(), np.flatnonzero(pc.fill_null(here, False).to_numpy(zero_copy_only=False))


def _hits(nearest: _Nearest, q_type: pa.DataType, group_type: pa.DataType, doc_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for value, query, found, score in nearest.results():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(query, q_type),
                pa.array([value] * len(query), group_type),
                pa.array(found, doc_type),
                pa.array(score, pa.float64()),
            ],
            names=["q_id", "grp", "c_id", "score"],
        )


def _search_corpus(
    q: DataFrame, c: DataFrame, k: int, metric: str, skip_same: bool, decimals: int, schema: StructType
) -> DataFrame:
    table = c.toArrow().combine_chunks()  # at most QUERY_BYTES, checked by the caller
    names, matrix = table.column("c_id").to_numpy(), _matrix(table.column("c_vec"))
    parts = [(value, names[at], matrix[at]) for value, at in _groups(table.column("grp").combine_chunks())]
    shipped = q.sparkSession.sparkContext.broadcast(parts)
    types = (table.schema.field("grp").type, table.schema.field("c_id").type)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column("q_id").to_numpy(zero_copy_only=False)
            nearest = _Nearest(ids, _matrix(batch.column("q_vec")), k, metric, skip_same, decimals)
            for value, found, vectors in shipped.value:
                nearest.add(value, found, vectors)
            yield from _hits(nearest, batch.schema.field("q_id").type, *types)

    # Files of vectors are small: the rows of one would be the work of one task.
    return spread(q, ["q_id"]).mapInArrow(search, schema)


def _search_broadcast(
    q: DataFrame, c: DataFrame, k: int, metric: str, skip_same: bool, decimals: int, schema: StructType
) -> DataFrame:
    table = q.toArrow()  # at most QUERY_BYTES, checked by the caller
    ids = table.column("q_id").to_numpy()
    shipped = q.sparkSession.sparkContext.broadcast((ids, _matrix(table.column("q_vec"))))
    q_type = table.schema.field("q_id").type

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shipped.value
        if len(ids) == 0:
            return
        nearest = _Nearest(ids, matrix, k, metric, skip_same, decimals)
        types = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            types = [batch.schema.field(n).type for n in ("grp", "c_id")]
            names, vectors = batch.column("c_id").to_numpy(zero_copy_only=False), _matrix(batch.column("c_vec"))
            for value, at in _groups(batch.column("grp")):
                nearest.add(value, names[at], vectors[at])
        if types:
            yield from _hits(nearest, q_type, *types)

    return spread(c, ["c_id"]).mapInArrow(search, schema)


def _search_blocks(
    q: DataFrame,
    c: DataFrame,
    k: int,
    metric: str,
    skip_same: bool,
    decimals: int,
    schema: StructType,
    count: int,
    dim: int,
    block_bytes: int,
) -> DataFrame:
    per_block = max(1, block_bytes // (8 * dim))
    c_blocks = max(1, -(-c.count() // per_block))
    # Smaller blocks of queries where there are fewer cells than cores.
    cores = q.sparkSession.sparkContext.defaultParallelism
    q_blocks = max(1, -(-count // per_block), min(-(-2 * cores // c_blocks), -(-count // TILE_QUERIES)))
    left = q.withColumn("qb", F.pmod(F.xxhash64("q_id"), F.lit(q_blocks))).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)).cast("array<bigint>"))
    )
    right = c.withColumn("cb", F.pmod(F.xxhash64("c_id"), F.lit(c_blocks))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)).cast("array<bigint>"))
    )

    def search(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        types = [mine.schema.field("q_id").type, *[theirs.schema.field(n).type for n in ("grp", "c_id")]]
        out = pa.schema(list(zip(["q_id", "grp", "c_id", "score"], [*types, pa.float64()], strict=True)))
        if not mine.num_rows or not theirs.num_rows:
            return out.empty_table()
        nearest = _Nearest(mine.column("q_id").to_numpy(), _matrix(mine.column("q_vec")), k, metric, skip_same, decimals)
        found, vectors = theirs.column("c_id").to_numpy(), _matrix(theirs.column("c_vec"))
        for value, at in _groups(theirs.column("grp").combine_chunks()):
            nearest.add(value, found[at], vectors[at])
        return pa.Table.from_batches(_hits(nearest, *types), out)

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(search, schema)


def multi_corpus_topk(
    queries: DataFrame,
    corpora: DataFrame,
    k: int,
    corpus: str = "corpus",
    query_id: str = "query_id",
    merge: bool = False,
    doc_id: str = "doc_id",
    **options,
) -> DataFrame:
    """k hits per corpus, numbered through in corpus order (``position``).

    With ``merge`` the hits of all corpora compete and k per query remain.
    """
    hits = topk_inner_product(
        queries, corpora, k, query_id=query_id, doc_id=doc_id, within=corpus, **options
    )
    if merge:
        order = [F.desc("score"), col(corpus), col(doc_id)]
    else:
        order = [col(corpus), F.col("rank")]
    position = F.row_number().over(Window.partitionBy(col(query_id)).orderBy(*order))
    numbered = hits.withColumn("position", position)
    return numbered.where(F.col("position") <= k) if merge else numbered


def fetch_passages(hits: DataFrame, corpus: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Title, content and vector of every hit. A document many queries hit is set apart."""
    return skewed_join(hits, corpus, [doc_id], bound=BROADCAST_WIDE_ROWS, most_bytes=QUERY_BYTES)


def context_line(position: Column, title: Column, content: Column) -> Column:
    """Fixed format of one numbered passage."""
    return F.format_string("Document [%d] (Title: %s) %s", position, title, content)


def render_context(
    passages: DataFrame, query_id: str = "query_id", position: str = "position"
) -> DataFrame:
    """All passages of a query as numbered lines, in order. A query has at most k per corpus."""
    line = F.struct(
        col(position).alias("at"), context_line(col(position), F.col("title"), F.col("content")).alias("text")
    )
    lines = F.array_sort(F.collect_list(line))
    return passages.groupBy(col(query_id)).agg(F.array_join(lines["text"], "\n").alias("context"))

"""Exact top-k inner products on a bit-sliced index.

Components are quantised to integers and, block by block of rows, stored as bit slices: bitmap b
of attribute d holds bit b of every row. A query's score for all rows of a block is a sum of
bitmaps with weights that are powers of two; carry-save adders (three bitmaps of one weight make
one of that weight and one of the next) reduce it to one bitmap per bit of the score. The best
rows are selected from the most significant slice downward; rows that tie at the boundary are
resolved exactly, by their ids.

The corpus is read in place. Queries are taken in chunks of about ``CHUNK``, a bounded number of
narrow rows that every task gets; each task sends on k rows per query and block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinframe.session import stored

#: Rows of one index block at most, and bytes of its quantised components.
BLOCK, BLOCK_BYTES = 1 << 16, 1 << 26
#: Queries that go to the tasks at a time.
CHUNK = 4096
#: Quantised components below this are longs in numpy; vectors with others hold Python's integers.
LONG = 1 << 62


def usable(vector: Column) -> Column:
    """The components as doubles; NULL when the vector is null or holds null or a component that is
    not finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    return F.when(F.forall(doubles, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), doubles)


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: longs, or Python's integers where one does not fit ``LONG``.
    Doubles from 2^53 on are whole numbers, so no digit is lost."""
    if not values.size or np.abs(values).max() < LONG / scale:
        return np.floor(values * scale).astype(np.int64)
    exact = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in values.ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(values.shape)


class Block:
    """Bit slices of the rows of ``values`` (rows x attributes), and of their complements."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.rows, self.low, self.high = len(ids), values.min(axis=0), values.max(axis=0)
        self.up = [self._slices(values[:, d] - self.low[d]) for d in range(values.shape[1])]
        self.down = [self._slices(self.high[d] - values[:, d]) for d in range(values.shape[1])]

    def _slices(self, column: np.ndarray) -> list[np.ndarray]:
        if column.dtype == object and int(column.max()) < 2 * LONG:
            column = column.astype(np.int64)
        return [self.bitmap((column >> b & 1).astype(np.uint8)) for b in range(int(column.max()).bit_length())]

    def bitmap(self, bits: np.ndarray) -> np.ndarray:
        padded = np.zeros(-(-self.rows // 64) * 64, np.uint8)
        padded[: self.rows] = bits
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of every row's score less a constant, and the constant."""
        level: list[list[np.ndarray]] = []
        constant = 0
        for d in np.flatnonzero(query):
            q = int(query[d])
            weight = abs(q)
            constant += q * int(self.low[d] if q > 0 else self.high[d])
            for b, bitmap in enumerate(self.up[d] if q > 0 else self.down[d]):
                for w in range(weight.bit_length()):
                    if weight >> w & 1:
                        while len(level) <= b + w:
                            level.append([])
                        level[b + w].append(bitmap)
        out = []
        for place in range(10**6):
            if place == len(level):
                return out, constant
            held = level[place]
            while len(held) > 1:
                if place + 1 == len(level):
                    level.append([])
                x, y = held.pop(), held.pop()
                half = x ^ y
                if held:
                    z = held.pop()
                    held.append(half ^ z)
                    level[place + 1].append((x & y) | (half & z))
                else:
                    held.append(half)
                    level[place + 1].append(x & y)
            out.append(held[0] if held else np.zeros_like(self.bitmap(np.zeros(self.rows, np.uint8))))

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, list[int]]:
        """Ids and scores of the k best rows whose id is not ``own``."""
        slices, constant = self.sums(query)
        first, last = np.searchsorted(self.ids, [own, own + 1])
        allowed = np.ones(self.rows, np.uint8)
        allowed[first:last] = 0
        sure, open_ = np.zeros(-(-self.rows // 64), np.uint64), self.bitmap(allowed)
        for s in reversed(slices):
            tried = sure | (open_ & s)
            count = int(np.bitwise_count(tried).sum())
            if count > k:
                open_ = open_ & s
            else:
                sure, open_ = tried, open_ & ~s
                if count == k:
                    open_ = np.zeros_like(open_)
                    break
        rows = self._rows(sure)
        rows = np.concatenate([rows, self._rows(open_)[: k - len(rows)]])
        scores = [constant] * len(rows)
        for b, s in enumerate(slices):
            for i in np.flatnonzero(s[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)):
                scores[i] += 1 << b
        return self.ids[rows], scores

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[words].view(np.uint8), bitorder="little").reshape(-1, 64)
        word, bit = np.nonzero(bits)
        return words[word] * 64 + bit


def _beyond(score: int) -> bytes | None:
    """For scores at or past the ends of a long, bytes in their order; NULL for all others."""
    if -(2**63) < score < 2**63 - 1:
        return None
    size = abs(score).bit_length() // 8 + 1
    return (0x8000 + (size if score > 0 else -size)).to_bytes(2, "big") + (score % (1 << 8 * size)).to_bytes(size, "big")


def _search(batches: Iterator[pa.RecordBatch], queries: dict[int, list], k: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, v): per block, and per query of the same number of components, the k best."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def answer(width: int) -> pa.RecordBatch:
        ids = np.concatenate([i for i, _ in held[width]])
        values = np.concatenate([v for _, v in held.pop(width)])
        query, found, beyond, scores = [], [], [], []
        block = Block(ids, quantised(values, scale))
        for number, own, vector in queries[width]:
            best, reached = block.top(quantised(vector, scale), own, k)
            query += [number] * len(best)
            found.append(best)
            scores += [min(max(x, -(2**63)), 2**63 - 1) for x in reached]
            beyond += map(_beyond, reached)
        columns = {"query": pa.array(query, pa.int64()), "vec_id": np.concatenate(found).astype(np.int64)}
        return pa.RecordBatch.from_pydict(columns | {"score": pa.array(scores, pa.int64()), "beyond": pa.array(beyond, pa.binary())})

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        column = batch.column(1)
        flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        widths = np.diff(ends)
        for width in np.unique(widths):
            if int(width) in queries:
                rows = np.flatnonzero(widths == width)
                most = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(int(width), 1))))
                for at in range(0, len(rows), most):
                    part = rows[at : at + most]
                    parts = held.setdefault(int(width), [])
                    parts.append((ids[part], flat[ends[part][:, None] + np.arange(width)]))
                    if sum(len(i) for i, _ in parts) >= most:
                        yield answer(int(width))
    for width in list(held):
        yield answer(width)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, chunk: int = CHUNK
) -> DataFrame:
    """For each query row the k largest integer inner products with all other rows: query_id,
    rank, vec_id, score; ties go to the smaller id.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an
    id. Scores are exact whatever the size of the components; one that no long can hold is shown as
    the nearest long, and ranked by its value. A query is compared with vectors of its own length, and never with rows of its
    own id. Repeated rows are candidates each; equal queries are answered once. Empty vectors
    score 0. An empty table gives no rows. Other columns are not read.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), usable(F.col(vector)).alias("v"), is_query.alias("asks"))
    rows = rows.where("vec_id is not null and v is not null")
    asked = rows.where("asks").select("vec_id", "v").distinct()
    asked = stored(asked.withColumn("number", F.xxhash64("vec_id", "v")))
    corpus = rows.select("vec_id", "v")
    chunks = -(-asked.count() // chunk)
    parts = []
    for number in range(chunks):
        queries: dict[int, list] = {}
        for q in asked.where(F.pmod(F.hash("number"), F.lit(chunks)) == number).toLocalIterator():
            queries.setdefault(len(q["v"]), []).append((q["number"], q["vec_id"], np.array(q["v"], np.float64)))
        given = vectors.sparkSession.sparkContext.broadcast(queries)
        found = corpus.mapInArrow(
            lambda batches, given=given: _search(batches, given.value, k, scale), "query long, vec_id long, score long, beyond binary"
        )
        parts.append(stored(found))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id")
    found = asked.select(*[F.lit(0).alias(c) for c in ("query", "vec_id", "score")], F.lit(None).cast("binary").alias("beyond")).limit(0)
    for part in parts:
        found = found.unionByName(part)
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = asked.select(F.col("number").alias("query"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, "query").select("query_id", "rank", "vec_id", "score")

"""Mix sources to target weights by pivotal dependent rounding.

Every document of a source gets the same fractional number of copies, target / source size. Its
whole part is certain; the fraction is rounded so that the source's words stay on target: two
fractional documents are paired, and words of expected mass move from one to the other, the way
drawn at random so that each keeps its expectation, until one of them is 0 or 1. The other one is
paired with the next document. Each bucket of a source leaves at most one fractional document;
these residuals are combined, ``FAN`` buckets at a time, in a reduction tree. The last residual of
a source is rounded to the nearer side, so a source ends within half of one document's words (in
the larger of the two roundings) of its target.

Buckets follow a hash of the document and rows are sorted in them, so results do not depend on
how files or tasks were cut, and draws come from hashes of the two ids.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinframe.llm.common import WORD, apart, shuffle_tasks
from clinframe.session import stored

WEIGHTS = (3, 1, 2)
#: Words of the mix per word of the input.
FACTOR = 1.5
#: Copies that a document may have at most.
MOST = 2
#: Documents of one source in a bucket, about.
BUCKET = 4096
#: Buckets whose residuals meet in one step of the tree.
FAN = 32


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, factor: float = FACTOR, most: float = MOST) -> list[float]:
    """Words to take of each source: shares by weight, none above ``most`` times its size; what a
    full source leaves is shared among the others by weight."""
    weigh = [weights[i % len(weights)] for i in range(len(sizes))]
    left, open_, out = factor * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weigh[i] for i in open_)
        full = {i for i in open_ if unit * weigh[i] >= most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = unit * weigh[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def _draw(*parts: int) -> float:
    return xxhash.xxh64_intdigest(struct.pack(f"<{len(parts)}q", *parts), 42) / 2**64


def _pair(a: tuple, b: tuple, level: int) -> tuple[float, float]:
    """New fractions of two documents (fraction, words, id), one of them 0 or 1."""
    (p, m, i), (q, n, j) = a, b
    up = min((1 - p) * m, q * n)
    down = min(p * m, (1 - q) * n)
    if _draw(i, j, level) * (up + down) < down:
        p, q = (1.0 if up == (1 - p) * m else p + up / m), (0.0 if up == q * n else q - up / n)
    else:
        p, q = (0.0 if down == p * m else p - down / m), (1.0 if down == (1 - q) * n else q + down / n)
    snap = lambda x: round(x) if abs(x - round(x)) < 1e-12 else x
    return snap(p), snap(q)


def _pivot(batches: Iterator[pa.RecordBatch], level: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (_source, _bucket): the same rows with new fractions. Holds one document."""
    held, key, mass = None, None, None  # the open document: its row, its bucket, (fraction, words, id)

    def done(p: float) -> float:
        return float(p >= 0.5) if last else p

    def put(rows: pa.RecordBatch, fractions: list[float]) -> pa.RecordBatch:
        at = rows.schema.get_field_index("_pi")
        return rows.set_column(at, "_pi", pa.array(fractions, pa.float64()))

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("_source", "_bucket", "_pi", "size", "_id")]
        out, at = list(columns[2]), None
        for r, (source, bucket, p, size, id_) in enumerate(zip(*columns, strict=True)):
            if (source, bucket) != key:
                if mass and at is None:
                    yield put(held, [done(mass[0])])
                elif mass:
                    out[at] = done(mass[0])
                key, mass, at = (source, bucket), None, None
            if not size:
                out[r] = float(_draw(id_, level) < p)
            elif not 0 < p < 1:
                pass
            elif not mass:
                mass, at = (p, size, id_), r
            else:
                p0, p1 = _pair(mass, (p, size, id_), level)
                if p0 in (0, 1):
                    if at is None:
                        yield put(held, [p0])
                    else:
                        out[at] = p0
                    mass, at = (p1, size, id_), r
                    if p1 in (0, 1):
                        out[r], mass, at = p1, None, None
                else:
                    out[r] = p1
                    mass = (p0, *mass[1:])
        rest = [r for r in range(len(out)) if r != at]
        if rest:
            yield put(batch.take(pa.array(rest)), [out[r] for r in rest])
        if at is not None:
            held = batch.slice(at, 1)
    if mass:
        yield put(held, [done(mass[0])])


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, factor: float = FACTOR, most: int = MOST, bucket: int = BUCKET
) -> DataFrame:
    """``docs`` (doc_id, source, size and any other columns) with source_size, target and copies.

    Sources count by code point, null last, and weigh ``weights``, repeating; their sizes and
    names come to the driver, one row per source. Documents without words get copies by a draw of
    their own. Repeated rows are documents each; a null id draws like id 0. An empty table gives
    no rows; sources without words have target 0. Of further columns those named like an added one
    are replaced.
    """
    docs, whole_rows = apart(docs, ("doc_id", "source", "size", "lang", "text"))
    names = docs.columns
    totals = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    found = sorted(totals.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    goal = targets([r["source_size"] for r in found], weights, factor, most)
    rows = [
        (r["source"], k, r["source_size"], t, 1 << (-(-r["n"] // bucket) - 1).bit_length())
        for k, (r, t) in enumerate(zip(found, goal, strict=True))
    ]
    schema = pa.schema(
        [("_name", pa.string()), ("_source", pa.int32()), ("source_size", pa.int64()), ("target", pa.float64()), ("_buckets", pa.int64())]
    )
    # An Arrow table: a list of rows would go through Python workers of its own on the executors.
    given = pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
    about = F.broadcast(docs.sparkSession.createDataFrame(given))
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    work = (
        docs.join(about, docs["source"].eqNullSafe(about["_name"]))
        .withColumn("_id", id_)
        .withColumn("_bucket", F.pmod(F.xxhash64("_id", "size"), F.col("_buckets")))
        .withColumn("_whole", F.floor(rate))
        .withColumn("_pi", (rate - F.floor(rate)).cast("double"))
        .drop("_name", "_buckets")
    )
    most_buckets, level, parts = max((r[4] for r in rows), default=1), 0, []
    while True:
        last = most_buckets == 1
        dealt = work.repartition(shuffle_tasks(docs.sparkSession), "_source", "_bucket")
        order = dealt.sortWithinPartitions("_source", "_bucket", F.desc("size"), "_id", *[n for n in names if n in ("lang", "text")])
        solved = order.mapInArrow(lambda x, level=level, last=last: _pivot(x, level, last), work.schema)
        solved = stored(solved)
        parts.append(solved.where("_pi = 0 or _pi = 1"))
        if last:
            break
        work = solved.where("_pi > 0 and _pi < 1").withColumn("_bucket", F.floor(F.col("_bucket") / FAN))
        most_buckets, level = -(-most_buckets // FAN), level + 1
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    copies = (F.col("_whole") + F.col("_pi")).cast("int")
    return whole_rows(whole.withColumn("copies", copies), ("source_size", "target", "copies"))

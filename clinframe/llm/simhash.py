"""Near-duplicate documents by SimHash, found through deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that differ in at most
three bits differ in at most one bit in one of the segments, so deleting the right bit there
leaves equal keys. Each distinct fingerprint is indexed under its 64 one-wildcard variants, and
an equality shuffle on the variant brings candidates together; they are then verified. A bucket
that holds more than ``BUCKET`` fingerprints is cut again by variants of the other segment's
halves, then of the last half's quarters; after that at most 2^11 fingerprints can share a key,
so every bucket fits one task and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinframe.llm.common import components, shuffle_tasks
from clinframe.session import stored

#: Differing bits at which two fingerprints still link. The cut into segments relies on 3.
BITS = 3
#: Words of a shingle.
SHINGLE = 3
#: Fingerprints of one bucket that are compared at once: what the last cut can leave at most.
BUCKET = 2048
#: Shingles hashed between two additions to the bit counts.
PIECE = 1 << 16


def _fingerprint(text: bytes | None, width: int) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, count, PIECE):
        stop = min(start + PIECE, count)
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(start, stop)),
            np.uint64,
            stop - start,
        )
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > count, bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprint(text: Column, width: int = SHINGLE) -> Column:
    """SimHash of a text as a long: A-Z lower-cased, shingles of ``width`` words with repeats."""

    @F.arrow_udf("long")
    def simhash(column: pa.Array) -> pa.Array:
        return pa.array([_fingerprint(v.as_py(), width) for v in column], pa.int64())

    return simhash(text.cast("binary"))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits. Unsigned, as the count takes absolute values."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _stars(fps: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that connect what is within ``BITS`` of each other in one bucket: a forest, not all
    pairs."""
    label = np.arange(len(fps))
    for i in range(len(fps) - 1):
        near = i + 1 + np.flatnonzero(_apart(fps[i + 1 :], fps[i]) <= BITS)
        new = np.unique(label[near])
        new = new[new != label[i]]
        if len(new):
            for other in new:
                j = near[np.argmax(label[near] == other)]
                yield int(fps[i]), int(fps[j])
            label[np.isin(label, new)] = label[i]


def _bucket_edges(batches: Iterator[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, sub, fp) sorted by (key, sub): edges of each bucket, and the rows of buckets
    beyond ``bucket`` as they are, marked hot. Holds one batch and one open bucket."""

    def out(a, b, key, sub, hot):
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(x, np.int64)) for x in (a, b, key, sub)] + [pa.array(np.full(n, hot))],
            ["a", "b", "key", "sub", "hot"],
        )

    held = [np.empty(0, np.int64)] * 3
    hot_open = None
    for batch in batches:
        key, sub, fp = (
            np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)
        )
        if hot_open is not None:
            same = int(np.argmin(np.append((key == hot_open[0]) & (sub == hot_open[1]), False)))
            if same:
                yield out(fp[:same], fp[:same], key[:same], sub[:same], True)
                key, sub, fp = key[same:], sub[same:], fp[same:]
        if not len(key):
            held = [key, sub, fp]
            continue
        cut = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
        starts = np.concatenate([[0], cut])
        if len(key) - starts[-1] > bucket:
            last = starts[-1]
            yield out(fp[last:], fp[last:], key[last:], sub[last:], True)
            hot_open = (key[last], sub[last])
            held = [np.empty(0, np.int64)] * 3
        else:
            hot_open = None
            held = [x[starts[-1] :] for x in (key, sub, fp)]
        yield from _closed(out, key, sub, fp, starts, np.diff(starts), bucket)
    if len(held[0]):
        yield from _closed(out, *held, np.array([0]), np.array([len(held[0])]), bucket)


def _closed(out, key, sub, fp, starts, sizes, bucket):
    starts = starts[: len(sizes)]
    two = starts[sizes == 2]
    near = two[_apart(fp[two], fp[two + 1]) <= BITS]
    if len(near):
        yield out(fp[near], fp[near + 1], key[near], sub[near], False)
    for start, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        own = slice(start, start + size)
        if size > bucket:
            yield out(fp[own], fp[own], key[own], sub[own], True)
        elif edges := list(_stars(fp[own])):
            a, b = zip(*edges, strict=True)
            yield out(a, b, key[start : start + 1].repeat(len(a)), sub[start : start + 1].repeat(len(a)), False)


def _variants(value: str, bits: int) -> str:
    """SQL: the one-wildcard variants of a segment, numbered."""
    wild = f"{value} & ~shiftleft(1L, v)"
    return f"transform(sequence(0, {bits - 1}), v -> shiftleft(cast(v as bigint), {bits}) | ({wild}))"


_HIGH, _LOW = "shiftrightunsigned(fp, 32)", "(fp & 4294967295L)"
# The bits that a first key leaves out: those of the other segment.
_OTHER = f"if(shiftrightunsigned(key, 37) = 0, {_LOW}, {_HIGH})"


def _keys(fps: DataFrame) -> DataFrame:
    """Level 1: segments of 32 bits. key is segment (1 bit), wildcard (5 bits), value (32 bits)."""
    second = f"transform({_variants(_LOW, 32)}, x -> x | shiftleft(1L, 37))"
    keys = F.explode(F.expr(f"concat({_variants(_HIGH, 32)}, {second})"))
    return fps.select(keys.alias("key"), F.lit(0).cast("bigint").alias("sub"), "fp")


def _finer(hot: DataFrame, level: int) -> DataFrame:
    """Levels 2 and 3: add variants of the halves of the bits that no key has used so far."""
    if level == 2:
        rest, bits = _OTHER, 16
    else:
        rest, bits = f"if(shiftrightunsigned(sub, 20) = 0, ({_OTHER}) & 65535L, shiftrightunsigned({_OTHER}, 16))", 8
    top = _variants(f"shiftrightunsigned({rest}, {bits})", bits)
    low = _variants(f"(({rest}) & {(1 << bits) - 1}L)", bits)
    width = bits + (4 if bits == 16 else 3)
    finer = f"concat({top}, transform({low}, x -> x | shiftleft(1L, {width})))"
    packed = F.expr(f"transform({finer}, x -> shiftleft(sub, {width + 1}) | x)")
    return hot.select("key", F.explode(packed).alias("sub"), "fp")


def near_edges(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fps`` (fp long, one row each) exactly
    as all pairs within ``BITS`` would."""
    rows, found = _keys(fps), None
    for level in (2, 3, 4):
        most = BUCKET if level == 4 else bucket
        dealt = rows.repartition(shuffle_tasks(fps.sparkSession), "key", "sub").sortWithinPartitions("key", "sub")
        kept = stored(
            dealt.mapInArrow(lambda x, most=most: _bucket_edges(x, most), "a long, b long, key long, sub long, hot boolean")
        )
        edges = kept.where("not hot").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        hot = kept.where("hot").select("key", "sub", F.col("a").alias("fp"))
        if level == 4 or hot.isEmpty():
            return found.distinct()
        rows = _finer(hot, level)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long) and component_id, the smallest doc_id that
    links reach.

    Null and empty texts have fingerprint 0 and link like any other; repeated rows each get a row;
    rows with a null doc_id take part in links, but never name a component (its id is null when
    no member has an id). Other columns are not read.
    """
    marked = stored(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), width).alias("fp")))
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = stored(components(near_edges(classes.select("fp"))).withColumnRenamed("node", "fp"))
    joined = classes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = joined.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = stored(joined.join(named, "label").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")

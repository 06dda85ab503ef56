"""One document of each group of near copies, by the Jaccard similarity of five-word shingles.

Texts whose shingle sets share at least four fifths of their union link, and groups are the
components of the links. Every candidate pair is verified on the whole sets. Candidates are first
texts whose SimHash over the same shingles differs in few bits, found by the variants of
``simhash``. A similarity of 0.8 lies about ten bits apart, where no cut of 64 bits selects, so texts
that agree in one of ``BANDS`` bands of ``ROWS`` minimum hashes follow: a pair at 0.8 agrees in none
with a chance of 3e-6, a closer pair with less. In a bucket the first texts are compared with all
later ones that do not belong to their component yet.

What lies behind them goes on only where a bucket holds more than one component, and then not by
its bands: texts meet in shingles, the rarest first. Two texts link only if from the first shingle
they share, in that order, each holds as many shingles as the link needs, so a text meets others in
its rarest fifth only, and one with many shingles of its own meets none. So a large group of near
copies costs a few comparisons a text, texts beside it are not compared with each of its members,
and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinframe.llm import simhash
from clinframe.llm.common import apart, components, shuffle_tasks
from clinframe.schema import col
from clinframe.session import stored

#: Words of a shingle.
WIDTH = 5
#: Least similarity of a link, as a fraction.
SHARED, OF = 4, 5
#: Bands, and minimum hashes of a band.
BANDS, ROWS = 32, 5
#: Texts of a bucket that are compared with all later ones in the first round, and their growth.
LEADERS, GROWTH = 4, 8
#: Rows up to which a table of row keys is broadcast.
SMALL = 1_000_000
#: Shingles hashed at once, and pairs of one batch.
PIECE, PAIRS = 1024, 1 << 16

_DRAW = np.random.Generator(np.random.PCG64(20))
_SALTS, _FACTORS = _DRAW.integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_FACTORS |= np.uint64(1)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33))


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").decode("utf-8", "surrogateescape").lower().encode("utf-8", "surrogateescape").split()


def _mixed(x: np.ndarray) -> np.ndarray:
    for factor in _MIX[:2]:
        x = (x ^ (x >> _MIX[2])) * factor
    return x ^ (x >> _MIX[2])


def _shingles(words: list[bytes]) -> np.ndarray:
    """Distinct hashes of all shingles, in order; a shorter text is one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(WIDTH, len(each))
    count = len(each) - width + 1
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out = _mixed(out ^ each[k : k + count]) + np.uint64(k)
    return np.unique(out)


def _band_keys(shingles: np.ndarray) -> list[int]:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), PIECE):
        np.minimum(least, ((shingles[start : start + PIECE] ^ _SALTS) * _FACTORS).min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    keys = np.fromiter((xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)), np.uint64, BANDS)
    return keys.view(np.int64).tolist()


def _marks(column: pa.Array) -> pa.Array:
    node, size, keys = [], [], []
    for value in column:
        words = _words(value.as_py())
        shingles = _shingles(words)
        node.append(xxhash.xxh64_intdigest(b" ".join(words), 7))
        size.append(len(shingles))
        keys.append(_band_keys(shingles) if len(shingles) else [])
    nodes = np.array(node, np.uint64).view(np.int64)
    return pa.StructArray.from_arrays(
        [pa.array(nodes), pa.array(size, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["node", "size", "keys"]
    )


def _sets(column: pa.Array) -> pa.Array:
    return pa.array([_shingles(_words(v.as_py())).tobytes() for v in column], pa.binary())


def _members(column: pa.Array) -> pa.Array:
    return pa.array([np.frombuffer(v.as_py(), np.int64) for v in column], pa.list_(pa.int64()))


def _alike(a: pa.Array, b: pa.Array) -> pa.Array:
    def one(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return OF * both >= SHARED * (len(x) + len(y) - both)

    return pa.array([one(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], pa.bool_())


def _candidates(batches: Iterator[pa.RecordBatch], leaders: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, size, rest, label) sorted by (key, node): pairs of the first ``leaders`` texts
    of each bucket with later ones that have another label and can share enough of what the bucket
    leaves of them, ``rest``, and the texts behind them, marked open. Holds one batch and the leaders
    of one bucket."""

    def out(a, b, key, size, rest, is_open):
        columns = [np.asarray(x, np.int64) for x in (a, b, key, size, rest)]
        return pa.RecordBatch.from_arrays(
            [*map(pa.array, columns), pa.array(np.full(len(a), is_open))], ["a", "b", "key", "size", "rest", "open"]
        )

    none = [np.empty(0, np.int64)] * 4
    last_key, held = None, none
    for batch in batches:
        key, *own = (np.asarray(c.to_numpy(zero_copy_only=False), np.int64) for c in batch.columns)
        if not len(key):
            continue
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, ends = np.append(0, cut), np.append(cut, len(key))
        goes_on = last_key == key[0]
        todo = ends - starts > 1
        todo[0] |= goes_on
        todo[-1] = True
        pairs, waiting, count = [], [], 0
        for r in np.flatnonzero(todo):
            before = held if r == 0 and goes_on else none
            rows = [x[starts[r] : ends[r]] for x in own]
            known = len(before[0])
            new = max(0, min(leaders - known, len(rows[0])))
            lead = [np.concatenate([h, x[:new]]) for h, x in zip(before, rows, strict=True)]
            for k in range(known + new):
                node, size, rest, label = (x[max(0, k - known + 1) :] for x in rows)
                enough = (OF + SHARED) * np.minimum(rest, lead[2][k]) >= SHARED * (size + lead[1][k])
                fits = np.flatnonzero((label != lead[3][k]) & enough)
                if len(fits):
                    pairs.append((np.full(len(fits), lead[0][k]), node[fits]))
                    count += len(fits)
                if count > PAIRS:
                    a, b = map(np.concatenate, zip(*pairs, strict=True))
                    yield out(a, b, a, a, a, False)
                    pairs, count = [], 0
            if new < len(rows[0]):
                waiting.append(np.arange(starts[r] + new, ends[r]))
            if r == len(starts) - 1:
                last_key, held = key[-1], lead
        if pairs:
            a, b = map(np.concatenate, zip(*pairs, strict=True))
            yield out(a, b, a, a, a, False)
        if waiting:
            at = np.concatenate(waiting)
            yield out(own[0][at], own[0][at], key[at], own[1][at], own[2][at], True)


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(SMALL + 1).count() <= SMALL else keys


def _sets_of(nodes: DataFrame, classes: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """Rows (node, set) of the distinct ``nodes``."""
    needed = stored(classes.select("node", "_row").join(nodes, "node"))
    found = rows.select("_row", text).join(_few(needed), "_row")
    return stored(found.select("node", F.arrow_udf(_sets, "binary")(F.col(text).cast("binary")).alias("set")).dropDuplicates(["node"]))


def _links(pairs: DataFrame, classes: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """The ``pairs`` (a, b) that are alike, from the whole sets of their texts."""
    met = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets_of(met, classes, rows, text)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return stored(both.where(F.arrow_udf(_alike, "boolean")("set_a", "set_b")).select("a", "b"))


def _by_fingerprint(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts within ``simhash.BITS`` of each other: texts of one fingerprint meet its
    first one, and first ones meet along the edges of their fingerprints."""
    heads = stored(classes.groupBy("fp").agg(F.min("node").alias("head")))
    same = classes.select("fp", "node").join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    near = simhash.near_edges(heads.select("fp"))
    for end in ("a", "b"):
        named = heads.select(F.col("fp").alias(end), F.col("head").alias(f"head_{end}"))
        near = near.join(named, end)
    return stored(same.unionByName(near.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b"))))


def _by_rare_shingles(nodes: DataFrame, classes: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """Rows (key, node, size, rest) for each shingle in which one of the distinct ``nodes`` can meet
    another that it links to: shingles rise by the number of nodes that hold them, and ``rest`` counts
    those of the node that others hold too, from this one on."""
    sets = _sets_of(nodes, classes, rows, text)
    size = F.floor(F.octet_length("set") / 8).cast("int").alias("size")
    each = sets.select("node", size, F.explode(F.arrow_udf(_members, "array<long>")("set")).alias("key"))
    shared = each.join(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")
    falling = Window.partitionBy("node").orderBy(F.desc("n"), F.desc("key"))
    ranked = shared.withColumn("rest", F.row_number().over(falling)).where(F.col("rest") * OF >= F.col("size") * SHARED)
    return ranked.select("key", "node", "size", "rest")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) with further ``links`` (a, b). Components are looked for between labels
    only: what has one label already is not gone through again."""
    for end in ("a", "b"):
        named = labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
        links = links.join(named, end, "left")
    ends = [F.coalesce(f"label_{end}", end).alias(end) for end in ("a", "b")]
    moved = stored(components(links.select(*ends)))
    if moved.isEmpty():
        return labels
    now = moved.select(F.col("node").alias("label"), F.col("label").alias("now"))
    kept = labels.join(now, "label", "left").select("node", F.coalesce("now", "label").alias("label"))
    return stored(kept.unionByName(moved.join(labels.select("node"), "node", "left_anti")))


def _labels(classes: DataFrame, rows: DataFrame, text: str, leaders: int) -> DataFrame:
    """Rows (node, label) of all texts that link to another."""
    spark = classes.sparkSession
    labels = stored(components(_links(_by_fingerprint(classes), classes, rows, text)))

    def labelled(open_: DataFrame) -> DataFrame:
        return open_.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    open_ = labelled(classes.select("node", "size", "keys"))
    open_ = open_.select(F.explode("keys").alias("key"), "node", "size", F.col("size").alias("rest"), "label")
    by_bands = True
    while True:
        dealt = open_.select("key", "node", "size", "rest", "label").repartition(shuffle_tasks(spark), "key")
        found = stored(
            dealt.sortWithinPartitions("key", "node").mapInArrow(
                lambda x, leaders=leaders: _candidates(x, leaders),
                "a long, b long, key long, size long, rest long, open boolean",
            )
        )
        pairs = stored(found.where("not open").select("a", "b").distinct())
        labels = _joined(labels, _links(pairs, classes, rows, text))
        left = found.where("open").select("key", F.col("a").alias("node"), "size", "rest")
        if left.isEmpty():
            return labels
        left = labelled(left)
        mixed = left.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        open_ = stored(left.join(mixed.select("key"), "key", "left_semi"))
        if open_.isEmpty():
            return labels
        if by_bands:
            open_ = labelled(_by_rare_shingles(open_.select("node").distinct(), classes, rows, text))
            by_bands = False
        leaders *= GROWTH


def _row_key(docs: DataFrame) -> Column:
    """Two hashes of a row's columns, but for those with maps, as one text."""
    names = [col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    own = [*names, *[n.isNull() for n in names]]
    return F.concat(*[F.hex(F.xxhash64(F.lit(seed), *own)) for seed in (1, 2)])


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", leaders: int = LEADERS) -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest doc_id, a null one
    being the last.

    Null and empty texts are copies of each other. Rows are judged one by one, so rows that share a
    doc_id, or have none, stay or go by their own text; of repeated rows one stays. An empty table
    stays empty, further columns of any name stay as they are.
    """
    docs, whole_rows = apart(docs, (doc_id, text))
    marks = F.arrow_udf(_marks, "struct<node: long, size: int, keys: array<long>>")
    rows = docs.withColumn("_row", _row_key(docs))
    marked = rows.select(
        "_row", F.col(doc_id).alias("id"), marks(F.col(text).cast("binary")).alias("m"), simhash.fingerprint(F.col(text), WIDTH).alias("fp")
    )
    marked = stored(marked.select("_row", "id", "m.node", "m.size", "m.keys", "fp"))
    classes = stored(marked.select("node", "_row", "size", "keys", "fp").dropDuplicates(["node"]))
    labels = _labels(classes, rows, text, leaders)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "node", "_row")
    named = marked.select("_row", "id", "node").join(labels, "node", "left")
    named = stored(named.select("_row", F.coalesce("label", "node").alias("label"), place.alias("place")))
    first = named.groupBy("label").agg(F.min("place").alias("first"))
    judged = stored(named.join(first, "label").select("_row", (F.col("place") > F.col("first")).alias("later")))
    later = stored(judged.where("later").select("_row").distinct())
    again = stored(judged.where("not later").groupBy("_row").count().where("count > 1").select("_row"))
    kept = rows.join(_few(later), "_row", "left_anti")
    if not again.isEmpty():
        once = kept.join(again, "_row", "left_semi").dropDuplicates(["_row"])
        kept = kept.join(again, "_row", "left_anti").unionByName(once)
    return whole_rows(kept)

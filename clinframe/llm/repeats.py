"""Remove passages that an earlier document already holds, by longest-previous-factor arrays.

A byte goes when it lies in a string of ``LENGTH`` bytes that also starts in a document with a
smaller id. With all suffixes in lexicographic order, the nearest suffixes above and below that
belong to a smaller document (previous and next smaller positions) share the longest earlier match
with it, its longest previous factor. Only factors of ``LENGTH`` bytes matter here, so suffixes
are cut to that length and ties are put in the order of documents: the next smaller position then
never shares all bytes, and the previous one does exactly when a run of equal suffixes begins with
a smaller document.

The suffix order is built in buckets that no match can leave: each suffix goes to the bucket of its
minimizer, the ``GRAM`` bytes within it of smallest hash. Equal suffixes have equal minimizers. The
minimizers alone are shuffled first (about one per ``(LENGTH - GRAM) / 2`` bytes); only where two
documents share one are the suffixes around it shuffled too.

Both shuffles are combined before them, as a common line puts one minimizer into very many documents.
A task that sees a minimizer in several documents sends two of its places under it and spreads the
others, which need no answer any more. A stretch of suffixes that a task has seen in an earlier
document goes whole there, and only the span is sent on, spread too.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinframe.llm.common import shuffle_tasks, shuffles_freed
from clinframe.session import stored

LENGTH = 50
GRAM = 20
#: Bytes looked at together; a longer text is taken in pieces.
PIECE = 1 << 20
#: Rows of one bucket that are ordered at once; a larger bucket is taken in parts.
BUCKET = 20_000
#: Stretches of suffixes a task takes together, and those it remembers to find copies of.
STRETCHES, REMEMBERED = 50_000, 100_000
#: Stands for a null id: after all others.
NO_ID = 2**63 - 1
#: Bits of a place with its run, and of the tag above them: part of the text's CRC where the id is null,
#: so that not all rows without an id share one list of places.
PLACE_BITS, TAG_BITS = 41, 22

_REACH = LENGTH - GRAM + 1
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` = 20 bytes at each place."""
    h1 = data.astype(np.uint64) + np.uint64(1)
    h2 = h1[:-1] * _FACTORS[0] + h1[1:]
    h4 = h2[:-2] * _FACTORS[1] + h2[2:]
    h8 = h4[:-4] * _FACTORS[2] + h4[4:]
    h16 = h8[:-8] * _FACTORS[3] + h8[8:]
    h = h16[:-4] * _FACTORS[4] + h4[16:]
    h ^= h >> np.uint64(31)
    h *= _FACTORS[0]
    h ^= h >> np.uint64(29)
    return h


def _hashes_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``_gram_hashes`` at some places only."""
    h = np.lib.stride_tricks.sliding_window_view(data, GRAM)[at].astype(np.uint64) + np.uint64(1)
    h = h[:, 0::2] * _FACTORS[0] + h[:, 1::2]
    h4 = h[:, 0::2] * _FACTORS[1] + h[:, 1::2]
    h8 = h4[:, [0, 2]] * _FACTORS[2] + h4[:, [1, 3]]
    h = (h8[:, 0] * _FACTORS[3] + h8[:, 1]) * _FACTORS[4] + h4[:, 4]
    h ^= h >> np.uint64(31)
    h *= _FACTORS[0]
    h ^= h >> np.uint64(29)
    return h


def _spread(*values: np.ndarray) -> np.ndarray:
    """A key that parts rows evenly."""
    out = np.zeros(len(values[0]), np.uint64)
    for value in values:
        out = (out ^ value.astype(np.uint64)) * _FACTORS[0]
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _minimizers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and for each suffix of ``LENGTH`` bytes the place of its first smallest one."""
    hashes = _gram_hashes(data)
    least, place = hashes, np.arange(len(hashes), dtype=np.int32)
    for step in (1, 2, 4, 8, _REACH - 16):
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.where(right, least[step:], least[:-step])
    return hashes, place


def _runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For texts that lie at ``starts``..``ends`` of ``data``: text number, minimizer hash, its
    place, first suffix and number of suffixes, for each run of suffixes with one minimizer.
    Places count from the text's start."""
    first = 0
    while first < len(starts):
        if ends[first] - starts[first] > PIECE:
            for at in range(starts[first], ends[first] - LENGTH + 1, PIECE):
                stop = min(at + PIECE + LENGTH - 1, ends[first])
                for run in _piece_runs(data, np.array([at]), np.array([stop])):
                    yield np.full(len(run[1]), first), run[1], run[2] + at - starts[first], run[3] + at - starts[first], run[4]
            first += 1
            continue
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE, "right")))
        for run in _piece_runs(data, starts[first:last], ends[first:last]):
            yield run[0] + first, *run[1:]
        first = last


def _piece_runs(data, starts, ends):
    base = starts[0]
    piece = data[base : ends[-1]]
    if len(piece) < LENGTH:
        return
    hashes, place = _minimizers(piece)
    lengths = ends - starts
    text = np.repeat(np.arange(len(starts)), lengths)[: len(place)]
    inside = np.arange(len(place)) + LENGTH <= (ends - base)[text]
    change = np.flatnonzero((place[1:] != place[:-1]) | (inside[1:] != inside[:-1]) | (text[1:] != text[:-1])) + 1
    at = np.concatenate([[0], change])
    count = np.diff(np.append(at, len(place)))
    keep = inside[at]
    at, count = at[keep], count[keep]
    if len(at):
        number = text[at]
        offset = (starts - base)[number]
        yield number, hashes[place[at]].view(np.int64), place[at] - offset, at - offset, count


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large binary column, and where its values begin and end."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, ...) -> (hash, doc, place), one row per run.

    ``place`` also tells the run's first suffix and number of suffixes (five bits each: both lie within
    ``LENGTH - GRAM`` of the minimizer). Of a hash that several documents of a piece have, the first and
    the last document send one row; the others are known to be shared: their place is inverted and
    their hash replaced by one that spreads them."""
    for batch in batches:
        doc = batch.column(0).to_numpy(zero_copy_only=False)
        data, at = _bytes_of(batch.column(1))
        tag = np.zeros(len(doc), np.int64)
        for i in np.flatnonzero(doc == NO_ID):
            tag[i] = zlib.crc32(data[at[i] : at[i + 1]]) & ((1 << TAG_BITS) - 1)
        for number, hashes, place, first, count in _runs(data, at[:-1], at[1:]):
            owner = doc[number]
            packed = (tag[number] << PLACE_BITS) | (place.astype(np.int64) << 10) | ((place - first).astype(np.int64) << 5) | (count - 1)
            order = np.argsort(hashes, kind="stable")
            h, owner, packed = hashes[order], owner[order], packed[order]
            begin = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
            size = np.diff(np.append(begin, len(h)))
            several = np.minimum.reduceat(owner, begin) != np.maximum.reduceat(owner, begin)
            if several.any():
                known = np.flatnonzero(np.repeat(several, size))
                by = known[np.lexsort((owner[known], h[known]))]
                inner = np.concatenate([[False], (h[by][1:-1] == h[by][:-2]) & (h[by][1:-1] == h[by][2:]), [False]])
                by = by[inner]
                h[by] = _spread(h[by], owner[by], packed[by])
                packed[by] = ~packed[by]
            yield pa.RecordBatch.from_pydict({"h": h, "doc": owner, "place": packed})


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, doc, place) sorted by h -> (doc, place) of hashes that two documents have.
    Holds the rows of one document at a hash."""
    held = [np.zeros(0, np.int64)] * 3
    open_hash = None  # a hash known to be shared, whose rows go out as they come
    for batch in batches:
        h, doc, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        known = place < 0
        if known.any():
            yield pa.RecordBatch.from_pydict({"doc": doc[known], "place": ~place[known]})
        h, doc, place = (np.concatenate([x, y[~known]]) for x, y in zip(held, (h, doc, place), strict=True))
        if not len(h):
            continue
        starts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
        ends = np.append(starts[1:], len(h))
        shared = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
        if open_hash is not None and h[0] == open_hash:
            shared[0] = True
        open_hash = h[-1] if shared[-1] else None
        out = np.repeat(shared, ends - starts)
        yield pa.RecordBatch.from_pydict({"doc": doc[out], "place": place[out]})
        left = starts[-1] if open_hash is None else len(h)
        held = [x[left:] for x in (h, doc, place)]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, key, text, places) -> (h, doc, key, first suffix, number of suffixes, their bytes).

    A stretch that an earlier document has, as far as the task remembers, is answered: such rows are
    spans, have the span's length, negative, in place of the number, and no bytes. Places of another
    row with the same id only add suffixes that this text has, too."""
    seen: dict[bytes, int] = {}
    for batch in batches:
        doc, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        data, at = _bytes_of(batch.column(2))
        places = batch.column(3)
        packed = places.flatten().to_numpy(zero_copy_only=False) & ((1 << PLACE_BITS) - 1)
        number = np.repeat(np.arange(len(doc)), places.value_lengths().to_numpy(zero_copy_only=False))
        order = np.lexsort((packed, doc[number]))
        block = data[at[0] : at[-1]].tobytes()
        for part in range(0, len(order), STRETCHES):
            rows = order[part : part + STRETCHES]
            text, place, count = number[rows], packed[rows] >> 10, (packed[rows] & 31) + 1
            first = place - (packed[rows] >> 5 & 31)
            fits = first + count - 1 + LENGTH <= (at[1:] - at[:-1])[text]
            text, place, first, count = text[fits], place[fits], first[fits], count[fits]
            if not len(text):
                continue
            begin, owners = at[text] + first, doc[text]
            stop = first + count - 1 + LENGTH
            pieces = [block[b:e] for b, e in zip((begin - at[0]).tolist(), (at[text] + stop - at[0]).tolist(), strict=True)]
            gone = np.zeros(len(text), bool)
            if len(seen) > REMEMBERED:
                seen.clear()
            for i, (piece, owner) in enumerate(zip(pieces, owners.tolist(), strict=True)):
                earliest = seen.setdefault(piece, owner)
                if earliest < owner:
                    gone[i] = True
                elif earliest > owner:
                    seen[piece] = owner
            sent = np.flatnonzero(~gone)
            h = _hashes_at(data, at[text[sent]] + place[sent]).view(np.int64)
            yield pa.RecordBatch.from_pydict(
                {"h": h, "doc": owners[sent], "key": key[text[sent]], "first": first[sent], "n": count[sent], "bytes": pa.array([pieces[i] for i in sent.tolist()], pa.binary())}
            )
            answered = np.flatnonzero(gone)
            if len(answered):
                text, first, stop = text[answered], first[answered], stop[answered]
                apart = np.concatenate([[True], (text[1:] != text[:-1]) | (first[1:] > stop[:-1])])
                edge = np.flatnonzero(apart)
                start, stop = first[edge], np.maximum.reduceat(stop, edge)
                owner = doc[text[edge]]
                yield pa.RecordBatch.from_pydict(
                    {"h": _spread(owner, start), "doc": owner, "key": key[text[edge]], "first": start, "n": start - stop, "bytes": pa.array([b""] * len(edge), pa.binary())}
                )


class _Bucket:
    """What is known of a bucket that is taken in parts: its distinct suffixes with their first
    documents, and the number and first document of each stretch of text."""

    def __init__(self):
        self.words, self.doc = np.zeros((0, 7), np.uint64), np.zeros(0, np.int64)
        self.seen: dict[bytes, int] = {}
        self.first = np.zeros(0, np.int64)


def _previous(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Suffixes, as big-endian words, of documents: the smallest document with the same suffix,
    found as the head of its run in suffix order."""
    order = np.lexsort((doc, *words.T[::-1]))
    sorted_ = words[order]
    head = np.concatenate([[True], (sorted_[1:] != sorted_[:-1]).any(axis=1)])
    out = np.empty(len(doc), np.int64)
    out[order] = doc[order][np.maximum.accumulate(np.where(head, np.arange(len(doc)), 0))]
    return out


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_suffixes`` sorted by (h, doc) -> (doc, key, from, to) of the bytes to remove.
    Holds about ``BUCKET`` rows; of a larger bucket also its distinct suffixes."""
    held: pa.RecordBatch | None = None
    past, past_hash = _Bucket(), None

    def solve(rows: pa.RecordBatch, keep: bool) -> Iterator[pa.RecordBatch]:
        h, doc, key, first, n = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("h", "doc", "key", "first", "n"))
        # A stretch that an earlier document has as it is goes whole; only the others are ordered.
        data, at = _bytes_of(rows.column("bytes"))
        block, ends = data[at[0] : at[-1]].tobytes(), (at - at[0]).tolist()
        seen = past.seen if keep else {}
        codes = np.array([seen.setdefault(block[i:j], len(seen)) for i, j in zip(ends[:-1], ends[1:], strict=True)], np.int64)
        known = past.first if keep else past.first[:0]
        owner = np.concatenate([known, np.full(len(seen) - len(known), NO_ID)])
        np.minimum.at(owner, codes, doc)
        if not keep:
            begin = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
            several = np.repeat(np.minimum.reduceat(codes, begin) != np.maximum.reduceat(codes, begin), np.diff(np.append(begin, len(h))))
        else:
            past.first, several = owner, np.ones(len(h), bool)
        whole = owner[codes] < doc
        if whole.any():
            w = np.flatnonzero(whole)
            yield pa.RecordBatch.from_pydict(
                {"doc": doc[w], "key": key[w], "start": first[w], "stop": first[w] + n[w] - 1 + LENGTH}
            )
        rest = np.flatnonzero(several & ~whole)
        if not len(rest):
            return
        rows = rows.take(pa.array(rest))
        doc, key, first, n = doc[rest], key[rest], first[rest], n[rest]
        data, at = _bytes_of(rows.column("bytes"))
        row = np.repeat(np.arange(len(doc)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        padded = np.zeros((len(row), 56), np.uint8)
        padded[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at[:-1][row] + step]
        words = padded.view(">u8").astype(np.uint64)
        owners = doc[row]
        if keep:
            both = np.concatenate([past.words, words]), np.concatenate([past.doc, owners])
            earlier = _previous(*both)[len(past.doc) :]
            new = np.concatenate([past.words, words[earlier == owners]])
            owner = np.concatenate([past.doc, owners[earlier == owners]])
            _, only = np.unique(new, axis=0, return_index=True)
            past.words, past.doc = new[only], owner[only]
        else:
            earlier = _previous(words, owners)
        gone = earlier < owners
        edge = np.flatnonzero(gone & ~(np.append(False, gone[:-1]) & np.append(False, row[1:] == row[:-1])))
        stop = np.flatnonzero(gone & ~(np.append(gone[1:], False) & np.append(row[1:] == row[:-1], False)))
        if len(edge):
            r = row[edge]
            yield pa.RecordBatch.from_pydict(
                {"doc": doc[r], "key": key[r], "start": first[r] + step[edge], "stop": first[r] + step[stop] + LENGTH}
            )

    for batch in batches:
        n = batch.column("n").to_numpy(zero_copy_only=False)
        if (n < 0).any():
            spans = batch.filter(pa.array(n < 0))
            start = spans.column("first").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"doc": spans.column("doc"), "key": spans.column("key"), "start": start, "stop": start - n[n < 0]})
            batch = batch.filter(pa.array(n >= 0))
            if not batch.num_rows:
                continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        h = rows.column("h").to_numpy(zero_copy_only=False)
        if past_hash is not None:
            same = int(np.searchsorted(h != past_hash, True))
            if same:
                yield from solve(rows.slice(0, same), True)
            rows, h = rows.slice(same), h[same:]
            if not len(h):
                held = None
                continue
            past, past_hash = _Bucket(), None
        last = len(h) - int(np.argmax(h[::-1] != h[-1])) if h[0] != h[-1] else 0
        if last:
            yield from solve(rows.slice(0, last), False)
        held = rows.slice(last)
        if held.num_rows > BUCKET:
            past_hash = h[-1]
            yield from solve(held, True)
            held = None
    if held is not None and held.num_rows:
        yield from solve(held, False)


def _joined(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of rows, those that overlap or touch made one."""
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    # The furthest end so far within the row: rows are set apart by more than any place.
    apart = row * np.int64(1 << 32)
    reach = np.maximum.accumulate(stop + apart)
    new = np.concatenate([[True], (start + apart)[1:] > reach[:-1]])
    edge = np.flatnonzero(new)
    return row[edge], start[edge], (reach - apart)[np.append(edge[1:], len(row)) - 1]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, key, text, spans) -> (doc, key, n_removed, n_spans, sha of what stays)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        data, at = _bytes_of(batch.column(2))
        spans = batch.column(3)
        flat = spans.flatten()
        start, stop = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop"))
        row, start, stop = _joined(np.repeat(np.arange(n), spans.value_lengths().to_numpy(zero_copy_only=False)), start, stop)
        bounds = np.searchsorted(row, np.arange(n + 1))
        removed = np.add.reduceat(np.append(stop - start, 0), bounds[:-1])
        shas = []
        for i, (first, last) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            text, kept, done = data[at[i] : at[i + 1]], hashlib.sha256(), 0
            for j in range(first, last):
                kept.update(text[done : start[j]])
                done = stop[j]
            kept.update(text[done:])
            shas.append(kept.hexdigest())
        yield pa.RecordBatch.from_pydict(
            {"doc": batch.column(0), "key": batch.column(1), "n_removed": removed.astype(np.int64), "n_spans": np.diff(bounds).astype(np.int64), "kept_sha256": shas}
        )


def _sorted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.repartition(shuffle_tasks(rows.sparkSession), by[0]).sortWithinPartitions(*by)


def removed_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ``docs`` (doc, key, text binary): candidate rows (doc, key, text), and their spans
    (doc, key, start, stop), which may overlap."""
    anchors = docs.select("doc", "text").mapInArrow(_anchors, "h long, doc long, place long")
    shared = stored(_sorted(anchors, "h").mapInArrow(_shared, "doc long, place long"))
    places = shared.groupBy("doc", F.shiftright("place", PLACE_BITS).alias("tag")).agg(F.collect_list("place").alias("places"))
    tag = F.when(F.col("doc") == NO_ID, F.crc32("text").bitwiseAND((1 << TAG_BITS) - 1)).otherwise(F.lit(0).cast("long"))
    rows = stored(docs.withColumn("tag", tag).join(places, ["doc", "tag"]).select("doc", "key", "text", "places"))
    found = rows.mapInArrow(_suffixes, "h long, doc long, key long, first long, n long, bytes binary")
    spans = _sorted(found, "h", "doc").mapInArrow(_matches, "doc long, key long, start long, stop long")
    return rows.select("doc", "key", "text"), stored(spans)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null counts as empty. Rows with equal ids do not count as earlier than
    one another; rows with a null id come after all others. Other columns are not read.
    """
    data: Column = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(data).alias("key"),
        data.alias("text"),
    )
    with shuffles_freed(docs.sparkSession):
        candidates, spans = removed_spans(rows.select("doc", "key", "text"))
        spans = spans.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
        once = candidates.join(spans, ["doc", "key"]).select("doc", "key", "text", "spans")
        cut = stored(once.mapInArrow(_cut, "doc long, key long, n_removed long, n_spans long, kept_sha256 string").distinct())
    whole = rows.select("doc_id", "doc", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    none = F.lit(0).cast("long")
    return whole.join(cut, ["doc", "key"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )

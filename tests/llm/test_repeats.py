"""Earlier passages are removed exactly as brute force over all 50-byte strings would."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa

from clinframe.llm import repeats


def brute(docs):
    """(doc_id, text) -> sorted result rows."""
    order = sorted({i for i, _ in docs if i is not None})
    first = {}
    for i, text in docs:
        data = (text or "").encode()
        rank = order.index(i) if i is not None else len(order)
        for p in range(len(data) - 49):
            w = data[p : p + 50]
            first[w] = min(first.get(w, rank), rank)
    out = []
    for i, text in docs:
        data = (text or "").encode()
        rank = order.index(i) if i is not None else len(order)
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if first[data[p : p + 50]] < rank:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 5)))
    shared = [" ".join(word() for _ in range(rng.randint(12, 60))) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            text = rng.choice(shared) if rng.random() < 0.5 else " ".join(word() for _ in range(20))
            if rng.random() < 0.3:
                cut = rng.randint(0, len(text))
                text = text[cut:] + "x" + text[:cut]
            parts.append(text)
        docs.append((i, "".join(parts)))
    docs += [(7, docs[3][1]), (3, docs[3][1]), (3, docs[3][1]), (None, shared[0]), (None, shared[0] + "z"), (80, None), (81, "")]
    docs += [(90, "a" * 500), (91, "a" * 49), (92, "a" * 50), (93, "ab" * 200), (94, "b" + "ab" * 100), (5, "x" * 20)]
    rng.shuffle(docs)
    return docs


def test_matches_brute_force(spark):
    docs = corpus(1)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_removed int").repartition(3)
    got = sorted((tuple(r) for r in repeats.remove_repeats(df).collect()), key=str)
    assert got == brute(docs)


def test_pieces_and_large_buckets(monkeypatch):
    """The task functions by themselves, with tiny bounds."""
    monkeypatch.setattr(repeats, "PIECE", 64)
    monkeypatch.setattr(repeats, "BUCKET", 5)
    docs = [(i if i is not None else repeats.NO_ID, (t or "").encode()) for i, t in corpus(2)]
    batch = lambda rows, names: pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)})
    cut = lambda b: [b.slice(k, 3) for k in range(0, b.num_rows, 3)]
    flat = lambda parts, names: pa.Table.from_batches([p for p in parts if p.num_rows]).select(names)
    anchors = flat(repeats._anchors(iter([batch(docs, ("doc", "text"))])), ["h", "doc", "place"])
    shared = flat(repeats._shared(iter(anchors.sort_by([("h", "ascending"), ("doc", "ascending")]).combine_chunks().to_batches(3))), ["doc", "place"]).to_pylist()
    places = {}
    for row in shared:
        places.setdefault(row["doc"], []).append(row["place"])
    wanted = [(d, k, t, places[d]) for k, (d, t) in enumerate(docs) if d in places]
    found = flat(repeats._suffixes(iter([batch(wanted, ("doc", "key", "text", "places"))])), ["h", "doc", "key", "first", "n", "bytes"])
    ordered = found.sort_by([("h", "ascending"), ("doc", "ascending")]).combine_chunks().to_batches(3)
    spans = {}
    for part in repeats._matches(iter(ordered)):
        for row in part.to_pylist():
            spans.setdefault(row["key"], []).append((row["start"], row["stop"]))
    expected = brute([(None if d == repeats.NO_ID else d, t.decode()) for d, t in docs])
    got = []
    for k, (d, t) in enumerate(docs):
        gone = np.zeros(len(t), bool)
        for start, stop in spans.get(k, ()):
            gone[start:stop] = True
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        got.append((None if d == repeats.NO_ID else d, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    assert sorted(got, key=str) == expected


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(df).collect() == []

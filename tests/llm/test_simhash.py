"""Fingerprints and components against their definition."""

from __future__ import annotations

import random

import pytest
import xxhash

from clinframe.llm import simhash
from clinframe.llm.common import components


def fingerprint(text, width=3):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def groups(fps):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 3:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_documents(spark):
    rng = random.Random(3)
    base = " ".join(rng.choice(["Über", "and", "THE", "x\x0by", "café", "z"]) + str(rng.randint(0, 99)) for _ in range(300))
    docs = [(i, base.replace(" ", "  ", i) + (" end" if i % 3 == 0 else "")) for i in range(6)]
    docs += [(10, None), (11, ""), (12, " \t\n"), (13, "one"), (14, "one two"), (None, base), (None, "alone"), (13, "one"), (20, "w " * 70000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, fp string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
    fps = [fingerprint(t) for _, t in docs]
    named = groups(fps)
    first = [min((docs[j][0] for j in range(len(docs)) if named[j] == g and docs[j][0] is not None), default=None) for g in named]
    assert got == sorted(((i, f, c) for (i, _), f, c in zip(docs, fps, first, strict=True)), key=str)


@pytest.mark.parametrize("bucket", [3, simhash.BUCKET])
def test_links_do_not_depend_on_the_bucket_bound(spark, bucket):
    rng = random.Random(5)
    fps = set()
    for _ in range(8):
        centre = rng.getrandbits(64)
        for _ in range(30):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r["node"]: r["label"] for r in components(simhash.near_edges(df, bucket)).collect()}
    want = groups(fps)
    assert [got.get(x, x) for x in fps] == [fps[g] for g in want]


def test_components_of_paths_and_empty_tables(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 90), (90, 90)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []

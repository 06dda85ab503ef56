"""Outputs against a plain rebuild from characters, and the exact round trip."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinframe.llm import infill as I

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text, words=True):
    text = text or ""
    units = TOKEN.findall(text) if words else list(text)
    name = "" if doc_id is None else doc_id
    digits = hashlib.sha256(f"42:{name}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def samples():
    rng = random.Random(3)
    letters = ["a", "b", " ", "  ", "\n", "\t", "\x0b", "\x1f", "\x85", "\xa0", "é", "語", "🙂", "<", ">", "P>", "\r\n"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    return texts + ["", None, " ", "<P>", "x <M> y", "<<S", "a" * 70000, "é b" * 30000]


@pytest.mark.parametrize("words", [True, False])
def test_equals_plain_rebuild(spark, words):
    rows = [(i, t, "x") for i, t in enumerate(samples())] + [(None, "a b c", "y"), (None, "a b c", "y"), (7, "other", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, infill string")
    made = I.fill_in_middle(docs, words=words).select("*", I.restored(F.col("infill.output"), F.col("infill.form")).alias("back"))
    got = made.collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r["infill"]) == plainly(r["doc_id"], r["text"], words)
        assert r["back"] == (r["text"] or "")
    assert {r["infill"]["form"] for r in got} == {"plain", "psm", "spm"}
    assert I.fill_in_middle(docs.limit(0)).collect() == []


def test_exceptions_convert_both_ways():
    text = "aé語🙂z" * 5
    index = I.Exceptions(np.frombuffer(text.encode(), np.uint8))
    assert len(index.bytes) == 15
    for k in range(len(text) + 1):
        at = len(text[:k].encode())
        assert index.to_bytes(k) == at and index.to_chars(at) == k
    assert len(I.Exceptions(np.frombuffer(b"plain ascii", np.uint8)).bytes) == 0


def test_rates(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    counts = {r["f"]: r["count"] for r in I.fill_in_middle(docs, rate=90, spm=10).groupBy(F.col("infill.form").alias("f")).count().collect()}
    assert abs(counts["plain"] - 400) < 80 and abs(counts["spm"] - 360) < 80

"""Top-k against plain inner products."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from clinframe.llm import bitsliced


def brute(rows, k=5):
    ok = [(i, tuple(math.floor(Fraction(x) * 256) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in set(r for r in ok if r[0] % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("chunk", [2, 4096])
def test_matches_brute_force(spark, chunk):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(16)]) for i in range(400)]
    rows += [(i, [0.25] * 16) for i in range(400, 440)] + [(450, [0.0] * 16), (500, [-3.5] * 16), (550, [0.5] * 16)]
    rows += [(600, None), (601, [None] * 16), (602, [math.nan] * 16), (603, [math.inf] * 16), (None, [0.3] * 16)]
    rows += [(650, [0.1, 0.2]), (651, [0.3, -0.4]), (700, []), (701, []), (13, [0.2] * 16), (13, [0.2] * 16)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = sorted(tuple(r) for r in bitsliced.top_k(df, F.col("vec_id") % 50 == 0, chunk=chunk).collect())
    assert got == brute(rows)


def test_components_of_any_size(spark):
    rng = random.Random(5)
    big = [70000.0, -(2.0**20), 2.0**40 + 0.25, -(2.0**61), 1e30, -1e300]
    rows = [(i, [rng.choice([*big, 0.0, rng.gauss(0, 1)]) if rng.random() < 0.3 else rng.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    rows += [(250, [70000.0, 1.0, 0.0, 0.0]), (251, [70000.0, 1.0, 0.0, 0.0]), (300, [0.5, 0.0, 0.0, 0.0]), (301, [2.0, 1e308, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in bitsliced.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(q, n, j, min(max(s, -(2**63)), 2**63 - 1)) for q, n, j, s in brute(rows)]


def test_few_rows_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], schema)
    assert [tuple(r) for r in bitsliced.top_k(one, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 128 * 256 + 128 * 512)]
    assert bitsliced.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).collect() == []

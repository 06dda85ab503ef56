"""Neighbours within a radius against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from clinframe.operators.radius import patient_radius

TYPE = "record_id long, vector array<double>"


def brute(rows, radius):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows])
    squared = np.round(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0), 10)
    out = []
    for k in range(len(rows)):
        near = [i for i in range(len(rows)) if i != k and squared[k, i] <= round(radius * radius, 10)]
        out.append((ids[k], len(near), min((ids[i] for i in near), default=None)))
    return sorted(out, key=str)


def test_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(v) for v in rng.normal(size=4)]) for k in range(400)]
    rows += [(500 + k, rows[k][1]) for k in range(30)] + [(600, rows[0][1]), (7, rows[3][1]), (7, [9.0, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, TYPE)
    for radius in (0.0, 0.7, 1.5, 50.0):
        facts = {}
        got = sorted((tuple(r) for r in patient_radius(df, radius, block=16, visitors=32, report=facts).collect()), key=str)
        assert got == brute(rows, radius)
        assert facts["points"] == 401 and facts["largest_block"] <= 16


def test_one_cell_with_half_of_the_rows(spark):
    """A dense ball far from the rest: its cell is cut into shells, and few of them are visited."""
    rng = np.random.default_rng(2)
    rows = [(k, [float(v) for v in rng.normal(size=3) * 0.05 + 20]) for k in range(600)]
    rows += [(600 + k, [float(v) for v in rng.uniform(-10, 10, size=3)]) for k in range(600)]
    facts = {}
    got = patient_radius(spark.createDataFrame(rows, TYPE), 0.02, pivots=6, block=20, visitors=64, hot_rows=200, report=facts)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 0.02)
    assert facts["largest_block"] <= 20 and facts["visits"] < 1200 * facts["blocks"] / 4


def test_cells_are_not_smaller_than_blocks(spark):
    """Where all rows are neighbours nothing is ruled out, and each row visits every block."""
    rng = np.random.default_rng(4)
    rows = [(k, [float(v) for v in rng.normal(size=8)]) for k in range(600)]
    facts = {}
    got = patient_radius(spark.createDataFrame(rows, TYPE), 50.0, block=100, report=facts)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 50.0)
    assert facts["blocks"] <= 2 * 600 / 100 and facts["visits"] <= 600 * facts["blocks"]


def test_copies_and_odd_rows(spark):
    same = [(k, [0.5, -0.0]) for k in range(50)]
    odd = [(None, [0.5, 0.0]), (100, None), (101, [1.0]), (102, [None, 1.0]), (103, [float("nan"), 0.0]), (104, [0.5, 1.0])]
    df = spark.createDataFrame([(*r, 3, "x") for r in same + odd], f"{TYPE}, neighbours int, point string")
    got = {r["record_id"]: tuple(r)[1:] for r in patient_radius(df, 0.25, hot_rows=10).collect()}
    assert got[0] == (49, 1) and got[1] == (49, 0) and got[104] == (0, None)
    assert all(got[k] == (None, None) for k in (None, 100, 101, 102, 103))
    assert patient_radius(df.limit(0), 1.0).collect() == []


def test_text_ids(spark):
    df = spark.createDataFrame([("b", [0.0]), ("a", [0.1]), ("c", [0.2])], "record_id string, vector array<float>")
    got = {tuple(r) for r in patient_radius(df, 0.11).collect()}
    assert got == {("a", 2, "b"), ("b", 1, "a"), ("c", 1, "a")}


@pytest.mark.parametrize("tasks", [1, 7])
def test_partitions_change_nothing(spark, tasks):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(k, [float(v) for v in rng.normal(size=2)]) for k in range(200)], TYPE)
    first = sorted(map(tuple, patient_radius(df, 0.3).collect()), key=str)
    assert first == sorted(map(tuple, patient_radius(df.repartition(tasks), 0.3).collect()), key=str)

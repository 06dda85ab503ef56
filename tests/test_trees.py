"""Tables of fitted trees, scores along their paths and contributions that add up."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from clinframe.operators import models, trees
from clinframe.queries.models import FOREST

FEATURES = ("a", "b.c", "d")


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        a, b, d = rng.random(), rng.choice([0.0, 1.0, 2.0]), rng.gauss(0, 1)
        rows.append((k, a, b, d, 3 * (a > 0.5) + b * d + rng.gauss(0, 0.1), float(a + d > 0.5), "x"))
    return spark.createDataFrame(rows, "id long, a double, `b.c` double, d double, y double, z double, tree string").cache()


@pytest.mark.parametrize("task", ["los", "outcome"])
def test_fitted_trees(spark, data, task):
    label = "y" if task == "los" else "z"
    model = models.fit_gbt(data, FEATURES, label, task=task, trees=7, depth=3)
    nodes = trees.tree_table(spark, model)
    assert nodes.where("parent is null").count() == 7
    assert nodes.where("parent is null and cover = 300").count() == 7
    scores = {r["id"]: r["score"] for r in trees.tree_scores(data, "id", FEATURES, nodes).collect()}
    for r in models.score(model, data, FEATURES).collect():
        want = r["p"] if task == "los" else math.log(r["p"] / (1 - r["p"])) / 2
        assert math.isclose(scores[r["id"]], want, rel_tol=1e-6, abs_tol=1e-6)
    expected = trees.expected_score(nodes).first()[0]
    added = trees.attribute_trees(data, "id", FEATURES, nodes)
    assert added.count() == 900
    for r in added.groupBy("id").agg(F.sum("weight").alias("w")).collect():
        assert math.isclose(r["w"] + expected, scores[r["id"]], abs_tol=1e-9)
    # The mean over the rows of the fit is the expected score.
    assert math.isclose(sum(scores.values()) / 300, expected, abs_tol=1e-6)
    # A table that other rows give back is that of the fit, when they are the same rows.
    again = trees.with_background(nodes, data, FEATURES)
    both = nodes.join(again.select("tree", "node", F.col("value").alias("v"), F.col("cover").alias("c")), ["tree", "node"])
    assert both.where("abs(value - v) > 1e-9 or cover != c").count() == 0


def test_by_hand(spark):
    nodes = spark.createDataFrame(list(FOREST), trees.NODE)
    rows = [(1, 10.0, 0.0, -1.0, 0.0, 50.0), (2, 130.0, 50.0, None, 0.0, 10.0), (3, None, 45.0, 0.0, 0.0, float("nan"))]
    df = spark.createDataFrame(rows, "id long, f0 double, f1 double, f2 double, f3 double, f4 double")
    names = [f"f{k}" for k in range(5)]
    scores = {r["id"]: round(r["score"], 9) for r in trees.tree_scores(df, "id", names, nodes).collect()}
    assert scores == {1: -1.5 - 0.3, 2: 4.0 + 0.8, 3: 4.0 - 0.3}
    known = trees.with_background(nodes, df, names)
    value = {(r["tree"], r["node"]): (round(r["value"], 9), r["cover"]) for r in known.collect()}
    assert value[0, 0] == (round((-1.5 + 4 + 4) / 3, 9), 3.0) and value[0, 5] == (2.0, 0.0) and value[0, 1] == (-1.5, 1.0)
    got = {(r["id"], r["position"]): round(r["weight"], 6) for r in trees.attribute_trees(df, "id", names, known).collect()}
    assert got[1, 0] == round(-1.5 - 6.5 / 3, 6) and got[1, 2] == 0 and got[1, 3] == 0
    assert trees.attribute_trees(df.limit(0), "id", names, known).collect() == []


def test_single_leaf(spark):
    nodes = spark.createDataFrame([(0, 0, None, None, None, None, None, 5.0, 2.5, 2.0)], trees.NODE)
    df = spark.createDataFrame([(1, 3.0)], "id long, a double")
    assert trees.tree_scores(df, "id", ["a"], nodes).first()["score"] == 5.0
    assert trees.attribute_trees(df, "id", ["a"], nodes).first()["weight"] == 0.0

"""Fitted trees as a table of nodes, and what each feature adds to a row's score along its paths.

A node table has one row per node: ``tree, node, parent, feature, cut, left, right, cover, value,
weight``. ``feature`` is the position of the feature that is compared, NULL at a leaf; values up to
``cut`` go left, others and missing ones right. ``value`` is the mean score below the node,
``weight`` the factor of the tree. The score of a row is the weighted sum of its leaves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.operators.sequence import values
from clinframe.operators.skew import BROADCAST_ROWS
from clinframe.schema import col
from clinframe.session import materialise, scratch

NODE = "tree int, node int, parent int, feature int, cut double, left int, right int, cover double, value double, weight double"


def tree_table(spark: SparkSession, model) -> DataFrame:
    """The nodes of fitted boosted trees, read from the model as Spark ML writes it.

    Boosted trees are regression trees on residuals: the prediction that Spark keeps at a node is
    the mean over the training rows below it, which are its cover.
    """
    path = scratch(spark)
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    weights = spark.createDataFrame([(k, float(w)) for k, w in enumerate(model.treeWeights)], "treeID int, weight double")
    d = F.col("nodeData")
    inner = d["leftChild"] >= 0
    nodes = data.join(F.broadcast(weights), "treeID").select(  # one row per tree
        F.col("treeID").cast("int").alias("tree"),
        d["id"].alias("node"),
        F.when(inner, d["split"]["featureIndex"]).alias("feature"),
        F.when(inner, F.get(d["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("cut"),
        F.when(inner, d["leftChild"]).alias("left"),
        F.when(inner, d["rightChild"]).alias("right"),
        d["rawCount"].cast("double").alias("cover"),
        d["prediction"].alias("value"),
        "weight",
    )
    child = F.explode(F.array("left", "right")).alias("node")
    parents = nodes.where("left is not null").select("tree", F.col("node").alias("parent"), child)
    return materialise(nodes.join(parents, ["tree", "node"], "left").select(*[f.split()[0] for f in NODE.split(", ")]))


def _walk(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` (with an array ``_x``) for every tree, with the nodes ``_n0`` (a root), ``_n1``, … of
    its path as structs; behind a leaf they are NULL. Also the number of steps.

    A step is a join with the nodes, broadcast where their count allows, so the steps of a row run
    in one task. Only the depth of the trees comes to the driver.
    """
    below = nodes.where("parent is null").select("tree", "node")
    depth = 0
    links = nodes.where("parent is not null").select("tree", "parent", "node")
    while not below.isEmpty():
        below = materialise(below.withColumnRenamed("node", "parent").join(links, ["tree", "parent"]).select("tree", "node"))
        depth += 1
    few = nodes.count() <= BROADCAST_ROWS
    side = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    fields = F.struct("feature", "cut", "left", "right", "value", "weight")
    named = nodes.select("tree", "node", fields.alias("_f"))
    roots = nodes.where("parent is null").select("tree", fields.alias("_n0"))
    trees = F.explode(F.lit([r["tree"] for r in roots.select("tree").distinct().collect()]).cast("array<int>"))
    out = rows.select("*", trees.alias("tree")).join(side(roots), "tree")
    for step in range(1, depth):
        n = F.col(f"_n{step - 1}")
        goes_left = F.coalesce(F.get("_x", n["feature"]) <= n["cut"], F.lit(False))
        following = F.when(goes_left, n["left"]).otherwise(n["right"])
        out = out.withColumn("_to", F.when(n["feature"].isNotNull(), following))
        known = named.select("tree", F.col("node").alias("_to"), F.col("_f").alias(f"_n{step}"))
        out = out.join(side(known), ["tree", "_to"], "left").drop("_to")
    return out, max(depth, 1)


def _leaf(steps: int) -> Column:
    return F.coalesce(*[F.col(f"_n{k}") for k in reversed(range(steps))])


def _with_values(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumn("_x", values(features))


def tree_scores(df: DataFrame, key: str, features: Sequence[str], nodes: DataFrame) -> DataFrame:
    """``(key, score)``: the weighted sum of the leaves that a row falls into. Keys are unique."""
    walked, steps = _walk(_with_values(df, features).select(col(key), "_x"), nodes)
    leaf = _leaf(steps)
    return walked.groupBy(col(key)).agg(F.sum(leaf["value"] * leaf["weight"]).alias("score"))


def with_background(nodes: DataFrame, background: DataFrame, features: Sequence[str]) -> DataFrame:
    """``nodes`` with cover and value from other rows than those of the fit: how many rows of
    ``background`` pass a node, and the mean of the leaves they reach. Nodes that none passes keep
    their value and get cover 0; leaves keep their value."""
    walked, steps = _walk(_with_values(background, features).select("_x"), nodes)
    leaf = _leaf(steps)["value"]
    inner = [F.col(f"_n{k}") for k in range(steps)]
    # The node a step stands at: the root's number is known by its tree, all others by the step before.
    at = [F.lit(None).cast("int")]
    for n in inner[:-1]:
        goes_left = F.coalesce(F.get("_x", n["feature"]) <= n["cut"], F.lit(False))
        at.append(F.when(n["feature"].isNotNull(), F.when(goes_left, n["left"]).otherwise(n["right"])))
    passed = F.array(*[F.struct(n.isNotNull().alias("there"), a.alias("node"), leaf.alias("leaf")) for n, a in zip(inner, at, strict=True)])
    each = walked.select("tree", F.inline(passed)).where("there")
    seen = each.groupBy("tree", "node").agg(F.count(F.lit(1)).cast("double").alias("_cover"), F.avg("leaf").alias("_value"))
    roots = nodes.where("parent is null").select("tree", F.col("node").alias("root"))
    seen = seen.join(roots, "tree").select("tree", F.coalesce("node", "root").alias("node"), "_cover", "_value")
    out = nodes.join(seen, ["tree", "node"], "left")
    value = F.when(F.col("feature").isNull(), F.col("value")).otherwise(F.coalesce("_value", "value"))
    out = out.withColumn("value", value).withColumn("cover", F.coalesce("_cover", F.lit(0.0)))
    return materialise(out.select(nodes.columns))


def expected_score(nodes: DataFrame) -> DataFrame:
    """One row ``expected``: the score before any feature is known, that of the roots."""
    return nodes.where("parent is null").agg(F.coalesce(F.sum(F.col("value") * F.col("weight")), F.lit(0.0)).alias("expected"))


def attribute_trees(df: DataFrame, key: str, features: Sequence[str], nodes: DataFrame) -> DataFrame:
    """``(key, feature, position, value, weight)``: what each feature adds to the score of a row.

    Along the path of a tree, a step from a node to its child changes the mean score; the change
    belongs to the feature that the node compares. The weights of a row add up to its score less
    :func:`expected_score`. Features that no path compares have 0. Keys are unique. Contributions
    are added up where a row was walked before they are shuffled: one row per key and feature.
    """
    walked, steps = _walk(_with_values(df, features).select(col(key), "_x"), nodes)
    n = [F.col(f"_n{k}") for k in range(steps)]
    moves = [F.struct(a["feature"].alias("position"), ((b["value"] - a["value"]) * a["weight"]).alias("w")) for a, b in zip(n, n[1:])]
    nothing = F.array(F.struct(F.lit(None).cast("int").alias("position"), F.lit(None).cast("double").alias("w")))
    each = walked.select(col(key), F.inline(F.array(*moves) if moves else nothing)).where("w is not null")
    sums = each.groupBy(col(key), "position").agg(F.sum("w").alias("weight"))
    given = _with_values(df, features).select(col(key), F.posexplode("_x").alias("position", "value"))
    named = F.element_at(F.array(*map(F.lit, features)), F.col("position") + 1)
    joined = given.join(sums, [key, "position"], "left")
    return joined.select(col(key), named.alias("feature"), "position", "value", F.coalesce("weight", F.lit(0.0)).alias("weight"))

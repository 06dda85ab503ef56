"""Splits without leakage, trimmed statistics, scaling and encoding on edge frames."""

from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from clinframe.operators import scale, split
from clinframe.schema import VisitSchema
from clinframe.sources.visits import select_schema

SCHEMA = VisitSchema(key="id", time="t", tiebreak=("n",), targets=("y",), numeric=("a",))


def labels(spark, sizes):
    data = [(f"{label}-{k}", label) for label, n in sizes.items() for k in range(n)]
    return spark.createDataFrame(data, "id string, label int")


@pytest.mark.parametrize("limit", [10**9, 20])
def test_split_is_exhaustive_disjoint_and_proportional(spark, limit):
    df = labels(spark, {0: 333, 1: 97})
    out = split.stratified_split(df, "id", "label", 0.2, 0.25, seed=3, hot_rows=limit)
    got = {(r["split"], r["label"]): r["n"] for r in out.groupBy("split", "label").agg(F.count("*").alias("n")).collect()}
    assert sum(got.values()) == 430
    assert got["test", 0] + got["test", 1] == math.ceil(0.2 * 430)
    assert got["val", 0] + got["val", 1] == math.ceil(0.25 * (430 - 86))
    assert abs(got["test", 1] - 0.2 * 97) <= 1
    assert split.shared_ids(out, "id").first()[0] == 0
    again = split.stratified_split(df.repartition(9), "id", "label", 0.2, 0.25, seed=3)
    assert rows(out) == rows(again.select(out.columns))
    other = split.stratified_split(df, "id", "label", 0.2, 0.25, seed=4)
    assert rows(out) != rows(other)


def test_lonely_stratum_and_fraction_of_nothing(spark):
    out = split.stratified_split(labels(spark, {0: 9, 1: 1}), "id", "label", 0.0, 0.0)
    assert {r["split"] for r in out.collect()} == {"train"}


def test_shared_ids_sees_a_leak(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "val")], "id string, split string")
    assert split.shared_ids(df, "id").first()[0] == 1


def test_record_label_first_and_last(spark):
    df = spark.createDataFrame(
        [("a", 1, 1, 0.0), ("a", 1, 2, 1.0), ("b", 5, 1, None), ("b", 6, 1, 1.0)],
        "id string, t int, n int, y double",
    )
    assert rows(split.record_label(df, SCHEMA, "first")) == [("a", 0.0), ("b", None)]
    assert rows(split.record_label(df, SCHEMA, "last")) == [("a", 1.0), ("b", 1.0)]


def test_selections(spark):
    df = spark.createDataFrame([(k,) for k in range(10)], "id int")
    ids = spark.createDataFrame([(1,), (1,), (3,)], "id int")
    assert split.exclude(df, ids, "id").count() == 8
    assert rows(split.rows_of(df, ids, "id")) == [(1,), (3,)]
    for limit in (10**9, 3):
        assert rows(split.every_nth(df, "id", 2, 3, limit)) == [(4,), (6,), (8,)]


@pytest.mark.parametrize("group_rows", [10**9, 0])
def test_trimmed_stats_cell_by_cell(spark, group_rows):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=400), rng.exponential(size=400)
    a[::7] = np.nan
    data = [(None if math.isnan(x) else float(x), float(y), 5.0, None) for x, y in zip(a, b)]
    df = spark.createDataFrame(data, "a double, `b.c` double, same double, none double")
    features = ["a", "b.c", "same", "none"]
    got = {r["feature"]: r for r in scale.fit_trimmed_stats(df, features, group_rows=group_rows).collect()}
    for name, x in (("a", a[~np.isnan(a)]), ("b.c", b)):
        kept = x[(x > np.quantile(x, 0.05)) & (x < np.quantile(x, 0.95))]
        assert got[name]["mean"] == pytest.approx(kept.mean())
        assert got[name]["std"] == pytest.approx(kept.std(ddof=1))
        assert got[name]["median"] == pytest.approx(np.median(kept))
        fill = (np.median(kept) - kept.mean()) / (kept.std(ddof=1) + 1e-12)
        assert got[name]["default_fill"] == pytest.approx(fill)
    for name in ("same", "none"):
        assert [got[name][c] for c in ("mean", "std", "median", "default_fill")] == [0.0] * 4


def test_zscore_clip_and_inverse(spark):
    train = spark.createDataFrame([(float(k),) for k in range(101)], "a double")
    stats = scale.fit_trimmed_stats(train, ["a"])
    other = spark.createDataFrame([(None,), (50.0,), (1e9,)], "a double")
    z = scale.zscore(other, stats, ["a"])
    clipped = [r[0] for r in scale.clip_outliers(z, ["a"]).collect()]
    assert clipped[0] is None and clipped[1] == pytest.approx(0.0) and clipped[2] == 0.0
    fit = stats.first()
    back = z.select(scale.invert_scale(F.col("a"), F.lit(fit["mean"]), F.lit(fit["std"])))
    assert back.collect()[1][0] == pytest.approx(50.0)


def test_los_info(spark):
    data = [(f"p{k}", k % 3, 0, float(k)) for k in range(100)] + [("p5", 9, 0, 200.0)]
    df = spark.createDataFrame(data, "id string, t int, n int, los double")
    stats = scale.fit_trimmed_stats(df, ["los"])
    got = scale.los_info(df, SCHEMA, stats, "los").first()
    stays = np.array([200.0 if k == 5 else float(k) for k in range(100)])
    p5, p95 = np.percentile(stays, [5, 95])
    assert got["large_los"] == pytest.approx(p95)
    assert got["threshold"] == pytest.approx(stays[(stays >= p5) & (stays <= p95)].mean() * 0.5)
    assert got["los_mean"] == pytest.approx(stats.first()["mean"])


def test_one_hot_round_trip(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "id int, `cat x` string")
    out = scale.one_hot(df, ["cat x"])
    assert out.columns == ["id", "cat x->a", "cat x->b"]
    assert rows(out) == [(1, 0.0, 1.0), (2, 0.0, 0.0), (3, 1.0, 0.0)]
    words = out.select("id", scale.decode_one_hot(["cat x->a", "cat x->b"]))
    assert rows(words) == [(1, "b"), (2, "unknown"), (3, "a")]
    # A level only in the test split has its column when levels are learnt on all data.
    assert "cat x->a" in scale.one_hot(df.where("id = 1"), ["cat x"], levels={"cat x": ["a", "b"]}).columns


def test_too_many_levels_is_an_error(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        scale.one_hot(df, ["c"], levels=scale.observed_levels(df, ["c"], limit=10))


def test_drop_all_null(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1.0, None)], "id int, a double, b double")
    assert rows(scale.drop_all_null(df, ["a", "b"]).select("id")) == [(2,)]


def test_select_schema_builds_key_and_drops_nan(spark):
    df = spark.createDataFrame([("p", 7, 1, float("nan"), "1")], "pid string, adm int, t int, a double, y string")
    schema = VisitSchema(key="id", time="t", patient="pid", admission="adm", targets=("y",), numeric=("a",))
    assert rows(select_schema(df, schema)) == [("p_7", "p", 1, 1.0, None)]

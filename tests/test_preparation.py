"""A fitted preparation survives saving, equals the direct path, and defines what it has not seen."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from clinframe.operators import scale, sequence
from clinframe.operators.preparation import Preparation, PreparationModel
from clinframe.schema import VisitSchema

SCHEMA = VisitSchema(key="id", time="t", numeric=("a.b", "c"), categorical=("kind",))
TYPES = "id string, t int, `a.b` double, c double, kind string"


def visits(spark):
    data = [(f"p{k % 7}", k, None if k % 3 == 0 else float(k * k % 31), float(k), "xy"[k % 2]) for k in range(80)]
    return spark.createDataFrame(data, TYPES)


@pytest.fixture
def loaded(spark, tmp_path):
    path = str(tmp_path / "model")
    Preparation(SCHEMA).fit(visits(spark)).write().save(path)
    return PreparationModel.load(path)


def test_loaded_model_equals_the_direct_path(spark, loaded):
    df = visits(spark)
    stats = scale.fit_trimmed_stats(df, ["a.b", "c"])
    coded = scale.one_hot(df, ["kind"])
    shape = SCHEMA.with_levels(("kind->x", "kind->y"))
    scaled = scale.clip_outliers(scale.zscore(coded, stats, ["a.b", "c"]), ["a.b", "c"])
    want = sequence.forward_fill(scaled, shape, stats=stats)
    got = loaded.transform(df)
    assert loaded.encoded_schema() == shape
    assert rows(got.drop("unseen_levels").select(*[f"`{c}`" for c in want.columns])) == rows(want)
    assert got.agg(F.sum("unseen_levels")).first()[0] == 0
    assert rows(loaded.table(spark)) == rows(stats.select("feature", "lo", "hi", "mean", "std", "median", "default_fill"))


def test_later_visits_with_new_levels_and_gaps(spark, loaded):
    later = spark.createDataFrame([("new", 1, None, 1e9, "z"), ("new", 2, 3.0, None, None), ("new", 3, None, 5.0, "x")], TYPES)
    got = sorted(loaded.transform(later).collect(), key=lambda r: r["t"])
    fit = {r["feature"]: r for r in loaded.table(spark).collect()}
    assert [r["unseen_levels"] for r in got] == [1, 0, 0]
    assert [(r["kind->x"], r["kind->y"]) for r in got] == [(0.0, 0.0), (0.0, 0.0), (1.0, 0.0)]
    assert got[0]["a.b"] == fit["a.b"]["default_fill"] and got[2]["a.b"] == got[1]["a.b"]
    # Far outliers are clipped to zero, and a gap takes the last value, not the fill.
    assert got[0]["c"] == got[1]["c"] == 0.0


def test_estimator_is_saved_too(spark, tmp_path):
    path = str(tmp_path / "estimator")
    Preparation(SCHEMA, trim=(0.1, 0.9)).write().save(path)
    again = Preparation.load(path)
    assert again.shape() == SCHEMA and again.getOrDefault("lo") == 0.1
    assert again.fit(visits(spark)).getOrDefault("levels") == {"kind": ["x", "y"]}


def test_empty_training_table(spark):
    model = Preparation(SCHEMA).fit(visits(spark).where("false"))
    got = model.transform(visits(spark).where("t < 2"))
    assert sorted(r["unseen_levels"] for r in got.collect()) == [1, 1]
    assert not [c for c in got.columns if c.startswith("kind")]

"""Exact quantiles: the distributed path agrees with numpy on awkward distributions."""

from __future__ import annotations

import numpy as np
import pytest

from clinframe.operators import quantiles
from clinframe.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
RNG = np.random.default_rng(7)
SAMPLES = {
    "normal": RNG.normal(size=3000),
    "outliers": np.concatenate([RNG.normal(size=2000), [1e12, -1e12, 5e11]]),
    "ties": RNG.integers(0, 5, size=2500).astype(float),
    "mostly_one_value": np.concatenate([np.full(1500, 3.0), RNG.normal(size=300)]),
    "constant": np.full(100, 2.5),
    "single": np.array([4.0]),
    "two": np.array([1.0, 2.0]),
    "small": np.arange(10.0),
}


@pytest.fixture(scope="module")
def frame(spark):
    data = [(name, float(v)) for name, values in SAMPLES.items() for v in values]
    data += [("normal", None), ("empty", None)]
    return spark.createDataFrame(data, "g string, v double").repartition(6).cache()


def found(df):
    return {(r["g"], r["prob"]): r["value"] for r in df.collect()}


@pytest.mark.parametrize("group_rows", [10**9, 0])
@pytest.mark.parametrize("tiny", [50_000, 0])
def test_against_numpy(frame, monkeypatch, group_rows, tiny):
    monkeypatch.setattr(quantiles, "TINY", tiny)
    if tiny == 0:
        # Without the open ends brackets must still hold once groups are large enough.
        data = frame.where("g in ('normal', 'outliers', 'ties', 'mostly_one_value', 'constant')")
        monkeypatch.setattr(quantiles, "SKETCH", 1000)
    else:
        data = frame
    got = found(exact_quantiles(data, ["v"], PROBS, ["g"], group_rows))
    for name, values in SAMPLES.items():
        for p in PROBS:
            if (name, p) in got:
                assert got[name, p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)
    assert ("normal", 0.5) in got and got.get(("empty", 0.5)) is None


@pytest.mark.parametrize("group_rows", [10**9, 0])
def test_ungrouped_with_missing_column(frame, group_rows):
    from pyspark.sql import functions as F

    df = frame.where("g = 'normal'").withColumn("none", F.lit(None).cast("double"))
    got = {(r["feature"], r["prob"]): r["value"] for r in exact_quantiles(df, ["v", "none"], [0.3], (), group_rows).collect()}
    assert got["v", 0.3] == pytest.approx(np.quantile(SAMPLES["normal"], 0.3))
    assert got["none", 0.3] is None


@pytest.mark.parametrize("group_rows", [10, 10**9])
def test_groups_without_values_and_without_name_are_listed(spark, group_rows):
    data = [("a", float(k), None) for k in range(30)] + [(None, float(-k), 1.0) for k in range(20)] + [("c", None, None)] * 15
    df = spark.createDataFrame(data, "g string, x double, y double")
    got = exact_quantiles(df, ["x", "y"], [0.25, 0.5], ["g"], group_rows=group_rows)
    want = [
        ("a", "x", 0.25, 7.25), ("a", "x", 0.5, 14.5), ("a", "y", 0.25, None), ("a", "y", 0.5, None),
        ("c", "x", 0.25, None), ("c", "x", 0.5, None), ("c", "y", 0.25, None), ("c", "y", 0.5, None),
        (None, "x", 0.25, -14.25), (None, "x", 0.5, -9.5), (None, "y", 0.25, 1.0), (None, "y", 0.5, 1.0),
    ]
    assert sorted(map(str, map(tuple, got.select("g", "feature", "prob", "value").collect()))) == sorted(map(str, want))

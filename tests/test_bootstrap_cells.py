"""Draws per cell follow the Poisson law, and agree with draws per row."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinframe.operators import bootstrap, metrics


def test_normal_quantile(spark):
    u = [1e-9, 0.001, 0.02425, 0.1, 0.5, 0.8413447460685429, 0.99, 1 - 1e-9]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in u], "u double").select(bootstrap.normal_quantile(F.col("u"))).collect()]
    for v, z in zip(u, got, strict=True):
        assert math.isclose(0.5 * math.erfc(-z / math.sqrt(2)), v, rel_tol=1e-6)


@pytest.mark.parametrize("n", [1, 2, 37, 100, 101, 5000, 10**9])
def test_draws_follow_the_law(spark, n):
    """Mean, variance and skewness of 40,000 draws of one cell."""
    cells = spark.range(1).select(F.lit(n).cast("bigint").alias("_rows"))
    known = bootstrap.poisson_table(spark).withColumnRenamed("rows", "_rows")
    one = cells.join(known, "_rows", "left").crossJoin(spark.range(40000))
    u = F.col("id") / 40000 + 0.5 / 40000
    x = np.array([r[0] for r in one.select(bootstrap.poisson_quantile(u, F.col("_rows"), F.col("below"))).collect()], float)
    assert abs(x.mean() - n) < 0.02 * math.sqrt(n)
    assert abs(x.var() / n - 1) < 0.02
    assert abs(((x - n) ** 3).mean() / n**1.5 - 1 / math.sqrt(n)) < 0.03
    assert (np.diff(x) >= 0).all()


def test_exact_counts_up_to_the_bound(spark):
    for row in bootstrap.poisson_table(spark).where("rows in (1, 3, 100)").collect():
        n, below = row
        for k in range(min(2 * n + 3, len(below))):
            want = sum(math.exp(-n + j * math.log(n) - math.lgamma(j + 1)) for j in range(k + 1))
            assert math.isclose(below[k], want, rel_tol=1e-9)


def preds(spark):
    rows = [(k, k % 3 == 0 and 1 or 0, (k * 7 % 10) / 10 + (0.05 if k % 3 == 0 else 0)) for k in range(6000)]
    return spark.createDataFrame(rows, "id long, y int, p double")


def test_agrees_with_rows(spark):
    df = preds(spark)
    names = ("accuracy", "f1", "auroc", "auprc", "minpse")
    by_cell = {r["metric"]: r for r in bootstrap.bootstrap_cells(df, metrics.binary_metrics, names).collect()}
    by_row = {r["metric"]: r for r in bootstrap.bootstrap(df, metrics.binary_metrics, names, ["id"]).collect()}
    for name in names:
        assert abs(by_cell[name]["mean"] - by_row[name]["mean"]) < 0.6 * by_row[name]["std"]
        assert 0.7 < by_cell[name]["std"] / by_row[name]["std"] < 1.4


def test_cells_and_seeds(spark):
    df = preds(spark)
    sample = bootstrap.cell_resamples(df, ["y", "p"]).collect()
    assert len(sample) <= 100 * df.select("y", "p").distinct().count()
    total = np.zeros(101)
    for r in sample:
        total[r["replicate"]] += r["weight"]
    assert abs(total[1:].mean() - 6000) < 50 and 40 < total[1:].std() < 130
    again = bootstrap.cell_resamples(df.repartition(5), ["y", "p"]).collect()
    assert sorted(map(tuple, sample)) == sorted(map(tuple, again))
    assert sorted(map(tuple, sample)) != sorted(map(tuple, bootstrap.cell_resamples(df, ["y", "p"], seed=7).collect()))


def test_odd_cells(spark):
    df = spark.createDataFrame([(None, 0.5), (None, 0.5), (1, None), (1, float("nan"))], "y int, p double")
    got = bootstrap.cell_resamples(df, ["y", "p"], 20).collect()
    assert got and all(r["weight"] > 0 for r in got)
    assert bootstrap.cell_resamples(df.limit(0), ["y", "p"]).collect() == []

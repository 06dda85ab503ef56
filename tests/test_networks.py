"""Networks as tables: scores equal those of the model and of numpy; odd vectors have no score."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import plan_of
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from clinframe.operators import models, networks


def test_table_scores_like_the_model(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    data = [(k, row.tolist(), float(row[0] * row[1] > 0)) for k, row in enumerate(x)]
    df = spark.createDataFrame(data, "id int, features array<double>, label double")
    ready = df.withColumn("_v", array_to_vector("features"))
    model = MultilayerPerceptronClassifier(layers=[3, 5, 4, 2], featuresCol="_v", labelCol="label", maxIter=20, seed=3).fit(ready)
    units = networks.network_table(spark, model)
    assert units.count() == 5 + 4 + 2
    want = {r["id"]: r["p"] for r in models.score_vectors(model, ready).collect()}
    scored = networks.network_scores(df, units)
    assert scored.columns == [*df.columns, "p"]
    assert len(set(np.round(list(want.values()), 6))) > 10
    for r in scored.collect():
        assert r["p"] == pytest.approx(want[r["id"]], abs=1e-9)


def test_odd_vectors_and_extra_columns(spark):
    units = spark.createDataFrame([(0, 0, [1.0, -1.0], 0.5), (1, 1, [2.0], 0.0), (1, 0, [-1.0], 0.25)], networks.UNIT)
    data = [(1, [0.5, 2.0]), (2, None), (3, [1.0]), (4, [1.0, 2.0, 3.0]), (5, [None, 1.0]), (6, [900.0, -900.0])]
    df = spark.createDataFrame(data, "layer int, features array<double>")
    got = {r["layer"]: r["p"] for r in networks.network_scores(df, units).collect()}
    h = 1 / (1 + np.exp(-(0.5 - 2.0 + 0.5)))
    assert got[1] == pytest.approx(1 / (1 + np.exp((0.25 - h) - 2 * h)))
    assert [got[k] for k in (2, 3, 4, 5)] == [None] * 4
    assert got[6] == pytest.approx(1 / (1 + np.exp(-0.75 - 2)))
    assert networks.network_scores(df.where(F.lit(False)), units).count() == 0
    assert "Exchange" not in plan_of(networks.network_scores(df, units)).split("Subquery")[0]

"""Fitted layered networks as tables of units, and their scores in Column functions."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.schema import col

#: Schema of a table of units: one row per unit, its weights in the order of its inputs.
UNIT = "layer int, unit int, weights array<double>, bias double"


def network_table(spark: SparkSession, model) -> DataFrame:
    """Units of a fitted ``MultilayerPerceptronClassificationModel``; as many rows as the model has units."""
    flat, rows, at = model.weights.toArray(), [], 0
    for layer, (inputs, units) in enumerate(pairwise(model.getLayers())):
        weights = flat[at : at + inputs * units].reshape(inputs, units)
        bias = flat[at + inputs * units : at + (inputs + 1) * units]
        at += (inputs + 1) * units
        rows += [(layer, k, weights[:, k].tolist(), float(bias[k])) for k in range(units)]
    return spark.createDataFrame(rows, UNIT)


def _sum(values: Column, start: Column) -> Column:
    return F.aggregate(values, start, lambda a, v: a + v)


def network_scores(df: DataFrame, units: DataFrame, features: str = "features", p: str = "p") -> DataFrame:
    """Adds ``p``, the probability of class 1: sigmoid units in all layers but the last, softmax there.

    The table of units, as large as the model, enters as one scalar; rows are not shuffled. A missing
    vector, one with missing values or one of another length has a missing score.
    """
    layers = units.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("unit", "weights", "bias"))).alias("units"))
    last = layers.agg(F.max("layer")).first()[0]
    net = layers.agg(F.array_sort(F.collect_list(F.struct("layer", "units")))).scalar()
    out = df.withColumn("_net", net).withColumn("_x", col(features).cast("array<double>"))
    for layer in range(last + 1):
        of_layer = F.get("_net", F.lit(layer))["units"]
        # A vector of another length is padded with missing values on either side.
        sums = F.transform(of_layer, lambda u: _sum(F.zip_with(u["weights"], F.col("_x"), lambda w, x: w * x), u["bias"]))
        out = out.withColumn("_x", sums)
        if layer < last:
            out = out.withColumn("_x", F.transform("_x", lambda z: 1 / (1 + F.exp(-z))))
    wanted = F.get("_x", F.lit(1))
    score = 1 / _sum(F.transform("_x", lambda z: F.exp(z - wanted)), F.lit(0.0))
    return out.select(*map(col, df.columns), score.alias(p))

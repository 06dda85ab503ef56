"""Models fitted with Spark ML, linear attributions, and fusion of embeddings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.operators.metrics import best_checkpoint, ranking_metrics
from clinframe.operators.sequence import values
from clinframe.schema import col

#: Fixed values.
INVERSE_PENALTY = 1.0
WIDTHS = (16, 64, 256, 1024)


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds the feature vector. Takes any column name, also one with a dot."""
    return df.withColumn("_x", array_to_vector(values(features)))


def fit_logistic(
    train: DataFrame, features: Sequence[str], label: str, inverse_penalty: float = INVERSE_PENALTY
) -> LogisticRegressionModel:
    """Logistic regression with a quadratic penalty on the sum of losses."""
    rows = train.count()
    model = LogisticRegression(
        featuresCol="_x",
        labelCol=label,
        regParam=1.0 / (inverse_penalty * max(rows, 1)),
        elasticNetParam=0.0,
        standardization=False,
    )
    return model.fit(assembled(train, features))


def score(model, df: DataFrame, features: Sequence[str], p: str = "p") -> DataFrame:
    """Adds the probability of the positive class, or the value of a regression."""
    out = model.transform(assembled(df, features))
    if "probability" in out.columns:
        value: Column = F.get(vector_to_array("probability"), F.lit(1))
    else:
        value = F.col("prediction")
    return out.select(*map(col, df.columns), value.alias(p))


def fit_gbt(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    task: str = "outcome",
    trees: int = 50,
    depth: int = 5,
    step: float = 0.1,
    seed: int = 42,
):
    """Boosted trees: a classifier for ``outcome`` and ``readmission``, a regressor for ``los``."""
    kind = GBTRegressor if task == "los" else GBTClassifier
    model = kind(
        featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step, seed=seed
    )
    return model.fit(assembled(train, features))


def importances(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    """``(feature, importance)`` of fitted trees; importances add up to 1, or are all 0."""
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double")


def coefficients(model: LogisticRegressionModel) -> list[float]:
    """Weights of a fitted linear model, in feature order."""
    return [float(v) for v in model.coefficients]


def attribute_linear(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    weights: Sequence[float],
    background: DataFrame,
) -> DataFrame:
    """``(key, feature, position, value, weight)``: how far each feature moves the margin of a
    linear model away from the background's mean; exact for linear models."""
    means = background.agg(*[F.avg(col(f)).alias(f"m{i}") for i, f in enumerate(features)])
    out = df.withColumn("_bg", means.select(F.struct("*")).scalar())
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.lit(i).alias("position"),
                col(f).cast("double").alias("value"),
                (F.lit(float(w)) * (col(f) - F.col(f"_bg.m{i}"))).alias("weight"),
            )
            for i, (f, w) in enumerate(zip(features, weights, strict=True))
        ]
    )
    return out.select(col(key), F.inline(cells))


def fusion_features(
    ehr: Mapping[str, DataFrame], text: DataFrame, key: str, text_dim: int, vector: str = "vector"
) -> DataFrame:
    """``(key, features)``: the embeddings of all models followed by the text embedding, or by
    zeros for a record without text."""
    names = list(ehr)
    out = ehr[names[0]].select(col(key), col(vector).alias("_v0"))
    for i, name in enumerate(names[1:], start=1):
        out = out.join(ehr[name].select(col(key), col(vector).alias(f"_v{i}")), key)
    out = out.join(text.select(col(key), col(vector).alias("_t")), key, "left")
    empty = F.array_repeat(F.lit(0.0), text_dim)
    parts = [F.col(f"_v{i}").cast("array<double>") for i in range(len(names))]
    joined = F.concat(*parts, F.coalesce(F.col("_t").cast("array<double>"), empty))
    return out.select(col(key), joined.alias("features"))


def fit_fusion(
    train: DataFrame,
    val: DataFrame,
    features: str = "features",
    label: str = "label",
    widths: Sequence[int] = WIDTHS,
    iterations: int = 50,
    seed: int = 42,
):
    """One hidden layer over fused vectors, its width chosen by validation average precision.

    Returns the best model and the log ``(width, auprc)`` as a DataFrame. Each width is one
    Spark ML fit; the training data is read by the executors.
    """
    dim = train.select(F.size(col(features)).alias("n")).first()["n"]
    ready = train.select(array_to_vector(col(features)).alias("_x"), col(label).cast("double").alias("_y"))
    held = val.select(array_to_vector(col(features)).alias("_x"), col(label).cast("double").alias("y"))
    models, log = {}, None
    for width in widths:
        model = MultilayerPerceptronClassifier(
            layers=[dim, width, 2], featuresCol="_x", labelCol="_y", maxIter=iterations, seed=seed
        ).fit(ready)
        models[width] = model
        scored = score_vectors(model, held)
        row = ranking_metrics(scored).select(F.lit(width).alias("width"), "auprc")
        log = row if log is None else log.unionByName(row)
    best = best_checkpoint(log, [], "width", "auprc").first()
    return models[best["epoch"] if best else widths[0]], log


def score_vectors(model, df: DataFrame, p: str = "p") -> DataFrame:
    out = model.transform(df)
    return out.withColumn(p, F.get(vector_to_array("probability"), F.lit(1))).select(*df.columns, p)

"""Scores of predictions, as aggregates over a table of labels and predictions.

Every function takes ``by`` (one result per group) and, where it makes sense, ``weight``.
Ranking metrics first reduce to one row per distinct score; running totals over the scores
are sliced when a group has very many of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinframe.operators.skew import HOT_ROWS, running_sums, skewed_join
from clinframe.schema import col
from clinframe.session import stored

#: Fixed values.
THRESHOLD = 0.5
LOG_FLOOR = -100.0
EARLY_PENALTY = -0.1
DECAY_RATE = 0.1
REWARD_FACTOR = 0.1


def _weighted(weight: str | None) -> Column:
    return col(weight).cast("double") if weight else F.lit(1.0)


def score_histogram(
    df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p", weight: str | None = None
) -> DataFrame:
    """Weight of positives and negatives per distinct score."""
    w = _weighted(weight)
    return df.groupBy(*map(col, by), col(p).alias("score")).agg(
        F.sum(w * col(y)).alias("pos"), F.sum(w * (1 - col(y))).alias("neg")
    )


def curve(
    df: DataFrame,
    by: Sequence[str] = (),
    y: str = "y",
    p: str = "p",
    weight: str | None = None,
    hot_rows: int = HOT_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """One row per distinct score, taken as threshold: positives and negatives at it, those at
    or above it (``tp``, ``fp``) and all of them (``tp_total``, ``fp_total``).

    The histogram is written once, so that looking for large groups does not score twice. A
    caller that knows a bound for the ``largest`` group saves both.
    """
    scores = score_histogram(df, by, y, p, weight)
    if largest is None or largest > hot_rows:
        scores = stored(scores)
    return running_sums(
        scores,
        by,
        [("score", "desc")],
        {"tp": F.col("pos"), "fp": F.col("neg")},
        hot_rows,
        totals=True,
        largest=largest,
    )


def pr_curve(df: DataFrame, by: Sequence[str] = (), **options) -> DataFrame:
    """Precision and recall at every threshold."""
    return curve(df, by, **options).select(
        *map(col, by),
        "score",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide("tp", "tp_total").alias("recall"),
    )


def roc_curve(df: DataFrame, by: Sequence[str] = (), **options) -> DataFrame:
    """False and true positive rate at every threshold."""
    return curve(df, by, **options).select(
        *map(col, by),
        "score",
        F.try_divide("fp", "fp_total").alias("fpr"),
        F.try_divide("tp", "tp_total").alias("tpr"),
    )


def _class_metrics(threshold: float) -> dict[str, Column]:
    """Accuracy and F1 from (score, pos, neg) rows; positive means strictly above threshold."""
    above = F.col("score") > threshold
    tp = F.sum(F.when(above, F.col("pos")).otherwise(0.0))
    fp = F.sum(F.when(above, F.col("neg")).otherwise(0.0))
    pos, neg = F.sum("pos"), F.sum("neg")
    return {
        "accuracy": F.try_divide(tp + neg - fp, pos + neg),
        "f1": F.coalesce(F.try_divide(2 * tp, tp + fp + pos), F.lit(0.0)),
    }


def class_metrics(
    df: DataFrame,
    by: Sequence[str] = (),
    y: str = "y",
    p: str = "p",
    weight: str | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Accuracy and F1 at a threshold: one scan, no ordering."""
    w = _weighted(weight)
    scored = df.select(
        *map(col, by),
        col(p).alias("score"),
        (w * col(y)).alias("pos"),
        (w * (1 - col(y))).alias("neg"),
    )
    return scored.groupBy(*map(col, by)).agg(
        *[c.alias(n) for n, c in _class_metrics(threshold).items()]
    )


def ranking_columns() -> dict[str, Column]:
    """Aggregates over a :func:`curve`. Ties count half in ``auroc``; ``auprc`` is the average
    precision step sum; NULL where a class is missing."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    steps = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    weaker = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.col("tp_total"))
    return {
        "auroc": F.try_divide(area, F.sum("pos") * F.sum("neg")),
        "auprc": F.try_divide(steps, F.sum("pos")),
        "minpse": F.when(F.sum("pos") > 0, F.max(weaker)),
    }


def ranking_metrics(df: DataFrame, by: Sequence[str] = (), **options) -> DataFrame:
    """``auroc``, ``auprc`` and ``minpse`` (best min of precision and recall)."""
    return curve(df, by, **options).groupBy(*map(col, by)).agg(
        *[c.alias(n) for n, c in ranking_columns().items()]
    )


def binary_metrics(
    df: DataFrame, by: Sequence[str] = (), threshold: float = THRESHOLD, **options
) -> DataFrame:
    """All five binary scores from one scan."""
    both = {**_class_metrics(threshold), **ranking_columns()}
    return curve(df, by, **options).groupBy(*map(col, by)).agg(
        *[c.alias(n) for n, c in both.items()]
    )


def regression_metrics(
    df: DataFrame,
    by: Sequence[str] = (),
    y: str = "y_los",
    p: str = "p_los",
    weight: str | None = None,
) -> DataFrame:
    """``mse``, ``rmse``, ``mae`` and ``r2`` = 1 - SSE/SST (not the squared correlation)."""
    w = _weighted(weight)
    error = col(p) - col(y)
    n = F.sum(w)
    sse = F.sum(w * error * error)
    if weight is None:
        sst = F.var_pop(col(y)) * n
    else:
        sst = F.sum(w * col(y) * col(y)) - F.sum(w * col(y)) * F.sum(w * col(y)) / n
    return df.groupBy(*map(col, by)).agg(
        F.try_divide(sse, n).alias("mse"),
        F.sqrt(F.try_divide(sse, n)).alias("rmse"),
        F.try_divide(F.sum(w * F.abs(error)), n).alias("mae"),
        (1 - F.try_divide(sse, sst)).alias("r2"),
    )


def osmae_term(
    y: Column, p: Column, y_los: Column, p_los: Column, large_los: Column, threshold: Column
) -> Column:
    """Outcome-specific error of one prediction: the length-of-stay error when the class is
    right, the distance of both stays to a very long stay when wrong, fading with long stays."""
    fade = F.when(y_los <= threshold, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.coalesce(F.try_divide(y_los - large_los, threshold - large_los), F.lit(0.0)))
    )
    right = (p > THRESHOLD).cast("int") == y
    missed = F.greatest(F.lit(0.0), large_los - p_los) + F.greatest(F.lit(0.0), large_los - y_los)
    return fade * F.when(right, F.abs(p_los - y_los)).otherwise(missed)


def early_terms(
    y: Column, p: Column, y_los: Column, threshold: Column, penalty: float = EARLY_PENALTY
) -> tuple[Column, Column]:
    """Early score of one prediction, and the best it could have been."""
    share = F.least(F.lit(1.0), F.coalesce(F.try_divide(y_los, threshold), F.lit(1.0)))
    positive, called = y == 1, p > THRESHOLD
    got = (
        F.when(called & positive, share)
        .when(called, F.lit(penalty))
        .when(positive, share - 1)
        .otherwise(F.lit(0.0))
    )
    return got, F.when(positive, share).otherwise(F.lit(0.0))


def _at_thresholds(df: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    return df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))


def osmae(
    df: DataFrame,
    large_los: Column | float,
    thresholds: Sequence[float],
    by: Sequence[str] = (),
    y: str = "y",
    p: str = "p",
    y_los: str = "y_los",
    p_los: str = "p_los",
) -> DataFrame:
    """Mean outcome-specific error per threshold."""
    large = large_los if isinstance(large_los, Column) else F.lit(float(large_los))
    term = osmae_term(col(y), col(p), col(y_los), col(p_los), large, F.col("threshold"))
    return _at_thresholds(df, thresholds).groupBy(*map(col, by), "threshold").agg(
        F.avg(term).alias("osmae")
    )


def early_score(
    df: DataFrame,
    thresholds: Sequence[float],
    by: Sequence[str] = (),
    penalty: float = EARLY_PENALTY,
    y: str = "y",
    p: str = "p",
    y_los: str = "y_los",
) -> DataFrame:
    """Early-prediction score per threshold, between -1 and 1."""
    got, best = early_terms(col(y), col(p), col(y_los), F.col("threshold"), penalty)
    ratio = F.when(F.sum(best) > 0, F.sum(got) / F.sum(best)).otherwise(F.lit(0.0))
    return _at_thresholds(df, thresholds).groupBy(*map(col, by), "threshold").agg(
        F.greatest(F.lit(-1.0), ratio).alias("es")
    )


def cross_entropy(y: Column, p: Column) -> Column:
    """Binary cross entropy of one prediction; logarithms stop at -100."""

    def safe_log(v: Column) -> Column:
        return F.when(v > 0, F.greatest(F.ln(v), F.lit(LOG_FLOOR))).otherwise(F.lit(LOG_FLOOR))

    return -(y * safe_log(p) + (1 - y) * safe_log(1 - p))


def losses(
    df: DataFrame,
    by: Sequence[str] = (),
    y: str = "y",
    p: str = "p",
    y_los: str = "y_los",
    p_los: str = "p_los",
    task_weights: tuple[float, float] = (1.0, 1.0),
) -> DataFrame:
    """``log_loss``, ``mse_loss``, their weighted sum, and the time-aware loss."""
    bce = cross_entropy(col(y), col(p))
    squared = (col(p_los) - col(y_los)) * (col(p_los) - col(y_los))
    early = F.avg(bce * F.exp(-DECAY_RATE * col(y_los)))
    reward = F.avg(col(y_los) * F.abs(col(y) - col(p)))
    return df.groupBy(*map(col, by)).agg(
        F.avg(bce).alias("log_loss"),
        F.avg(squared).alias("mse_loss"),
        (task_weights[0] * F.avg(bce) + task_weights[1] * F.avg(squared)).alias("multitask_loss"),
        F.greatest(F.lit(0.0), early - REWARD_FACTOR * reward).alias("time_aware_loss"),
    )


def unpivot_metrics(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per metric: ``(*by, metric, value)``."""
    return df.unpivot([col(b) for b in by], [col(m) for m in metrics], "metric", "value")


def format_results(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``mean ± std`` in percent with two decimals, one row per group and one column per metric."""
    text = F.format_string("%.2f ± %.2f", F.col("mean") * 100, F.col("std") * 100)
    return df.withColumn("_t", text).groupBy(*map(col, by)).pivot("metric", list(metrics)).agg(
        F.first("_t")
    )


def best_checkpoint(
    log: DataFrame, by: Sequence[str], epoch: str, metric: str, mode: str = "max"
) -> DataFrame:
    """Best epoch per group; the first one wins ties."""
    score = col(metric).cast("double") * {"max": 1, "min": -1}[mode]
    best = F.max_by(
        F.struct(col(epoch).alias("epoch"), col(metric).alias("best")),
        F.struct(score, -col(epoch)),
    )
    return log.where(col(metric).isNotNull()).groupBy(*map(col, by)).agg(best.alias("_b")).select(
        *map(col, by), "_b.*"
    )


def percentile_rank(
    df: DataFrame, by: Sequence[str], p: str = "p", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Adds ``share``: the fraction of the group's values at or below the row's own; NULL for a
    missing value, which does not count.

    Works on counts per distinct value, so equal values meet in one row before any ordering.
    """
    known = df.where(col(p).isNotNull())
    counted = stored(known.groupBy(*map(col, by), col(p)).agg(F.count(F.lit(1)).alias("_c")))
    ranked = running_sums(counted, by, [(p, "asc")], {"_upto": F.col("_c")}, hot_rows, totals=True)
    shares = ranked.select(
        *map(col, by), col(p), (F.col("_upto") / F.col("_upto_total")).alias("share")
    )
    return skewed_join(df, shares, [*by, p], counted.count(), hot_rows, how="left")

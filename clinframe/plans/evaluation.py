"""Scores of predictions by task, and their bootstrap report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from clinframe.operators import bootstrap, metrics

#: The scores each task reports.
BINARY = ("accuracy", "auroc", "auprc", "minpse", "f1")
REGRESSION = ("mse", "rmse", "mae", "r2")
TASKS = {
    "outcome": (metrics.binary_metrics, BINARY),
    "readmission": (metrics.binary_metrics, BINARY),
    "los": (metrics.regression_metrics, REGRESSION),
}


def evaluate(preds: DataFrame, task: str, by: Sequence[str] = (), **options) -> DataFrame:
    """All scores of a task per group: ``(*by, metric, value)``."""
    score, names = TASKS[task]
    return metrics.unpivot_metrics(score(preds, by=by, **options), by, names)


def evaluate_with_spread(
    preds: DataFrame,
    task: str,
    id_columns: Sequence[str],
    by: Sequence[str] = (),
    replicates: int = bootstrap.REPLICATES,
    **options,
) -> DataFrame:
    """``mean ± std`` over bootstrap resamples, one row per group."""
    score, names = TASKS[task]
    spread = bootstrap.bootstrap(preds, score, names, id_columns, by, replicates, **options)
    return metrics.format_results(spread, by, names)

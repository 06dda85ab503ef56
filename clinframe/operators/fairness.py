"""Group fairness of predicted classes for several sensitive attributes in one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinframe.schema import col

MEASURES = ("di", "aod", "eod", "spd")


def fairness_report(
    df: DataFrame,
    privileged: Mapping[str, Column],
    threshold: float = 0.5,
    by: Sequence[str] = (),
    y: str = "y",
    p: str = "p",
) -> DataFrame:
    """``(*by, attribute, di, aod, eod, spd)``; ``privileged`` maps an attribute to its predicate.

    The predicted class is positive at or above ``threshold``. Rates of empty groups: 0 within
    ``aod`` and ``eod``, NULL in ``di`` and ``spd``; ``di`` is NULL when either rate is 0/0.
    """
    called, truth = col(p) >= threshold, col(y) == 1

    def cells(member: Column) -> Column:
        return F.struct(
            F.count_if(member).alias("n"),
            F.count_if(member & called).alias("called"),
            F.count_if(member & truth).alias("pos"),
            F.count_if(member & truth & called).alias("tp"),
        )

    counts = []
    for i, inside in enumerate(privileged.values()):
        member = F.coalesce(inside, F.lit(False))
        counts.append(F.struct(cells(member).alias("a"), cells(~member).alias("b")).alias(f"_c{i}"))
    table = df.groupBy(*map(col, by)).agg(*counts)
    rows = F.array(
        *[F.struct(F.lit(name).alias("attribute"), F.col(f"_c{i}.*")) for i, name in enumerate(privileged)]
    )
    long = table.select(*map(col, by), F.inline(rows))

    def rate(top: str | Column, bottom: str | Column) -> Column:
        return F.try_divide(top, bottom)

    def or_zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0.0))

    called_a = rate("a.called", "a.n")
    called_b = rate("b.called", "b.n")
    tpr_gap = or_zero(rate("a.tp", "a.pos")) - or_zero(rate("b.tp", "b.pos"))
    fpr_a = or_zero(rate(F.col("a.called") - F.col("a.tp"), F.col("a.n") - F.col("a.pos")))
    fpr_b = or_zero(rate(F.col("b.called") - F.col("b.tp"), F.col("b.n") - F.col("b.pos")))
    # The smaller rate over the larger one equals the ratio turned to at most 1.
    ratio = F.try_divide(F.least(called_a, called_b), F.greatest(called_a, called_b))
    return long.select(
        *map(col, by),
        "attribute",
        F.when(called_a.isNotNull() & called_b.isNotNull(), ratio).alias("di"),
        (0.5 * ((fpr_a - fpr_b) + tpr_gap)).alias("aod"),
        tpr_gap.alias("eod"),
        (called_a - called_b).alias("spd"),
    )


def fairness_measure(df: DataFrame, privileged: Mapping[str, Column], measure: str, **options) -> DataFrame:
    """One of ``di``, ``aod``, ``eod``, ``spd`` for every attribute."""
    if measure not in MEASURES:
        raise ValueError(f"unknown measure: {measure}")
    return fairness_report(df, privileged, **options).select(
        *map(col, options.get("by", ())), "attribute", measure
    )

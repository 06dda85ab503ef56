"""Exact interpolated quantiles of many columns, optionally per cohort.

The built-in ``percentile`` keeps every distinct value of a group in one task. It is used
only where the counted rows of the largest group stay below ``group_rows``. Beyond that a
mergeable sketch brackets each wanted rank, only distinct values inside the brackets are
shuffled, and the exact order statistic is picked from their counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinframe.operators.skew import BROADCAST_ROWS, null_safe_join
from clinframe.schema import col
from clinframe.session import materialise

#: Rows of one group for which one task may hold all distinct values.
GROUP_ROWS = 2_000_000
#: The sketch keeps ranks within 1/SKETCH of the rows; brackets reach twice as far.
SKETCH = 10_000
#: Groups up to this size are their own bracket, since rounding of ranks matters there.
TINY = 50_000
#: Equal-width parts of a bracket.
PARTS = 4096


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    group_rows: int = GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Rows ``(*by, feature, prob, value)``; NULLs are left out, a group without values gives NULL.

    The largest group is counted, unless the caller knows a bound for it.
    """
    if largest is None:
        largest = largest_group(df, by)
    if largest <= group_rows:
        return _built_in(df, columns, probs, by)
    return _bracketed(df, columns, probs, by)


def largest_group(df: DataFrame, by: Sequence[str] = ()) -> int:
    """Rows of the largest group."""
    sizes = df.groupBy(*map(col, by)).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def _built_in(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str]
) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    wide = df.groupBy(*map(col, by)).agg(
        *[F.percentile(col(c).cast("double"), wanted).alias(f"_q{i}") for i, c in enumerate(columns)]
    )
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.lit(float(p)).alias("prob"),
                     F.get(F.col(f"_q{i}"), F.lit(j)).alias("value"))
            for i, c in enumerate(columns)
            for j, p in enumerate(probs)
        ]
    )
    return wide.select(*map(col, by), F.inline(cells))


def long_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per non-missing cell: ``(*by, feature, value)``."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), col(c).cast("double").alias("value")) for c in columns]
    )
    return df.select(*map(col, by), F.inline(cells)).where(F.col("value").isNotNull())


def _bracketed(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str],
    whole: bool = False,
) -> DataFrame:
    """Quantiles through brackets around their ranks. A sketch that misses a rank is noticed, and
    the work repeated with the ``whole`` range as the bracket."""
    group = [*by, "feature"]
    reach = 2.0 / SKETCH
    edges = [max(0.0, p - reach) for p in probs] + [min(1.0, p + reach) for p in probs]
    cells = long_values(df, columns, by)
    sketch = materialise(
        cells.groupBy(*map(col, group)).agg(
            F.count("value").alias("n"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.percentile_approx("value", edges, SKETCH).alias("edges"),
        )
    )
    groups = sketch.count()

    def edge(i: int, p: float, open_end: Column) -> Column:
        outside = (F.col("n") <= TINY) | F.lit(whole or p <= 0.0 or p >= 1.0)
        return F.when(outside, open_end).otherwise(F.get("edges", F.lit(i)))

    brackets = sketch.select(
        *map(col, group),
        F.array(
            *[
                F.struct(
                    F.lit(float(p)).alias("prob"),
                    (F.lit(float(p)) * (F.col("n") - 1)).alias("rank"),
                    edge(i, edges[i], F.col("low")).alias("lo"),
                    edge(len(probs) + i, edges[len(probs) + i], F.col("high")).alias("hi"),
                )
                for i, p in enumerate(probs)
            ]
        ).alias("brackets"),
    )
    # One row per cell and prob, reduced before the shuffle: everything below a bracket is one
    # count, everything above it is dropped, the inside keeps its distinct values.
    inside = F.col("value") >= F.col("b.lo")
    part = F.when(
        inside, F.coalesce(F.width_bucket("value", F.col("b.lo"), F.col("b.hi"), F.lit(PARTS)), F.lit(1))
    ).otherwise(F.lit(-1))
    counted = (
        null_safe_join(cells, brackets, group, hint=groups <= BROADCAST_ROWS)
        .select(*map(col, group), "value", F.explode("brackets").alias("b"))
        .where(F.col("value") <= F.col("b.hi"))
        .groupBy(
            *map(col, group),
            F.col("b.prob").alias("prob"),
            F.col("b.rank").alias("rank"),
            part.alias("part"),
            F.when(inside, F.col("value")).alias("value"),
        )
        .agg(F.count(F.lit(1)).alias("c"))
    )
    cell = [*group, "prob"]
    parts = counted.groupBy(*map(col, cell), "rank", "part").agg(F.sum("c").alias("c"))
    upto = Window.partitionBy(*map(col, cell)).orderBy("part")
    first, second = F.floor("rank"), F.ceil("rank")
    wanted = (
        parts.withColumn("before", F.sum("c").over(upto) - F.col("c"))
        .where(
            ((F.col("before") <= first) & (first < F.col("before") + F.col("c")))
            | ((F.col("before") <= second) & (second < F.col("before") + F.col("c")))
        )
        .select(*map(col, cell), "part", "before")
    )
    within = Window.partitionBy(*map(col, cell), "part").orderBy("value")
    few = 2 * groups * len(probs) <= BROADCAST_ROWS
    ranked = null_safe_join(counted, wanted, [*cell, "part"], hint=few).withColumn(
        "upto", F.col("before") + F.sum("c").over(within)
    )
    picked = ranked.groupBy(*map(col, cell), "rank").agg(
        F.bool_or(F.col("part") == -1).alias("missed"),
        F.min(F.when(F.col("upto") > first, F.col("value"))).alias("v0"),
        F.min(F.when(F.col("upto") > second, F.col("value"))).alias("v1"),
    )
    value = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("rank") - first)
    missed = F.col("missed") | F.col("v0").isNull() | F.col("v1").isNull()
    found = materialise(picked.select(*map(col, cell), value.alias("value"), missed.alias("missed")))
    if not whole and (found.where("missed").count() or found.count() < groups * len(probs)):
        return _bracketed(df, columns, probs, by, whole=True)
    every = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.lit(float(p)).alias("prob"))
            for c in columns
            for p in probs
        ]
    )
    # Groups without values are listed too.
    listed = df.select(*map(col, by)).distinct() if by else df.sparkSession.range(1)
    listed = listed.select(*map(col, by), F.inline(every))
    return null_safe_join(listed, found.drop("missed"), cell, "left", hint=found.count() <= BROADCAST_ROWS)

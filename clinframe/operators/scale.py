"""Trimmed statistics of the training split, and scaling and encoding of every split with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinframe.operators.quantiles import GROUP_ROWS, exact_quantiles, largest_group
from clinframe.schema import VisitSchema, col
from clinframe.session import materialise

#: Fixed values of the scaling rule.
EPSILON = 1e-12
OUTLIER = 1e4
TRIM = (0.05, 0.95)

#: Levels one categorical column may have; they become columns of the plan.
MAX_LEVELS = 1000


def by_feature(stats: DataFrame, features: Sequence[str], fields: Sequence[str]) -> Column:
    """The rows of ``stats`` for ``features``, in their order, as one array of structs for use in
    any select; see :func:`fitted`.

    A scalar subquery on one row per feature: computed once, and nothing is collected.
    """
    listed = F.array(
        *[F.struct(F.lit(i).alias("_i"), F.lit(f).alias("feature")) for i, f in enumerate(features)]
    )
    wanted = stats.sparkSession.range(1).select(F.inline(listed))
    # As many rows as the schema has features.
    row = wanted.join(F.broadcast(stats.select("feature", *fields)), "feature", "left")
    return row.agg(F.array_sort(F.collect_list(F.struct("_i", *fields)))).scalar()


def fitted(column: str, place: int, field: str) -> Column:
    """One field of one feature from a column made by :func:`by_feature`."""
    return F.get(F.col(column), F.lit(place))[field]


def fit_trimmed_stats(
    train: DataFrame,
    features: Sequence[str],
    lo: float = TRIM[0],
    hi: float = TRIM[1],
    group_rows: int = GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Mean, sample deviation and median of each feature between its own quantiles.

    Cells are trimmed one by one: a value outside (lo, hi) of its feature leaves the rest of
    its row in place. Statistics without values are 0. The fitted table has one row per
    feature and is written once, so scaling several splits does not fit again.
    """
    rows = largest_group(train) if largest is None else largest
    bounds = materialise(exact_quantiles(train, features, [lo, hi], (), group_rows, rows))
    edges = bounds.groupBy("feature").agg(
        F.max(F.when(F.col("prob") == lo, F.col("value"))).alias("lo"),
        F.max(F.when(F.col("prob") == hi, F.col("value"))).alias("hi"),
    )
    limits = train.select(*map(col, features)).withColumn(
        "_limits", by_feature(edges, features, ["lo", "hi"])
    )
    kept = limits.select(
        *[
            F.when(
                (col(f) > fitted("_limits", i, "lo")) & (col(f) < fitted("_limits", i, "hi")), col(f)
            ).alias(f)
            for i, f in enumerate(features)
        ]
    )
    medians = exact_quantiles(kept, features, [0.5], (), group_rows, rows)
    moments = kept.agg(
        *[F.struct(F.avg(col(f)).alias("mean"), F.stddev_samp(col(f)).alias("std")).alias(f"_m{i}")
          for i, f in enumerate(features)]
    ).select(
        F.inline(
            F.array(
                *[F.struct(F.lit(f).alias("feature"), F.col(f"_m{i}.mean"), F.col(f"_m{i}.std"))
                  for i, f in enumerate(features)]
            )
        )
    )
    filled = (
        moments.join(F.broadcast(edges), "feature")
        .join(F.broadcast(medians.select("feature", F.col("value").alias("median"))), "feature")
        .fillna(0.0, ["mean", "std", "median"])
    )
    fill = (F.col("median") - F.col("mean")) / (F.col("std") + EPSILON)
    return materialise(filled.withColumn("default_fill", fill))


def zscore(df: DataFrame, stats: DataFrame, features: Sequence[str]) -> DataFrame:
    """Centre and scale ``features`` with fitted statistics."""
    out = df.withColumn("_fit", by_feature(stats, features, ["mean", "std"]))
    scaled = {
        f: (col(f) - fitted("_fit", i, "mean")) / (fitted("_fit", i, "std") + EPSILON)
        for i, f in enumerate(features)
    }
    return out.withColumns(scaled).drop("_fit")


def clip_outliers(df: DataFrame, features: Sequence[str], limit: float = OUTLIER) -> DataFrame:
    """Values beyond ±limit become 0; missing stays missing."""
    return df.withColumns(
        {f: F.when(F.abs(col(f)) > limit, F.lit(0.0)).otherwise(col(f)) for f in features}
    )


def los_info(
    train: DataFrame,
    schema: VisitSchema,
    stats: DataFrame,
    los: str,
    group_rows: int = GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """One row about length of stay: trimmed moments over visits; ``large_los`` and ``threshold``
    over the longest stay of each record (p95, and half the mean within [p5, p95])."""
    stays = train.groupBy(col(schema.key)).agg(F.max(col(los)).alias("stay"))
    tails = exact_quantiles(stays, ["stay"], [0.05, 0.95], (), group_rows, largest).agg(
        F.max(F.when(F.col("prob") == 0.05, F.col("value"))).alias("p5"),
        F.max(F.when(F.col("prob") == 0.95, F.col("value"))).alias("p95"),
    )
    tails = materialise(tails)
    middle = stays.withColumn("_t", tails.select(F.struct("*")).scalar()).where(
        F.col("stay").between(F.col("_t.p5"), F.col("_t.p95"))
    )
    half = middle.agg((F.avg("stay") * 0.5).alias("threshold"))
    moments = stats.where(F.col("feature") == los).select(
        F.struct(
            F.col("mean").alias("los_mean"),
            F.col("std").alias("los_std"),
            F.col("median").alias("los_median"),
        )
    )
    return half.select(
        moments.scalar().alias("_s"),
        tails.select("p95").scalar().alias("large_los"),
        "threshold",
    ).select("_s.*", "large_los", "threshold")


def invert_scale(value: Column, mean: Column, std: Column) -> Column:
    """Back from the scaled to the original unit."""
    return value * std + mean


def observed_levels(df: DataFrame, columns: Sequence[str], limit: int = MAX_LEVELS) -> dict:
    """Sorted levels of each categorical column. The one piece of data the plan needs on the
    driver; more than ``limit`` levels in a column is an error, so its size is bounded."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), col(c).cast("string").alias("level")) for c in columns]
    )
    found = df.select(F.inline(pairs)).where(F.col("level").isNotNull()).distinct()
    rows = found.limit(limit * len(columns) + 1).collect()
    levels = {c: sorted(r["level"] for r in rows if r["name"] == c) for c in columns}
    wide = [c for c in columns if len(levels[c]) > limit]
    if wide or len(rows) > limit * len(columns):
        raise ValueError(f"more than {limit} levels: not categorical: {wide or list(columns)}")
    return levels


def one_hot(
    df: DataFrame, columns: Sequence[str], sep: str = "->", levels: dict | None = None
) -> DataFrame:
    """One 0/1 column per observed level, named ``column->level``, in the place of each column."""
    levels = levels or observed_levels(df, columns)
    out: list[Column] = []
    for name in df.columns:
        if name not in columns:
            out.append(col(name))
            continue
        out += [
            F.coalesce((col(name).cast("string") == level).cast("double"), F.lit(0.0)).alias(
                f"{name}{sep}{level}"
            )
            for level in levels[name]
        ]
    return df.select(*out)


def decode_one_hot(columns: Sequence[str], sep: str = "->", unknown: str = "unknown") -> Column:
    """The level whose column is 1, the first of them if several, else ``unknown``."""
    hits = [F.when(col(c) == 1, F.lit(c.split(sep)[-1])) for c in columns]
    return F.coalesce(*hits, F.lit(unknown))


def drop_all_null(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Drop the rows in which every listed feature is missing."""
    return df.where(F.coalesce(*[col(f).cast("double") for f in features]).isNotNull())

"""Cohort summaries, patient dimension, split sizes and run totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinframe.operators.quantiles import GROUP_ROWS, exact_quantiles
from clinframe.schema import VisitSchema, col

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def cohort_profile(
    df: DataFrame,
    by: str,
    columns: Sequence[str],
    group_rows: int = GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles per cohort and column."""
    present = df.where(col(by).isNotNull())
    wide = present.groupBy(col(by)).agg(
        *[
            F.struct(
                F.count(col(c)).alias("count"),
                F.avg(col(c)).alias("mean"),
                F.stddev_samp(col(c)).alias("std"),
                F.min(col(c).cast("double")).alias("min"),
                F.max(col(c).cast("double")).alias("max"),
            ).alias(f"_s{i}")
            for i, c in enumerate(columns)
        ]
    )
    moments = wide.select(
        col(by),
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("feature"), F.col(f"_s{i}.*")) for i, c in enumerate(columns)]
            )
        ),
    )
    quartiles = exact_quantiles(present, columns, list(QUARTILES.values()), [by], group_rows, largest)
    wide_quartiles = quartiles.groupBy(col(by), "feature").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in QUARTILES.items()]
    )
    return moments.join(wide_quartiles, [by, "feature"], "left")


def profile_states(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """What a batch of visits adds to a profile: ``(by, feature, count, mean, m2, min, max)``, m2 being the
    sum of squared distances from the mean. One row per cohort and column, to be kept and merged."""
    parts = df.where(col(by).isNotNull()).groupBy(col(by)).agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.count(col(c)).alias("count"),
                F.avg(col(c)).alias("mean"),
                F.coalesce(F.var_pop(col(c)) * F.count(col(c)), F.lit(0.0)).alias("m2"),
                F.min(col(c).cast("double")).alias("min"),
                F.max(col(c).cast("double")).alias("max"),
            ).alias(f"_s{i}")
            for i, c in enumerate(columns)
        ]
    )
    return parts.select(col(by), F.inline(F.array(*[F.col(f"_s{i}") for i in range(len(columns))])))


def merge_states(states: DataFrame, by: str) -> DataFrame:
    """The states of all batches as one state per cohort and column, which can be merged again. Distances
    are taken from the common mean, so nothing cancels out; one shuffle of states, none of visits."""
    group = Window.partitionBy(col(by), "feature")
    common = F.try_divide(F.sum(F.col("count") * F.col("mean")).over(group), F.sum("count").over(group).cast("double"))
    apart = F.col("count") * F.pow(F.col("mean") - F.col("_common"), 2)
    return states.withColumn("_common", common).groupBy(col(by), "feature").agg(
        F.sum("count").alias("count"),
        F.first("_common").alias("mean"),
        F.sum(F.col("m2") + F.coalesce(apart, F.lit(0.0))).alias("m2"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )


def profile_of(states: DataFrame) -> DataFrame:
    """Count, mean, sample deviation and extremes from states of which each cohort and column has one."""
    std = F.when(F.col("count") > 1, F.sqrt(F.col("m2") / (F.col("count") - 1)))
    return states.withColumn("std", std).drop("m2")


def last_values(df: DataFrame, schema: VisitSchema, columns: Sequence[str]) -> DataFrame:
    """Last non-missing value of every column per record, each column on its own."""
    place = F.struct(*map(col, schema.order))
    return df.groupBy(col(schema.key)).agg(
        *[F.max_by(col(c), F.when(col(c).isNotNull(), place)).alias(c) for c in columns]
    )


def profile_last(
    df: DataFrame,
    schema: VisitSchema,
    by: str,
    columns: Sequence[str],
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Cohort profile over each record's last non-missing values."""
    return cohort_profile(last_values(df, schema, [*columns, by]), by, columns, group_rows)


def patient_dim(df: DataFrame, schema: VisitSchema, columns: Sequence[str]) -> DataFrame:
    """First non-missing value of every column per patient."""
    place = F.struct(*map(col, schema.order))
    return df.groupBy(col(schema.patient or schema.key)).agg(
        *[F.min_by(col(c), F.when(col(c).isNotNull(), place)).alias(c) for c in columns]
    )


def split_sizes(split: DataFrame, label: str) -> DataFrame:
    """Records per split and label, with a total per split and overall (level ``all``)."""
    counted = split.rollup(col("split"), col(label)).agg(
        F.count(F.lit(1)).alias("records"), F.grouping_id().alias("_g")
    )
    return counted.select(
        F.when(F.col("_g") >= 3, "all").otherwise(F.col("split")).alias("split"),
        F.when(F.col("_g") >= 1, "all").otherwise(col(label).cast("string")).alias(label),
        "records",
    )


def run_totals(runs: DataFrame, patient: str) -> DataFrame:
    """Tokens and seconds per patient and overall (patient ``all``); only ``ok`` runs add up,
    ``error`` runs are counted, ``skipped`` ones neither."""
    ok = F.col("status") == "ok"
    sums = [
        F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c)
        for c in ("prompt_tokens", "completion_tokens", "seconds")
    ]
    counted = runs.rollup(col(patient)).agg(
        *sums,
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(ok).alias("processed"),
        F.grouping_id().alias("_g"),
    )
    who = F.when(F.col("_g") == 1, "all").otherwise(col(patient).cast("string"))
    return counted.withColumn(patient, who).drop("_g")

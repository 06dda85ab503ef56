"""Imputation and per-record sequences in time order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinframe.operators.quantiles import GROUP_ROWS, exact_quantiles
from clinframe.operators.scale import by_feature, fitted
from clinframe.operators.skew import HOT_ROWS, carry_forward, null_safe_join, running_sums
from clinframe.schema import VisitSchema, col

#: Fill where a feature has no value of its own (fixed value).
NO_FILL = -1.0
#: Visits in one sequence row; a longer record continues in further rows (``part`` 1, 2, …).
PART_VISITS = 8192


def _order(schema: VisitSchema) -> list[tuple[str, str]]:
    return [(n, "asc") for n in schema.order]


def forward_fill(
    df: DataFrame,
    schema: VisitSchema,
    features: Sequence[str] | None = None,
    fills: Mapping[str, Column] | None = None,
    stats: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Carry the last observation forward within each record; leading gaps take the fill.

    The fill of a feature is its entry in ``fills``, else its ``default_fill`` in ``stats``,
    else -1.
    """
    names = list(features or schema.labs)
    out = carry_forward(df, [schema.key], _order(schema), names, hot_rows, largest)
    given: dict[str, Column] = dict(fills or {})
    if stats is not None:
        out = out.withColumn("_fit", by_feature(stats, names, ["default_fill"]))
        for i, n in enumerate(names):
            given.setdefault(n, fitted("_fit", i, "default_fill"))
    filled = {n: F.coalesce(col(n), *([given[n]] if n in given else []), F.lit(NO_FILL)) for n in names}
    return out.withColumns(filled).drop("_fit")


def raw_fill(
    df: DataFrame,
    schema: VisitSchema,
    features: Sequence[str] | None = None,
    split: str = "split",
    fit_on: str | None = None,
    hot_rows: int = HOT_ROWS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Forward fill in original units; gaps take the median of the row's own split.

    ``fit_on`` names one split whose medians serve all rows instead.
    """
    names = list(features or schema.labs)
    medians = exact_quantiles(df, names, [0.5], by=[split], group_rows=group_rows)
    if fit_on is not None:
        medians = medians.where(col(split) == fit_on)
    per_split = medians.groupBy(*([col(split)] if fit_on is None else [])).agg(
        *[
            F.max(F.when(F.col("feature") == n, F.col("value"))).alias(f"_median_{i}")
            for i, n in enumerate(names)
        ]
    )
    fills = {n: F.col(f"_median_{i}") for i, n in enumerate(names)}
    if fit_on is None:
        # One row per split name; a split without values keeps its rows, and their gaps take -1.
        wide = null_safe_join(df, per_split, [split], "left", hint=True)
    else:
        row = per_split.select(F.struct("*")).scalar()
        wide = df.withColumn("_medians", row)
        fills = {n: F.col(f"_medians._median_{i}") for i, n in enumerate(names)}
    out = forward_fill(wide, schema, names, fills, hot_rows=hot_rows)
    return out.drop("_medians", *[f"_median_{i}" for i in range(len(names))])


def steps(
    df: DataFrame,
    schema: VisitSchema,
    fields: Mapping[str, Column],
    part_visits: int = PART_VISITS,
    hot_rows: int = HOT_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Gather ``fields`` of each record into arrays in time order.

    Columns: key, ``part``, ``length`` and one array per field. Records up to ``part_visits``
    visits have the single part 0. A longer record continues in parts 1, 2, …, so no task
    and no row ever holds more than ``part_visits`` visits. One exchange on the key serves
    the numbering and the gathering.
    """
    slim = df.select(
        col(schema.key),
        *map(col, schema.order),
        *[c.alias(f"_f_{n}") for n, c in fields.items()],
    )
    numbered = running_sums(
        slim, [schema.key], _order(schema), {"_step": F.lit(1)}, hot_rows, largest=largest
    )
    part = F.floor((F.col("_step") - 1) / part_visits).cast("int")
    visit = F.struct("_step", *[F.col(f"_f_{n}").alias(n) for n in fields])
    gathered = numbered.groupBy(col(schema.key), part.alias("part")).agg(
        F.count(F.lit(1)).cast("int").alias("length"),
        F.array_sort(F.collect_list(visit)).alias("_v"),
    )
    return gathered.select(
        col(schema.key), "part", "length", *[F.col(f"_v.{n}").alias(n) for n in fields]
    )


def values(names: Sequence[str]) -> Column:
    return F.array(*[col(n).cast("double") for n in names])


def missing_flags(names: Sequence[str]) -> Column:
    """1 where a feature is missing, else 0."""
    return F.array(*[col(n).isNull().cast("tinyint") for n in names])


def day(schema: VisitSchema) -> Column:
    return F.date_format(col(schema.time), "yyyy-MM-dd")


def to_sequences(df: DataFrame, schema: VisitSchema, **options) -> DataFrame:
    """Features ``x`` (one array per visit) and named targets ``y`` of each record."""
    fields = {"x": values(schema.features)}
    if schema.targets:
        fields["y"] = F.struct(*[col(t).cast("double").alias(t) for t in schema.targets])
    return steps(df, schema, fields, **options)


def missing_mask(df: DataFrame, schema: VisitSchema, **options) -> DataFrame:
    """Missing flags of each record; run it on data before any filling."""
    return steps(df, schema, {"mask": missing_flags(schema.features)}, **options)


def record_times(df: DataFrame, schema: VisitSchema, **options) -> DataFrame:
    """Days of the visits of each record."""
    return steps(df, schema, {"times": day(schema)}, **options)


def export_records(df: DataFrame, schema: VisitSchema, **options) -> DataFrame:
    """Sequences, missing flags and days of each record from a single exchange."""
    fields = {
        "x": values(schema.features),
        "mask": missing_flags(schema.features),
        "times": day(schema),
    }
    if schema.targets:
        fields["y"] = F.struct(*[col(t).cast("double").alias(t) for t in schema.targets])
    return steps(df, schema, fields, **options)


def first_note(df: DataFrame, schema: VisitSchema, note: str) -> DataFrame:
    """First non-missing note of each record."""
    place = F.when(col(note).isNotNull(), F.struct(*map(col, schema.order)))
    return df.groupBy(col(schema.key)).agg(F.min_by(col(note), place).alias(note))


def valid_mask(length: Column, size: Column) -> Column:
    """True for real steps, False for padding."""
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: i < length)


def length_class(length: Column) -> Column:
    """The next power of two: sequences of one class make a batch that wastes less than half."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(length))).cast("int")


def pad_sequences(
    seqs: DataFrame, width: int, x: str = "x", pad: float = 0.0, to: Column | None = None
) -> DataFrame:
    """Right-pad ``x`` to length ``to``, by default that of the longest sequence.

    Adds ``padded`` and the mask ``valid``. The longest length is an aggregate over ``length``
    alone, so the arrays are not built twice for it. Over a large cohort pad to
    :func:`length_class`: one long record then does not blow up all others.
    """
    longest = seqs.agg(F.max("length").alias("n")).scalar() if to is None else to
    out = seqs.withColumn("_n", longest)
    empty = F.array_repeat(F.lit(float(pad)), width)
    padded = F.concat(col(x), F.array_repeat(empty, F.col("_n") - F.col("length")))
    return out.withColumns(
        {"padded": padded, "valid": valid_mask(F.col("length"), F.col("_n"))}
    ).drop("_n")


def last_visit(df: DataFrame, schema: VisitSchema, columns: Sequence[str] | None = None) -> DataFrame:
    """Features and targets of the last visit of each record."""
    names = list(columns or (*schema.features, *schema.targets))
    visit = F.max_by(F.struct(*map(col, names)), F.struct(*map(col, schema.order)))
    return df.groupBy(col(schema.key)).agg(visit.alias("_v")).select(col(schema.key), "_v.*")


def last_step(x: Column, length: Column) -> Column:
    """The last valid step of a padded sequence."""
    return F.element_at(x, length)


def union_folds(parts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """All splits of a fold in one frame, ascending by id (a range-partitioned sort)."""
    tagged = [df.withColumn("split", F.lit(name)) for name, df in parts.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out.orderBy(col(key))

"""Ordered computations within a group that may hold a large share of all rows.

A window partitioned by the group alone puts a hot group into one task. Here a group beyond
``hot_rows`` is first cut into slices that follow its order; the work runs per slice, and a
small table with one row per slice carries the state from slice to slice. Groups below the
bound keep the plain one-shuffle window plan.
"""

from __future__ import annotations

import os.path
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from clinframe.schema import col
from clinframe.session import materialise

#: Rows of one group that a single task may sort.
HOT_ROWS = 4_000_000
#: Rows of a narrow side table that may be broadcast (up to about 150 bytes per row, 64 MB).
BROADCAST_ROWS = 400_000
#: The same for rows that hold texts or vectors.
BROADCAST_WIDE_ROWS = 4_000
#: Slices one level of cutting may make of one group.
FANOUT = 4096
#: Slices per ``hot_rows`` of a group: more than needed, since rows crowd somewhere.
SLACK = 8
#: Levels of cutting; each narrows the range of a slice by up to ``FANOUT``. Their numbers
#: combine into one bigint.
LEVELS = 5

SLICE = "_slice"

#: Tasks per core for work that multiplies its input.
SPREAD = 4

Order = Sequence[tuple[str, str]]


#: Finite ends of an axis: differences of two of them, times ``FANOUT``, are finite too.
_END = 1e300
#: Bytes of a text, after what all texts share, that place it on an axis.
_TEXT_BYTES = 6


def _axis(df: DataFrame, name: str) -> Column | None:
    """A finite number that never decreases along ``name`` in ascending order, or None when the
    type has no such number. NaN sorts last, as in Spark; NULL stays NULL."""
    kind = df.schema[name].dataType
    c = col(name)
    if isinstance(kind, NumericType):
        number = c.cast("double")
        clamped = F.greatest(F.least(number, F.lit(_END)), F.lit(-_END))
        return F.when(F.isnan(number), F.lit(2 * _END)).when(number.isNotNull(), clamped)
    if isinstance(kind, DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, TimestampNTZType):
        seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
        micros = F.date_format(c, "SSSSSS").cast("double") / F.lit(1e6)
        return F.unix_date(c.cast("date")) * F.lit(86400.0) + seconds + micros
    if isinstance(kind, StringType):
        ends = df.agg(F.min(c).alias("a"), F.max(c).alias("b")).first()
        if ends["a"] is None:
            return None
        shared = len(os.path.commonprefix([ends["a"].encode(), ends["b"].encode()]))
        digits = F.hex(F.substring(c.cast("binary"), shared + 1, _TEXT_BYTES))
        return F.conv(F.rpad(digits, 2 * _TEXT_BYTES, "0"), 16, 10).cast("double")
    return None


def null_safe_join(
    left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "inner", hint: bool = False
) -> DataFrame:
    """Join on ``key`` where NULL meets NULL. ``hint`` broadcasts ``right``, whose size the caller
    has checked."""
    if not key:
        raise ValueError("a join needs a key")
    rest = [c for c in right.columns if c not in key]
    named = right.select(*[col(k).alias(f"_key_{i}") for i, k in enumerate(key)], *map(col, rest))
    on = [col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(key)]
    out = left.join(F.broadcast(named) if hint else named, on, how)
    return out.drop(*[f"_key_{i}" for i in range(len(key))])


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` when its counted ``rows`` stay below the bound, else leave the choice open."""
    return F.broadcast(df) if rows <= bound else df


def spread(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Hash ``df`` over several tasks per core, before a step that multiplies its rows: input
    splits are sized for reading, not for work a hundred times larger."""
    tasks = df.sparkSession.sparkContext.defaultParallelism * SPREAD
    return df.repartition(tasks, *map(col, columns))


def skewed_join(
    many: DataFrame,
    one: DataFrame,
    key: Sequence[str],
    rows: int | None = None,
    hot_rows: int = HOT_ROWS,
    bound: int = BROADCAST_ROWS,
    how: str = "inner",
    most_bytes: int | None = None,
) -> DataFrame:
    """Join of ``many`` with ``one``, which has at most one row per key; ``how`` is inner or left.
    NULL keys meet.

    A ``one`` of at most ``bound`` rows (and ``most_bytes`` as text, if given) is broadcast.
    Otherwise the keys that fill more than ``hot_rows`` rows of ``many`` are set apart: their few
    rows of ``one`` are broadcast, so a hot key is never gathered in one task; all other keys are
    joined by shuffling.
    """

    def fits(side: DataFrame, count: int) -> bool:
        if count > bound:
            return False
        if most_bytes is None:
            return True
        size = side.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
        return (size or 0) <= most_bytes

    if rows is None:
        rows = one.count()
    if fits(one, rows):
        return null_safe_join(many, one, key, how, hint=True)
    counted = many.groupBy(*map(col, key)).agg(F.count(F.lit(1)).alias("_n"))
    hot = materialise(counted.where(F.col("_n") > hot_rows).drop("_n"))
    found = hot.count()
    if not found:
        return null_safe_join(many, one, key, how)
    few = found <= BROADCAST_ROWS
    hot_one = null_safe_join(one, hot, key, "left_semi", hint=few)
    apart = null_safe_join(many, hot, key, "left_semi", hint=few)
    apart = null_safe_join(apart, hot_one, key, how, hint=fits(hot_one, found))
    rest = null_safe_join(null_safe_join(many, hot, key, "left_anti", hint=few), one, key, how)
    return apart.unionByName(rest)


def ordered_slices(
    df: DataFrame,
    key: Sequence[str],
    order: Order,
    hot_rows: int = HOT_ROWS,
    largest: int | None = None,
) -> tuple[DataFrame, bool]:
    """Add ``_slice``: constant for ordinary groups, rising along ``order`` in hot ones.

    Returns the frame and whether any group was cut. Costs one aggregation over the key and
    the leading column, combined before its shuffle; further ones only where a group is hot. Rows
    that are equal in one column are cut by the next one. A caller that knows the ``largest``
    group saves that aggregation.
    """
    out, cut = df.withColumn(SLICE, F.lit(0).cast("bigint")), False
    if largest is not None and largest <= hot_rows:
        return out, cut
    levels = LEVELS
    for place, (name, way) in enumerate(order):
        axis = _axis(df, name)
        if axis is None:
            continue
        # Descending columns rise along the negated axis, with NULL last instead of first.
        axis = -axis if way == "desc" else axis
        # A later column may cut only where the earlier ones do not change.
        settled = F.lit(True)
        for earlier, _ in order[:place]:
            known = F.count(col(earlier))
            one = F.min(col(earlier)).eqNullSafe(F.max(col(earlier)))
            settled = settled & one & ((known == 0) | (known == F.count(F.lit(1))))
        while levels:
            hot = (
                out.groupBy(*map(col, key), SLICE)
                .agg(
                    F.count(F.lit(1)).alias("_n"),
                    F.count(axis).alias("_known"),
                    F.min(axis).alias("_lo"),
                    F.max(axis).alias("_hi"),
                    settled.alias("_settled"),
                )
                .where(F.col("_n") > hot_rows)
            )
            splits = (F.col("_lo") < F.col("_hi")) | F.col("_known").between(F.lit(1), F.col("_n") - 1)
            hot = materialise(hot.withColumn("_splits", F.col("_settled") & F.coalesce(splits, F.lit(False))))
            groups, able = hot.agg(F.count(F.lit(1)), F.count_if("_splits")).first()
            if not groups:
                return out, cut
            if not able:
                break
            fan = F.least(F.lit(FANOUT), F.ceil(F.col("_n") / hot_rows) * SLACK).cast("bigint")
            bounds = F.struct("_lo", "_hi", fan.alias("_fan")).alias("_cut")
            hot = hot.where("_splits")
            if key or cut:
                cuts = hot.select(*map(col, key), SLICE, bounds)
                out = null_safe_join(out, cuts, [*key, SLICE], "left", hint=able <= BROADCAST_ROWS)
            else:
                # All rows are one group: its bounds are a single row, and need no join.
                out = out.withColumn("_cut", hot.select(bounds).scalar())
            c = F.col("_cut")
            spread_out = F.width_bucket(axis, c["_lo"], c["_hi"], c["_fan"])
            bucket = F.when(c["_lo"] < c["_hi"], spread_out).otherwise(F.lit(1))
            missing = c["_fan"] + 2 if way == "desc" else F.lit(0)
            bucket = F.when(c.isNull(), F.lit(0)).when(axis.isNull(), missing).otherwise(bucket)
            out = out.withColumn(SLICE, F.col(SLICE) * (FANOUT + 3) + bucket).drop("_cut")
            cut, levels = True, levels - 1
    return out, cut


def _sorted(order: Order) -> list[Column]:
    return [col(n).desc() if way == "desc" else col(n).asc() for n, way in order]


def running_sums(
    df: DataFrame,
    key: Sequence[str],
    order: Order,
    sums: Mapping[str, Column],
    hot_rows: int = HOT_ROWS,
    totals: bool = False,
    largest: int | None = None,
) -> DataFrame:
    """Add inclusive running totals in ``order`` within ``key``.

    With ``totals`` every ``name`` also gets ``name_total``, the sum over the whole group.
    An empty ``key`` means one group over all rows; it is sliced like any other hot group.
    """
    inputs = {f"_in_{n}": c for n, c in sums.items()}
    work, cut = ordered_slices(df.withColumns(inputs), key, order, hot_rows, largest)
    part = [*map(col, key), F.col(SLICE)] if cut else [*map(col, key)]
    whole = Window.partitionBy(*part)
    so_far = whole.orderBy(*_sorted(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = work.withColumns({n: F.sum(f"_in_{n}").over(so_far) for n in sums})
    if not cut:
        if totals:
            out = out.withColumns({f"{n}_total": F.sum(f"_in_{n}").over(whole) for n in sums})
        return out.drop(SLICE, *inputs)

    across = Window.partitionBy(*map(col, key))
    earlier = across.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    per_slice = work.groupBy(*part).agg(*[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in sums])
    carried = per_slice.select(
        *part,
        *[F.sum(f"_sum_{n}").over(earlier).alias(f"_before_{n}") for n in sums],
        *[F.sum(f"_sum_{n}").over(across).alias(f"_all_{n}") for n in sums],
    )
    out = null_safe_join(out, carried, [*key, SLICE])
    out = out.withColumns({n: F.col(n) + F.coalesce(f"_before_{n}", F.lit(0)) for n in sums})
    if totals:
        out = out.withColumns({f"{n}_total": F.col(f"_all_{n}") for n in sums})
    extra = [f"_{kind}_{n}" for n in sums for kind in ("before", "all")]
    return out.drop(SLICE, *inputs, *extra)


def carry_forward(
    df: DataFrame,
    key: Sequence[str],
    order: Order,
    columns: Sequence[str],
    hot_rows: int = HOT_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Replace NULLs of ``columns`` by the last value before them in ``order`` within ``key``. The
    columns of ``order`` all ascend or all descend."""
    ways = {way for _, way in order}
    if len(ways) > 1:
        raise ValueError("the columns of an order must all ascend or all descend")
    last = F.min_by if ways == {"desc"} else F.max_by
    work, cut = ordered_slices(df, key, order, hot_rows, largest)
    part = [*map(col, key), F.col(SLICE)] if cut else [*map(col, key)]
    so_far = (
        Window.partitionBy(*part).orderBy(*_sorted(order)).rowsBetween(Window.unboundedPreceding, 0)
    )
    out = work.withColumns({c: F.last(col(c), ignorenulls=True).over(so_far) for c in columns})
    if not cut:
        return out.drop(SLICE)

    place = F.struct(*[col(n) for n, _ in order])
    last_in_slice = work.groupBy(*part).agg(
        *[
            last(col(c), F.when(col(c).isNotNull(), place)).alias(f"_last_{i}")
            for i, c in enumerate(columns)
        ]
    )
    earlier = (
        Window.partitionBy(*map(col, key))
        .orderBy(SLICE)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = last_in_slice.select(
        *part,
        *[
            F.last(f"_last_{i}", ignorenulls=True).over(earlier).alias(f"_carried_{i}")
            for i in range(len(columns))
        ],
    )
    out = null_safe_join(out, carried, [*key, SLICE])
    out = out.withColumns(
        {c: F.coalesce(col(c), F.col(f"_carried_{i}")) for i, c in enumerate(columns)}
    )
    return out.drop(SLICE, *[f"_carried_{i}" for i in range(len(columns))])

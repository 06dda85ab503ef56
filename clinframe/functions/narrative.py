"""Descriptive text as column expressions: all of it runs inside the JVM, no Python per row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinframe.functions import fixed_values as fixed
from clinframe.schema import col


def _decimal(value: Column, decimals: int) -> Column:
    """Rounded half up in decimal arithmetic, which no engine's binary rounding disturbs."""
    return F.round(value.try_cast("decimal(28,8)"), decimals)


def number_text(value: Column, decimals: int = 2) -> Column:
    """Rounded to ``decimals`` without trailing zeros beyond the first (``1.5``, ``2.0``);
    missing is ``nan``."""
    text = _decimal(value, decimals).cast("string")
    if decimals > 1:
        text = F.regexp_replace(text, "0{1,%d}$" % (decimals - 1), "")
    return F.coalesce(text, F.lit("nan"))


def pct_change_desc(change: Column) -> Column:
    return _decimal(F.abs(change) * 100, 2).cast("double")


def trend_desc(change: Column) -> Column:
    return F.when(change > 0, "increased").when(change <= 0, "decreased")


def advice_desc(change: Column) -> Column:
    """The direction that would undo the change."""
    return F.when(change > 0, "decrease").when(change <= 0, "increase")


def range_desc(value: Column, lo: Column, hi: Column) -> Column:
    """Below, above or within the range, by percent of the bound; empty without a range, NULL beyond
    a bound of zero."""
    below = number_text(F.try_divide(lo - value, lo) * 100)
    above = number_text(F.try_divide(value - hi, hi) * 100)
    return (
        F.when(lo.isNull() | hi.isNull(), F.lit(""))
        .when(value < lo, F.format_string(fixed.BELOW_RANGE, below))
        .when(value > hi, F.format_string(fixed.ABOVE_RANGE, above))
        .otherwise(F.when(value.isNotNull(), fixed.WITHIN_RANGE))
    )


def vs_cohort_desc(value: Column, center: Column) -> Column:
    """Percent lower or higher than a cohort's center, or ``equal``; NULL for a zero center."""

    def percent(gap: Column) -> Column:
        whole = _decimal(F.try_divide(gap, center) * 100, 0)
        return F.concat(whole.cast("string"), F.lit(".0%"))

    return (
        F.when(center == 0, F.lit(None).cast("string"))
        .when(value < center, F.concat(percent(center - value), F.lit(" lower")))
        .when(value > center, F.concat(percent(value - center), F.lit(" higher")))
        .when(value == center, F.lit("equal"))
    )


def _ladder(value: Column, bounds: Sequence[tuple[float, str]], top: str) -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, word in bounds:
        out = out.when(value < bound, word)
    return out.otherwise(top)


def risk_level(p: Column) -> Column:
    return _ladder(p, fixed.RISK_LEVELS, fixed.TOP_RISK)


def rank_band(share: Column) -> Column:
    """Band of a prediction from the share of predictions at or below it (0 to 1)."""
    return _ladder(share * 100, fixed.RANK_BANDS, fixed.TOP_BAND)


def sex_word(code: Column) -> Column:
    return F.when(code == 1, "male").otherwise("female")


def _lookup(table: Mapping[str, str], key: Column) -> Column:
    """Value of a fixed table as a map literal."""
    entries = [F.lit(v) for pair in table.items() for v in pair]
    return F.element_at(F.create_map(*entries), key)


def original_disease(text: Column, table: Mapping[str, str] = fixed.ORIGINAL_DISEASES) -> Column:
    """English name of the first word of the disease field; NULL when it is not in the table."""
    return _lookup(table, F.split(text, " ")[0])


def comorbidities(table: Mapping[str, str] = fixed.COMORBIDITIES) -> Column:
    """Names of the comorbidity columns that are 1, in table order."""
    named = F.array(*[F.when(col(flag) == 1, F.lit(name)) for flag, name in table.items()])
    return F.array_join(F.array_compact(named), ", ")


def truncate_note(note: Column, characters: int = fixed.NOTE_CHARACTERS) -> Column:
    return F.substring(note, 1, characters)


def top_features(
    weights: DataFrame,
    record: Sequence[str],
    weight: str = "weight",
    position: str = "position",
    n: int = 3,
) -> DataFrame:
    """The n features of a record with the largest absolute weight; ties keep table order.

    The limit on ``rank`` is applied before the shuffle as well, so at most n rows per record
    and task travel.
    """
    best = Window.partitionBy(*map(col, record)).orderBy(F.abs(col(weight)).desc(), col(position))
    ranked = weights.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    return ranked.withColumn("attention", F.abs(col(weight)))


def feature_dim(
    names: Mapping[str, str] = fixed.DISPLAY_NAMES,
    units: Mapping[str, str] = fixed.UNITS,
    ranges: Mapping[str, tuple] = fixed.HEALTHY_RANGES,
    patient_ranges: Mapping[str, str] = fixed.DIALYSIS_RANGES,
) -> dict[str, dict]:
    """What is known of each feature, for use as literals: name, unit and ranges."""
    features = list(dict.fromkeys([*names, *units, *ranges, *patient_ranges]))
    return {
        f: {
            "name": names.get(f, f),
            "unit": units.get(f),
            "range": ranges.get(f),
            "patient_range": patient_ranges.get(f),
        }
        for f in features
    }


def range_suffix(known: Mapping) -> str:
    """Unit and reference ranges of one feature as text."""
    parts = []
    unit = known.get("unit")
    if unit:
        parts.append(f"Measured in {unit}. ")
    if known.get("range"):
        lo, hi = known["range"]
        space = f" {unit}" if unit else ""
        parts.append(f"The healthy lie between {lo}{space} and {hi}{space}. ")
    if known.get("patient_range"):
        parts.append(f"Under dialysis: {known['patient_range']}.")
    return "".join(parts)


def series_line(steps: Column, place: int, known: Mapping) -> Column:
    """One feature of a sequence as text: its values in time order, unit and ranges."""
    numbers = F.array_join(F.transform(steps, lambda v: number_text(F.get(v, F.lit(place)))), ", ")
    return F.concat(F.lit(f"- {known['name']}: \""), numbers, F.lit('". ' + range_suffix(known)))


def series_text(
    seqs: DataFrame, names: Sequence[str], dim: Mapping[str, dict] | None = None, x: str = "x"
) -> DataFrame:
    """``(…, feature, text)``: one line per feature of every sequence row.

    Runs on gathered sequences, so the text of all features needs no further shuffle.
    """
    known = dim if dim is not None else feature_dim()
    lines = F.array(
        *[
            F.struct(
                F.lit(n).alias("feature"),
                series_line(col(x), i, known.get(n, {"name": n})).alias("text"),
            )
            for i, n in enumerate(names)
        ]
    )
    kept = [c for c in seqs.columns if c != x]
    return seqs.select(*map(col, kept), F.inline(lines))


def feature_comparison(
    top: DataFrame,
    centers: DataFrame,
    feature: str = "feature",
    value: str = "value",
    survival: str = "survival",
    deceased: str = "deceased",
) -> DataFrame:
    """Adds ``text``: weight and value of a top feature against both cohorts' centers.

    ``centers`` has one row per feature, as many as there are labs.
    """
    joined = top.join(F.broadcast(centers), feature)
    text = F.concat(
        col(feature),
        F.lit(" stands at "),
        number_text(col(value)),
        F.lit(" and weighs "),
        number_text(F.col("attention"), 3),
        F.lit(". Survivors center on "),
        number_text(col(survival)),
        F.lit(": "),
        F.coalesce(vs_cohort_desc(col(value), col(survival)), F.lit("undefined")),
        F.lit(". The deceased center on "),
        number_text(col(deceased)),
        F.lit(": "),
        F.coalesce(vs_cohort_desc(col(value), col(deceased)), F.lit("undefined")),
        F.lit("."),
    )
    return joined.withColumn("text", text)


def patient_context(
    basics: DataFrame,
    series: DataFrame,
    risks: DataFrame,
    comparisons: DataFrame,
    key: str,
    model: str = "model",
    cohort: str = "the cohort",
) -> DataFrame:
    """One text per patient and model: basics, series, risk with its rank band, and the top
    features against the cohorts.

    ``basics``: key, ``basic``. ``series``: key, ``part``, ``series`` (its lines joined).
    ``risks``: key, model, ``p``, ``share``. ``comparisons``: key, model, rank, ``text``.
    A record in several parts gets one row per part, so no text grows without bound.
    """
    ranked = F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col("text"))))
    compared = comparisons.groupBy(col(key), col(model)).agg(
        F.array_join(ranked["text"], "\n").alias("_compared")
    )
    risk = F.concat(
        F.lit("Model "),
        col(model),
        F.lit(" puts the risk at "),
        number_text(F.col("p")),
        F.lit(" ("),
        risk_level(F.col("p")),
        F.lit("; "),
        rank_band(F.col("share")),
        F.lit(f" of {cohort})."),
    )
    joined = (
        risks.withColumn("_risk", risk)
        .join(compared, [key, model], "left")
        .join(basics, key, "left")
        .join(series, key, "left")
    )
    text = F.concat_ws("\n", "basic", "series", "_risk", "_compared")
    return joined.select(col(key), col(model), "part", text.alias("context"))

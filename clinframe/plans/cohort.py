"""From a visit table to model-ready sequences, masks, times and cohort summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinframe.operators import profile, scale, sequence, split
from clinframe.operators.quantiles import GROUP_ROWS, largest_group
from clinframe.operators.skew import HOT_ROWS
from clinframe.schema import VisitSchema, col
from clinframe.session import stored


@dataclass(frozen=True)
class Cohort:
    """Everything the preparation produces; ``split`` is a column throughout."""

    split: DataFrame
    visits: DataFrame
    stats: DataFrame
    los_info: DataFrame | None
    sequences: DataFrame
    raw: DataFrame
    summaries: DataFrame
    schema: VisitSchema


def prepare_cohort(
    visits: DataFrame,
    schema: VisitSchema,
    label: str,
    test: float,
    val: float,
    los: str | None = None,
    seed: int = 42,
    drop_empty: bool = False,
    hot_rows: int = HOT_ROWS,
) -> Cohort:
    """Split by record, fit on train, scale, clip, impute and gather.

    The visits are written once, with their split as partition: fitting reads the train
    partition only, and no later step repeats the join. All splits are then scaled and
    gathered in the same jobs.
    """
    levels: tuple[str, ...] = ()
    shape = schema
    prepared = visits
    if schema.categorical:
        found = scale.observed_levels(visits, schema.categorical)
        prepared = scale.one_hot(visits, schema.categorical, levels=found)
        levels = tuple(f"{c}->{v}" for c in schema.categorical for v in found[c])
        shape = schema.with_levels(levels)
    labels = split.record_label(visits, schema, "first", [label])
    placed = stored(split.stratified_split(labels, schema.key, label, test, val, seed, hot_rows))
    parted = stored(split.apply_split(prepared, placed, schema.key, hot_rows=hot_rows), ["split"])

    scaled_columns = [*schema.numeric, *schema.scaled_static, *([los] if los else [])]
    train = parted.where(F.col("split") == "train")
    rows = parted.count()
    # No group is larger than the table: a small one needs no further looking.
    bound = rows if rows <= GROUP_ROWS else None
    largest = rows if rows <= hot_rows else largest_group(parted, [schema.key])
    stats = scale.fit_trimmed_stats(train, scaled_columns, largest=bound)
    info = scale.los_info(train, shape, stats, los, largest=bound) if los else None

    # A scaled value is missing where the raw one is, so empty rows can go before scaling.
    kept = scale.drop_all_null(parted, scaled_columns) if drop_empty else parted
    scaled = scale.clip_outliers(scale.zscore(kept, stats, scaled_columns), scaled_columns)
    filled = sequence.forward_fill(
        scaled, shape, shape.labs, stats=stats, hot_rows=hot_rows, largest=largest
    )
    gathered = sequence.to_sequences(filled, shape, hot_rows=hot_rows, largest=largest)
    raw = sequence.export_records(parted, shape, hot_rows=hot_rows, largest=largest)
    summaries = profile.cohort_profile(parted, label, [*shape.static, *shape.labs], largest=bound)
    by_record = placed.select(col(schema.key), "split")
    return Cohort(
        split=placed,
        visits=parted,
        stats=stats,
        los_info=info,
        sequences=gathered.join(by_record, schema.key),
        raw=raw.join(by_record, schema.key),
        summaries=summaries,
        schema=shape,
    )

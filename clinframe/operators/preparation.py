"""The preparation of visits as an ML estimator: fitted once, saved, and applied to visits that come later."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinframe.operators import scale, sequence
from clinframe.schema import VisitSchema, col

#: What is fitted per scaled column.
FITTED = ("lo", "hi", "mean", "std", "median", "default_fill")
#: Column that counts a visit's categorical values that no training visit holds.
UNSEEN = "unseen_levels"


class _Settings(Params, DefaultParamsReadable, DefaultParamsWritable):
    schema = Param(Params._dummy(), "schema", "roles of the columns: the fields of a VisitSchema")
    scaled = Param(Params._dummy(), "scaled", "columns that are centred, scaled and clipped")
    lo = Param(Params._dummy(), "lo", "quantile above which values count for the moments")
    hi = Param(Params._dummy(), "hi", "quantile below which values count for the moments")

    def shape(self) -> VisitSchema:
        given = self.getOrDefault(self.schema)
        return VisitSchema(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


class Preparation(Estimator, _Settings):
    """Learns levels of the categorical labs, and limits, moments and fills of ``scaled`` (by default the
    numeric labs and scaled static columns of the schema) from training visits.

    A column without values, or an empty table, is fitted with zeros.
    """

    def __init__(self, schema: VisitSchema | None = None, scaled: Sequence[str] | None = None, trim: Sequence[float] = scale.TRIM):
        super().__init__()
        shape = schema or VisitSchema()
        columns = [*shape.numeric, *shape.scaled_static] if scaled is None else list(scaled)
        self._set(schema=asdict(shape), scaled=columns, lo=trim[0], hi=trim[1])

    def _fit(self, dataset: DataFrame) -> PreparationModel:
        shape, columns = self.shape(), self.getOrDefault(self.scaled)
        levels = scale.observed_levels(dataset, shape.categorical) if shape.categorical else {}
        stats = {}
        if columns:
            # One row per column of the schema.
            found = scale.fit_trimmed_stats(dataset, columns, self.getOrDefault(self.lo), self.getOrDefault(self.hi)).collect()
            stats = {r["feature"]: {n: r[n] for n in FITTED} for r in found}
        model = self._copyValues(PreparationModel())
        return model._set(levels=levels, stats=stats)


class PreparationModel(Model, _Settings):
    """Encodes, scales, clips and fills visits with what was fitted; saved as one small JSON file.

    Visits of any time and split may come, also of records that were not seen. A categorical value
    without a level leaves all level columns of its lab 0 and counts in ``unseen_levels`` (present where
    the schema has categorical labs); a missing value does the same without counting.
    """

    levels = Param(Params._dummy(), "levels", "levels of each categorical lab, in order")
    stats = Param(Params._dummy(), "stats", "limits, moments and fill of each scaled column")

    def encoded_schema(self) -> VisitSchema:
        """The schema of the visits that ``transform`` returns."""
        shape, levels = self.shape(), self.getOrDefault(self.levels)
        return shape.with_levels(tuple(f"{c}->{v}" for c in shape.categorical for v in levels[c])) if levels else shape

    def table(self, spark) -> DataFrame:
        """The fitted statistics, one row per scaled column."""
        rows = [(f, *[s[n] for n in FITTED]) for f, s in self.getOrDefault(self.stats).items()]
        return spark.createDataFrame(rows, "feature string, " + ", ".join(f"{n} double" for n in FITTED))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shape, levels, stats = self.shape(), self.getOrDefault(self.levels), self.getOrDefault(self.stats)
        out = dataset
        if shape.categorical:
            new = [F.when(~col(c).cast("string").isin(levels[c]), 1).otherwise(0) for c in shape.categorical]
            out = out.withColumn(UNSEEN, sum(new[1:], new[0]))
            out = scale.one_hot(out, shape.categorical, levels=levels)
        scaled = {f: (col(f) - s["mean"]) / (s["std"] + scale.EPSILON) for f, s in stats.items()}
        if scaled:
            out = scale.clip_outliers(out.withColumns(scaled), list(scaled))
        shape = self.encoded_schema()
        fills = {f: F.lit(stats[f]["default_fill"]) for f in shape.labs if f in stats}
        return sequence.forward_fill(out, shape, shape.labs, fills) if shape.labs else out

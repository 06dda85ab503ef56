"""Bootstrap of metrics over resamples with replacement."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.functions.hashing import HEX_DIGITS, unit_hash
from clinframe.operators.metrics import unpivot_metrics
from clinframe.operators.skew import HOT_ROWS, SPREAD, running_sums, spread
from clinframe.schema import col
from clinframe.session import stored

#: Fixed values.
REPLICATES = 100
SEED = 42
#: Cumulative probabilities of a Poisson variable with mean 1: P(at most 0), P(at most 1), …
POISSON_1 = (
    0.36787944117144233,
    0.7357588823428847,
    0.9196986029286058,
    0.9810118431238462,
    0.9963401531726563,
    0.9994058151824183,
    0.9999167588507119,
    0.9999897508033253,
    0.9999988747974020,
    0.9999998885745217,
)
#: Eight hex digits per draw: one md5 serves four replicates.
DIGITS, PER_DIGEST = 8, 4


def poisson_count(digits: Column) -> Column:
    """How often a row is drawn, from eight hex digits read as a uniform number.

    Hex digits of equal length sort like the numbers they stand for, so the ladder compares
    text and no digit is ever converted.
    """
    bounds = [format(math.ceil(p * 16**DIGITS), "08x") for p in POISSON_1]
    ladder = F.when(digits < bounds[0], 0)
    for k, bound in enumerate(bounds[1:], start=1):
        ladder = ladder.when(digits < bound, k)
    return ladder.otherwise(len(bounds))


def poisson_resamples(
    df: DataFrame, id_columns: Sequence[str], replicates: int = REPLICATES, seed: int = SEED
) -> DataFrame:
    """Adds ``replicate`` (from 1) and ``weight`` (> 0): the row is in that resample so often.

    The draw depends on the row's id, replicate and seed only, so it is the same on every run
    and after the loss of a task. A resample has the size of the data in expectation.
    """
    ids = [col(c).cast("string") for c in id_columns]
    blocks = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // PER_DIGEST)))
    block = F.col("_block")
    text = F.concat_ws(":", *ids, F.lit(seed).cast("string"), block.cast("string"))
    draws = F.array(
        *[
            F.struct(
                (block * PER_DIGEST + slot + 1).alias("replicate"),
                poisson_count(F.substring("_md5", slot * DIGITS + 1, DIGITS)).alias("weight"),
            )
            for slot in range(PER_DIGEST)
        ]
    )
    digested = spread(df, id_columns).select("*", blocks.alias("_block")).withColumn("_md5", F.md5(text))
    drawn = digested.select(*map(col, df.columns), F.inline(draws))
    return drawn.where((F.col("weight") > 0) & (F.col("replicate") <= replicates))


def exact_resamples(
    df: DataFrame,
    id_columns: Sequence[str],
    replicates: int = REPLICATES,
    seed: int = SEED,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Like :func:`poisson_resamples`, but every resample has exactly the size of the data.

    Rows are numbered in the order of a hash; each row makes one draw of a row number per
    replicate. Draws are counted before they are joined to the rows they hit.
    """
    ids = [col(c) for c in id_columns]
    numbered = stored(
        running_sums(
            df.withColumn("_u", unit_hash(*ids, F.lit(seed))),
            [],
            [("_u", "asc"), *[(c, "asc") for c in id_columns]],
            {"_row": F.lit(1)},
            hot_rows,
            totals=True,
        )
    )
    # One shuffle by row number serves the count of the draws and the join.
    draws = (
        spread(numbered.select(*ids, "_row_total"), id_columns)
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
        .select(
            "replicate",
            (F.floor(unit_hash(*ids, F.lit(seed), F.col("replicate")) * F.col("_row_total")) + 1).alias("_row"),
        )
        .repartition("_row")
        .groupBy("_row", "replicate")
        .agg(F.count(F.lit(1)).cast("int").alias("weight"))
    )
    # Both sides grow with the data, so neither goes through the driver.
    return numbered.hint("merge").join(draws, "_row").drop("_row", "_row_total", "_u")


def bootstrap(
    df: DataFrame,
    metric: Callable[..., DataFrame],
    metrics: Sequence[str],
    id_columns: Sequence[str],
    by: Sequence[str] = (),
    replicates: int = REPLICATES,
    seed: int = SEED,
    exact: bool = False,
    **options,
) -> DataFrame:
    """Mean and population deviation of every metric over the resamples.

    ``metric`` is a function of this package with ``by`` and ``weight``; the replicate is one
    more grouping column for it, so all resamples are scored in one job.
    """
    draw = exact_resamples if exact else poisson_resamples
    sample = draw(df, id_columns, replicates, seed)
    scored = metric(sample, by=[*by, "replicate"], weight="weight", **options)
    long = unpivot_metrics(scored, [*by, "replicate"], metrics)
    return long.groupBy(*map(col, by), "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )


# --- rankings of resamples -----------------------------------------------------------------------


def _drawn(keys: pa.Array, replicates: int) -> pa.Array:
    """The weights of :func:`poisson_resamples` of every row, one byte a replicate."""
    blocks = [f":{block}".encode() for block in range((replicates - 1) // PER_DIGEST + 1)]
    bounds = np.array([math.ceil(p * 16**DIGITS) for p in POISSON_1])
    out = []
    for key in keys.cast(pa.binary()):
        digests = b"".join([hashlib.md5(key.as_py() + block).digest() for block in blocks])
        counts = np.searchsorted(bounds, np.frombuffer(digests, ">u4").astype(np.int64), side="right")
        out.append(counts[:replicates].astype(np.uint8).tobytes())
    return pa.array(out, pa.binary())


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Positives and negatives of every row (side by side) in each replicate."""
    n = batch.num_rows
    y = batch.column("y").to_numpy()[:, None]
    w = np.frombuffer(b"".join(batch.column("weights").to_pylist()), np.uint8).reshape(n, -1).astype(np.float64)
    return w * y, w * (1 - y)


def _slice_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        at = batch.column("slice").to_numpy()
        pos, neg = _cells(batch)
        for k in np.unique(at):
            sums = np.concatenate([pos[at == k].sum(axis=0), neg[at == k].sum(axis=0)])
            found[int(k)] = found[int(k)] + sums if int(k) in found else sums
    rows = [{"slice": k, "sums": v.tolist()} for k, v in found.items()]
    yield pa.RecordBatch.from_pylist(rows, pa.schema([("slice", pa.int32()), ("sums", pa.list_(pa.float64()))]))


class _Ranking:
    """Area, precision steps and weakest point of all replicates, from rows in descending order of their
    scores. Holds one batch; rows of the last score wait for further ones."""

    def __init__(self, before: np.ndarray, total: np.ndarray):
        self.tp, self.fp = before.copy()
        self.total = total
        self.area, self.steps, self.best = np.zeros((3, len(total)))
        self.score, self.pos, self.neg = None, np.zeros((1, len(total))), np.zeros((1, len(total)))

    def add(self, score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        if self.score is not None:
            score = np.concatenate([[self.score], score])
            pos, neg = np.concatenate([self.pos, pos]), np.concatenate([self.neg, neg])
        same = (score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1]))
        starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
        pos, neg = np.add.reduceat(pos, starts), np.add.reduceat(neg, starts)
        self.score, self.pos, self.neg = score[-1], pos[-1:], neg[-1:]
        self._take(pos[:-1], neg[:-1])

    def _take(self, pos: np.ndarray, neg: np.ndarray) -> None:
        if not len(pos):
            return
        tp, fp = self.tp + pos.cumsum(axis=0), self.fp + neg.cumsum(axis=0)
        self.area += (neg * (tp - pos / 2)).sum(axis=0)
        self.steps += (pos * tp / np.maximum(tp + fp, 1)).sum(axis=0)
        self.best = np.maximum(self.best, (tp / np.maximum(np.maximum(tp + fp, self.total), 1)).max(axis=0))
        self.tp, self.fp = tp[-1], fp[-1]

    def result(self) -> pa.RecordBatch:
        self._take(self.pos, self.neg)
        columns = [pa.array(np.arange(1, len(self.total) + 1, dtype=np.int32)), *map(pa.array, (self.area, self.steps, self.best))]
        return pa.RecordBatch.from_arrays(columns, names=["replicate", "area", "steps", "best"])


def bootstrap_ranking(
    df: DataFrame,
    id_columns: Sequence[str],
    y: str = "y",
    p: str = "p",
    replicates: int = REPLICATES,
    seed: int = SEED,
    slices: int | None = None,
) -> DataFrame:
    """What :func:`bootstrap` gives for ``auroc``, ``auprc`` and ``minpse`` with its default draws,
    without a row for each replicate: ``y`` is 0 or 1.

    All resamples share one order of the scores, so rows are dealt once into ``slices`` by ranges of
    scores, with their weights beside them. Positives and negatives of each slice and replicate say
    what lies above a slice; then every slice is gone through in order, all replicates at a time.
    Equal scores lie in one slice; it is read in batches, however many they are.
    """
    spark = df.sparkSession
    slices = slices or SPREAD * spark.sparkContext.defaultParallelism
    key = F.concat_ws(":", *[col(c).cast("string") for c in id_columns], F.lit(str(seed)))
    rows = df.where(col(y).isNotNull()).select(key.alias("key"), col(y).cast("double").alias("y"), col(p).cast("double").alias("p"))
    weights = F.arrow_udf(lambda keys: _drawn(keys, replicates), "binary")(F.col("key")).alias("weights")
    dealt = rows.repartitionByRange(slices, F.desc("p")).select("y", "p", F.spark_partition_id().alias("slice"), weights)
    dealt = stored(dealt)
    totals = np.zeros((slices, 2, replicates))
    # One row for each slice of a task.
    for r in dealt.select("slice", "y", "weights").mapInArrow(_slice_totals, "slice int, sums array<double>").toLocalIterator():
        totals[r["slice"]] += np.array(r["sums"]).reshape(2, replicates)
    before, whole = totals.cumsum(axis=0) - totals, totals.sum(axis=0)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None
        for batch in batches:
            place = batch.column("slice").to_numpy()
            pos, neg = _cells(batch)
            score = batch.column("p").to_numpy(zero_copy_only=False)
            for k in np.unique(place):
                if k != at:
                    if now:
                        yield now.result()
                    at, now = k, _Ranking(before[k], whole[0])
                now.add(score[place == k], pos[place == k], neg[place == k])
        if now:
            yield now.result()

    ordered = dealt.repartition(slices, "slice").sortWithinPartitions("slice", F.desc("p"))
    parts = ordered.mapInArrow(rank, "replicate int, area double, steps double, best double")
    sums = parts.groupBy("replicate").agg(F.sum("area").alias("area"), F.sum("steps").alias("steps"), F.max("best").alias("best"))
    sizes = F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in whole.T])[F.col("replicate") - 1]
    pos, neg = sizes[0], sizes[1]
    scored = sums.select(
        "replicate",
        F.try_divide("area", pos * neg).alias("auroc"),
        F.try_divide("steps", pos).alias("auprc"),
        F.when(pos > 0, F.col("best")).alias("minpse"),
    )
    long = unpivot_metrics(scored, ["replicate"], ["auroc", "auprc", "minpse"])
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


# --- resamples by cells --------------------------------------------------------------------------

#: Rows of a cell up to which its draw is inverted exactly; beyond, by an expansion of the quantile.
EXACT_MEAN = 100
#: A rational approximation of the normal quantile (relative error below 2e-9), as
#: numerators and denominators of the middle and of the tails, highest power first.
MIDDLE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)
TAIL_FROM = 0.02425


def poisson_table(spark: SparkSession, most: int = EXACT_MEAN) -> DataFrame:
    """``(rows, below)``: for each mean up to ``most`` P(at most 0), P(at most 1), … as far as they
    rise. One row per mean."""
    out = []
    for mean in range(1, most + 1):
        term = total = math.exp(-mean)
        below = [total]
        while len(below) <= mean or total + term * mean / len(below) > total:
            term = term * mean / len(below)
            total += term
            below.append(total)
        out.append((mean, below))
    return spark.createDataFrame(out, "rows bigint, below array<double>")


def _ratio(parts: tuple[tuple[float, ...], tuple[float, ...]], x: Column) -> Column:
    def polynomial(factors: tuple[float, ...]) -> Column:
        value = F.lit(factors[0])
        for f in factors[1:]:
            value = value * x + F.lit(f)
        return value

    return polynomial(parts[0]) / polynomial(parts[1])


def normal_quantile(u: Column) -> Column:
    """The number that a standard normal variable stays below with chance ``u`` in (0, 1)."""
    half = u - 0.5
    low, high = F.sqrt(-2 * F.log(u)), F.sqrt(-2 * F.log(1 - u))
    middle = half * _ratio(MIDDLE, half * half)
    return F.when(u < TAIL_FROM, _ratio(TAIL, low)).when(u > 1 - TAIL_FROM, -_ratio(TAIL, high)).otherwise(middle)


def poisson_quantile(u: Column, mean: Column, below: Column) -> Column:
    """A Poisson variable of a whole ``mean`` from a uniform number: the count of cumulative chances
    in ``below`` up to it, or, where that is NULL, an expansion around the normal quantile."""
    z = normal_quantile(u)
    root = F.sqrt(mean.cast("double"))
    value = mean + z * root + (z * z - 1) / 6 + (z - z * z * z) / (72 * root)
    large = F.greatest(F.floor(value + 0.5), F.lit(0))
    return F.when(below.isNull(), large).otherwise(F.size(F.filter(below, lambda c: c <= u))).cast("bigint")


def cell_resamples(
    df: DataFrame,
    cells: Sequence[str],
    replicates: int = REPLICATES,
    seed: int = SEED,
    draw_key: Sequence[Column] | None = None,
) -> DataFrame:
    """``cells`` with ``replicate`` (from 1) and ``weight`` (> 0): how many rows of the cell a resample
    has.

    The weights of ``n`` equal rows add up to one Poisson variable of mean ``n``, so a cell makes a
    single draw per replicate, whatever its size. It depends on ``draw_key`` (by default the cell),
    seed and replicate only; the key must tell cells apart. NULL cells are cells.
    """
    counted = df.groupBy(*map(col, cells)).agg(F.count(F.lit(1)).alias("_rows"))
    key = draw_key or [F.coalesce(col(c).cast("string"), F.lit("\u0000")) for c in cells]
    known = F.broadcast(poisson_table(df.sparkSession).withColumnRenamed("rows", "_rows"))  # EXACT_MEAN rows
    placed = counted.select(*map(col, cells), "_rows", F.concat_ws(":", *key, F.lit(str(seed))).alias("_key")).join(known, "_rows", "left")
    each = spread(placed, cells).select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    u = unit_hash(F.col("_key"), F.col("replicate")) + F.lit(0.5 / 16**HEX_DIGITS)
    drawn = each.withColumn("_u", u).withColumn("weight", poisson_quantile(F.col("_u"), F.col("_rows"), F.col("below")))
    return drawn.where("weight > 0").drop("_rows", "_key", "_u", "below")


def bootstrap_cells(
    df: DataFrame,
    metric: Callable[..., DataFrame],
    metrics: Sequence[str],
    cells: Sequence[str] = ("y", "p"),
    by: Sequence[str] = (),
    replicates: int = REPLICATES,
    seed: int = SEED,
    draw_key: Sequence[Column] | None = None,
    **options,
) -> DataFrame:
    """Like :func:`bootstrap`, for a metric that reads the columns ``cells`` only: rows that agree in
    them are drawn together. Work after one aggregation grows with the cells, not with the rows."""
    sample = cell_resamples(df, [*by, *cells], replicates, seed, draw_key)
    scored = metric(sample, by=[*by, "replicate"], weight="weight", **options)
    long = unpivot_metrics(scored, [*by, "replicate"], metrics)
    return long.groupBy(*map(col, by), "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))

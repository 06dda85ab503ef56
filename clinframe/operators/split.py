"""Record labels, stratified splits without leakage, and selections of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinframe.functions.hashing import unit_hash
from clinframe.operators.skew import BROADCAST_ROWS, HOT_ROWS, null_safe_join, running_sums, skewed_join
from clinframe.schema import VisitSchema, col
from clinframe.session import materialise, stored


def record_label(
    df: DataFrame,
    schema: VisitSchema,
    which: str = "last",
    targets: Sequence[str] | None = None,
) -> DataFrame:
    """One row per record with the targets of its first or last visit."""
    names = list(targets or schema.targets)
    pick = {"first": F.min_by, "last": F.max_by}[which]
    visit = pick(F.struct(*map(col, names)), F.struct(*map(col, schema.order)))
    return df.groupBy(col(schema.key)).agg(visit.alias("_v")).select(schema.key, "_v.*")


def split_quotas(labels: DataFrame, label: str, test: float, val: float) -> DataFrame:
    """Records per label for test and validation: the ceiling of the fraction over all, shared
    out by label size with the largest remainders rounded up. One row per label."""
    every = Window.partitionBy()
    strata = labels.groupBy(col(label)).agg(F.count(F.lit(1)).alias("n"))

    def share(df: DataFrame, size: str, fraction: float, name: str) -> DataFrame:
        total = F.sum(size).over(every)
        df = df.withColumn("_want", F.ceil(F.lit(fraction) * total))
        df = df.withColumn("_share", F.col("_want") * F.col(size) / total)
        df = df.withColumn("_base", F.floor("_share"))
        left = F.col("_want") - F.sum("_base").over(every)
        by_rest = every.orderBy((F.col("_share") - F.col("_base")).desc(), col(label))
        df = df.withColumn(name, F.col("_base") + (F.row_number().over(by_rest) <= left).cast("int"))
        return df.drop("_want", "_share", "_base")

    out = share(strata, "n", test, "n_test").withColumn("_rest", F.col("n") - F.col("n_test"))
    return share(out, "_rest", val, "n_val").drop("_rest")


def stratified_split(
    labels: DataFrame,
    key: str,
    label: str,
    test: float,
    val: float,
    seed: int = 42,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``(key, label, split)`` for one row per record; ``val`` is a fraction of what test leaves.

    Records are taken in the order of a salted hash, so the split depends on ids and seed
    alone. A label with very many records is ranked in slices of the hash. The labels are
    written once: the quotas need their counts before any record can be placed.
    """
    labels = stored(labels.select(col(key), col(label)))
    quotas = materialise(split_quotas(labels, label, test, val))
    strata, largest = quotas.agg(F.count(F.lit(1)), F.max("n")).first()
    placed = running_sums(
        labels.select(col(key), col(label), unit_hash(col(key), F.lit(seed)).alias("_u")),
        [label],
        [("_u", "asc"), (key, "asc")],
        {"_place": F.lit(1)},
        hot_rows,
        largest=largest,
    )
    split = (
        F.when(F.col("_place") <= F.col("n_test"), "test")
        .when(F.col("_place") <= F.col("n_test") + F.col("n_val"), "val")
        .otherwise("train")
    )
    joined = null_safe_join(placed, quotas.drop("n"), [label], hint=strata <= BROADCAST_ROWS)
    return joined.select(col(key), col(label), split.alias("split"))


def apply_split(
    df: DataFrame, split: DataFrame, key: str, rows: int | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Visits with the split of their record; ``rows`` is the number of records, if known."""
    return skewed_join(df, split.select(col(key), "split"), [key], rows, hot_rows)


def rows_of(df: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Rows whose record is listed."""
    return df.join(records.select(col(key)).distinct(), key, "left_semi")


def shared_ids(split: DataFrame, key: str) -> DataFrame:
    """Number of ids found in more than one split; zero when nothing leaks."""
    per_id = split.groupBy(col(key)).agg(
        F.min("split").alias("_a"), F.max("split").alias("_b")
    )
    return per_id.agg(F.count_if(F.col("_a") != F.col("_b")).alias("shared_ids"))


def exclude(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose id is not listed."""
    return df.join(ids.select(col(key)).distinct(), key, "left_anti")


def every_nth(
    df: DataFrame, order: str, n: int = 2, skip: int = 600, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rows at ordinals (from 0, in ``order``) beyond ``skip`` that are multiples of ``n``."""
    numbered = running_sums(df, [], [(order, "asc")], {"_ordinal": F.lit(1)}, hot_rows)
    ordinal: Column = F.col("_ordinal") - 1
    return numbered.where((ordinal > skip) & (ordinal % n == 0)).drop("_ordinal")

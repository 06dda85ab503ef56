"""What several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.schema import col
from clinframe.session import stored

#: Bytes that part words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, whatever the language."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def any_of(words: Iterable[str]) -> str:
    """A pattern for any of ``words`` that looks at each character once."""
    rest: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        if word:
            rest.setdefault(word[0], []).append(word[1:])
    parts = [head + any_of(tails) for head, tails in rest.items()]
    if not parts:
        return ""
    return f"(?:{'|'.join(parts)}){'?' if '' in words else ''}"


#: Column that holds what an operator does not read.
REST = "rest of the row"


def apart(docs: DataFrame, needed: Collection[str]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with all columns but ``needed`` in one struct, so that no name clashes with those an
    operator adds; and a function that gives a result the columns of ``docs`` back, in their order,
    and the ``added`` ones behind them, which replace columns of the same name."""
    kept = [c for c in docs.columns if c in needed]
    rest = [c for c in docs.columns if c not in needed]
    slim = docs.select(*map(col, kept), F.struct(*map(col, rest)).alias(REST)) if rest else docs

    def whole(df: DataFrame, added: Sequence[str] = ()) -> DataFrame:
        new = {c.lower() for c in added}
        names = [c for c in docs.columns if c.lower() not in new]
        return df.select(*[F.col(f"`{REST}`")[c].alias(c) if c in rest else col(c) for c in names], *map(col, added))

    return slim, whole


def shuffle_tasks(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for steps that sort within partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within the block, Spark deletes the shuffle files of a query as soon as it has ended. For
    steps that each write their result to the shared folder: none reads an older shuffle."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): one row (node, label) per node, where
    label is the smallest node of its component.

    Alternates the large-star and small-star steps. A step is a minimum per node, combined before
    its shuffle, and a join that Spark can split where a node is hot. Each round is written to the
    shared folder, so lineage stays short and a lost executor costs one round.
    """
    now = stored(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    while True:
        mark = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
        ).first()
        if mark == before or not mark["n"]:
            break
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = stored(
            both.where("b > a").join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return leaves.unionByName(roots)

"""All patients within a distance of each other, exactly and without rows for pairs.

Rows with equal vectors are one point that counts as often as it occurs. A point belongs to the cell
of its nearest pivot; the triangle inequality says which cells can hold a partner of a point, and
only those does it visit. Within a cell, points lie in blocks by their distance to the pivot, so a
crowded cell is cut into shells and a visitor meets the shells that its own distance allows. A block
meets its visitors in bounded chunks, as a matrix product, and answers each with a number and a
smallest id: what is shuffled grows with visits, not with neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from clinframe.operators.retrieval import DECIMALS
from clinframe.operators.skew import BROADCAST_WIDE_ROWS, HOT_ROWS, running_sums, skewed_join, small
from clinframe.schema import col
from clinframe.session import stored

#: Pivots at most, and their bytes: they go to every executor.
MAX_PIVOTS = 2048
PIVOT_BYTES = 16 * 1024 * 1024
#: Points of one block of a cell, and visitors that meet it in one task. A visitor's vector is sent to
#: each block it visits, so blocks are large; distances computed at a time are not.
BLOCK, VISITORS = 16_384, 8192
DISTANCE_BYTES = 16 * 1024 * 1024
#: Distances are widened by this share before a cell or a shell is ruled out.
SLACK = 1e-7


def _valid(vector: str):
    v = F.col(vector)
    holes = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(holes, F.lit(False))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(squared, 0.0))


def _vectors(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(rows, -1)


def _choose_pivots(points: DataFrame, count: int, dim: int, most: int, block: int) -> np.ndarray:
    """About the square root of the points, the first in the order of a hash; no more than fill a block
    each, as smaller cells only mean more visits."""
    wanted = min(most, max(1, PIVOT_BYTES // (8 * max(1, dim))), max(1, math.isqrt(count)), -(-count // block))
    rows = points.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(wanted).collect()
    return np.array([r["vector"] for r in rows], dtype=np.float64).reshape(len(rows), dim)


def _homes(points: DataFrame, shipped) -> DataFrame:
    """Points with their cell and the distance to its pivot."""
    out = StructType([*points.schema, StructField("cell", IntegerType()), StructField("away", DoubleType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_vectors(batch.column("vector"), batch.num_rows), shipped.value)
                cell = d.argmin(axis=1)
                extra = [pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=out.names)

    return points.mapInArrow(place, out)


def _visits(homes: DataFrame, shipped, radius: float, reach: dict[int, tuple[float, float]]) -> DataFrame:
    """A row for each cell that may hold a partner of a point, with the point's distance to its
    pivot. A partner y of x in the cell of q has |d(x, q) - d(y, q)| <= r and d(y, q) <= d(x, p) + r,
    p being the pivot of x."""
    out = StructType([homes.schema["place"], homes.schema["vector"], StructField("cell", IntegerType()), StructField("d", DoubleType())])
    low = np.array([reach[c][0] if c in reach else math.inf for c in range(len(shipped.value))])
    high = np.array([reach[c][1] if c in reach else -math.inf for c in range(len(shipped.value))])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                d = _distances(_vectors(part.column("vector"), part.num_rows), shipped.value)
                room = radius + SLACK * (1 + radius + d)
                near = part.column("away").to_numpy()[:, None]
                may = (d - room <= high) & (d + room >= low) & (d <= near + 2 * room)
                row, cell = np.nonzero(may)
                for at in range(0, len(row), 4096):
                    r, c = row[at : at + 4096], cell[at : at + 4096]
                    taken = part.take(pa.array(r))
                    yield pa.RecordBatch.from_arrays(
                        [taken.column("place"), taken.column("vector"), pa.array(c, pa.int32()), pa.array(d[r, c])], names=out.names
                    )

    return homes.select("place", "vector", "away").mapInArrow(visit, out)


def _meet(limit: float, out: StructType):
    """Visitors of one block and its points: neighbours and smallest neighbour of each visitor."""

    def meet(visitors: pa.Table, block: pa.Table) -> pa.Table:
        kind = block.schema.field("point").type
        found, counts, least = [], [], []
        if visitors.num_rows and block.num_rows:
            block = block.sort_by("point").combine_chunks()
            y = _vectors(block.column("vector").combine_chunks(), block.num_rows)
            weight, place, y2 = block.column("weight").to_numpy(), block.column("place").to_numpy(), (y * y).sum(axis=1)
            step = max(1, DISTANCE_BYTES // (8 * block.num_rows))
            for start in range(0, visitors.num_rows, step):
                part = visitors.slice(start, step)
                x = _vectors(part.column("vector").combine_chunks(), part.num_rows)
                mine = part.column("place").to_numpy()
                squared = (x * x).sum(axis=1)[:, None] + y2[None, :] - 2 * (x @ y.T)
                near = np.round(np.maximum(squared, 0.0), DECIMALS) <= limit
                # A point is no neighbour of itself; its copies are counted apart.
                near &= mine[:, None] != place[None, :]
                some = np.flatnonzero(near.any(axis=1))
                found.append(mine[some])
                counts.append(near[some].astype(np.int64) @ weight)
                # The block is in the order of its ids, so the first neighbour is the smallest.
                least.append(near[some].argmax(axis=1))
        if not found:
            return pa.table({n: pa.array([], t) for n, t in zip(out.names, (pa.int64(), pa.int64(), kind), strict=True)})
        smallest = block.column("point").take(pa.array(np.concatenate(least)))
        return pa.table([pa.array(np.concatenate(found)), pa.array(np.concatenate(counts)), smallest], names=out.names)

    return meet


def patient_radius(
    vectors: DataFrame,
    radius: float,
    id_column: str = "record_id",
    vector: str = "vector",
    pivots: int = MAX_PIVOTS,
    block: int = BLOCK,
    visitors: int = VISITORS,
    hot_rows: int = HOT_ROWS,
    report: dict | None = None,
) -> DataFrame:
    """``(id, neighbours, smallest)`` of every row: how many other rows lie within ``radius``
    (Euclidean, squared distances compared at ten decimals), and the smallest id among them.

    Rows without an id, and those whose vector is missing, holds missing or infinite elements or is
    shorter than the longest, take no part and get NULL. Rows with equal ids count one by one.
    ``report``, if given, receives points, cells, blocks, visits and the largest block.
    """
    spark = vectors.sparkSession
    rows = vectors.select(col(id_column).alias("id"), col(vector).cast("array<double>").alias("vector"))
    usable = _valid("vector") & F.col("id").isNotNull()
    dim = rows.where(usable).agg(F.max(F.size("vector")).alias("n")).first()["n"] or 0
    usable = usable & (F.size("vector") == dim)
    # Adding zero turns -0.0 into 0.0, so that equal vectors group.
    mine = rows.where(usable).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    numbered = stored(running_sums(mine, ["vector"], [("id", "asc")], {"nth": F.lit(1)}, hot_rows, totals=True))
    firsts = numbered.where("nth <= 2").groupBy("vector").agg(
        F.min(F.when(F.col("nth") == 1, F.col("id"))).alias("point"),
        F.min(F.when(F.col("nth") == 2, F.col("id"))).alias("second"),
        F.max("nth_total").cast("bigint").alias("weight"),
    )
    # Ids may repeat, so points go by a number of their own, given once as the table is written.
    points = stored(firsts.withColumn("place", F.monotonically_increasing_id()))
    count = points.count()
    facts = {"points": count, "cells": 0, "blocks": 0, "visits": 0, "largest_block": 0}
    none = F.lit(None).cast(rows.schema["id"].dataType)
    absent = rows.where(~F.coalesce(usable, F.lit(False))).select("id", F.lit(None).cast("bigint").alias("neighbours"), none.alias("smallest"))
    if count:
        shipped = spark.sparkContext.broadcast(_choose_pivots(points, count, dim, pivots, block))
        homes = stored(_homes(points.select("point", "weight", "place", "vector"), shipped))
        sizes = homes.groupBy("cell").agg(F.min("away").alias("lo"), F.max("away").alias("hi"), F.count(F.lit(1)).alias("n"))
        cells = sizes.collect()  # one row per pivot
        largest = max(r["n"] for r in cells)
        order = [("away", "asc"), ("place", "asc")]
        shelled = running_sums(homes, ["cell"], order, {"nth": F.lit(1)}, hot_rows, largest=largest)
        shelled = stored(shelled.withColumn("block", F.floor((F.col("nth") - 1) / block).cast("bigint")).drop("nth"))
        ends = (F.min("away").alias("lo"), F.max("away").alias("hi"), F.count(F.lit(1)).alias("n"))
        shells = stored(shelled.groupBy("cell", "block").agg(*ends))
        blocks, biggest = shells.agg(F.count(F.lit(1)), F.max("n")).first()
        visits = _visits(homes, shipped, radius, {r["cell"]: (r["lo"], r["hi"]) for r in cells})
        room = radius + SLACK * (1 + radius + F.col("d"))
        shell = small(shells.select("cell", "block", "lo", "hi"), blocks)
        meets = visits.join(shell, "cell").where((F.col("d") - room <= F.col("hi")) & (F.col("d") + room >= F.col("lo")))
        # Counted first and made again: cheaper than to write every visitor's vector as often as it visits.
        chunks = F.ceil(F.count(F.lit(1)) / visitors).cast("bigint")
        called = stored(meets.groupBy("cell", "block").agg(chunks.alias("chunks"), F.count(F.lit(1)).alias("n")))
        facts |= {"cells": len(cells), "blocks": blocks, "largest_block": biggest, "visits": called.agg(F.sum("n")).first()[0]}
        share = small(called.drop("n"), blocks)
        chunked = meets.select("place", "vector", "cell", "block").join(share, ["cell", "block"])
        chunked = chunked.withColumn("chunk", F.pmod(F.xxhash64("place"), F.col("chunks"))).drop("chunks")
        hosts = shelled.join(share, ["cell", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        hosts = hosts.select("point", "vector", "weight", "place", "cell", "block", "chunk")
        out = StructType([StructField("place", LongType()), StructField("n", LongType()), StructField("least", points.schema["point"].dataType)])
        key = ("cell", "block", "chunk")
        met = chunked.groupBy(*key).cogroup(hosts.groupBy(*key)).applyInArrow(_meet(round(radius * radius, DECIMALS), out), out)
        near = met.groupBy("place").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
        classes = stored(points.select("place", "vector", "point", "second").join(near, "place", "left").drop("place"))
        known = skewed_join(numbered, classes, ["vector"], rows=count, hot_rows=hot_rows, bound=BROADCAST_WIDE_ROWS)
        own = F.when(F.col("nth") == 1, F.col("second")).otherwise(F.col("point"))
        others = (F.col("nth_total") - 1 + F.coalesce("n", F.lit(0))).cast("bigint")
        found = known.select("id", others.alias("neighbours"), F.least(own, "least").alias("smallest"))
        absent = found.unionByName(absent)
    if report is not None:
        report |= facts
    return absent.withColumnRenamed("id", id_column)

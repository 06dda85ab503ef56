"""Sliced computations give what a plain window gives, however small the bound."""

from __future__ import annotations

import pytest
from conftest import plan_of, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from clinframe.operators.skew import (
    SLICE,
    carry_forward,
    ordered_slices,
    running_sums,
    skewed_join,
)


@pytest.fixture(scope="module")
def hot(spark):
    """Key 0 holds most rows, crowded at one end of its range and with ties in time."""
    df = spark.range(4000).select(
        F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 10).alias("k"),
        F.floor(F.pow(F.col("id") / 4000.0, 6) * 3000).cast("int").alias("t"),
        F.col("id"),
        F.when(F.col("id") % 7 == 0, F.col("id").cast("double")).alias("v"),
        F.when(F.col("id") % 50 == 3, F.concat(F.lit("s"), F.col("id").cast("string"))).alias("s"),
    )
    return df.repartition(5).cache()


def plain_sum(df, key, desc=False):
    order = [F.col("t").desc() if desc else F.col("t"), F.col("id")]
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("c", F.sum("id").over(w))


@pytest.mark.parametrize("limit", [10**9, 500, 40])
@pytest.mark.parametrize("desc", [False, True])
def test_running_sums(hot, limit, desc):
    out = running_sums(
        hot, ["k"], [("t", "desc" if desc else "asc"), ("id", "asc")], {"c": F.col("id")}, limit, totals=True
    )
    want = plain_sum(hot, ["k"], desc).withColumn("c_total", F.sum("id").over(Window.partitionBy("k")))
    assert rows(out.select(want.columns)) == rows(want)


@pytest.mark.parametrize("limit", [10**9, 300])
def test_running_sums_over_everything(hot, limit):
    out = running_sums(hot, [], [("t", "asc"), ("id", "asc")], {"c": F.col("id")}, limit)
    assert rows(out.select("id", "c")) == rows(plain_sum(hot, []).select("id", "c"))


@pytest.mark.parametrize("limit", [10**9, 500, 40])
def test_carry_forward(hot, limit):
    out = carry_forward(hot, ["k"], [("t", "asc"), ("id", "asc")], ["v", "s"], limit)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = hot.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("v", "s")})
    assert rows(out.select(want.columns)) == rows(want)


def test_slices_follow_the_order_and_split_hot_keys(hot):
    out, cut = ordered_slices(hot, ["k"], [("t", "asc")], 100)
    assert cut
    per_slice = out.groupBy("k", SLICE).agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")
    )
    found = {}
    for k, s, n, lo, hi in sorted(tuple(r) for r in per_slice.collect()):
        # Only rows with one and the same time may stay together beyond the bound.
        assert n <= 100 or lo == hi
        assert found.get(k, -1) < lo
        found[k] = hi
    assert out.count() == hot.count()


def test_known_size_saves_the_check(hot):
    out, cut = ordered_slices(hot, ["k"], [("t", "asc")], 100, largest=50)
    assert not cut and out.select(SLICE).distinct().count() == 1


@pytest.mark.parametrize("limit", [10**9, 200])
def test_skewed_join(spark, hot, limit):
    one = spark.range(0, 9).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("w"))
    many = hot.withColumn("k", F.col("k").cast("int"))
    got = skewed_join(many, one, ["k"], rows=10**7, hot_rows=limit)
    assert rows(got.select("id", "k", "w")) == rows(many.join(one, "k").select("id", "k", "w"))


def test_a_small_side_is_broadcast_and_a_large_one_is_not(spark, hot):
    one = spark.range(0, 9).select(F.col("id").cast("int").alias("k"))
    many = hot.select(F.col("k").cast("int").alias("k"), "id")
    assert "BroadcastHashJoin" in plan_of(skewed_join(many, one, ["k"]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan_of(skewed_join(many, one, ["k"], rows=10**7))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def odd(spark):
    """NULL keys, NaN, infinite and missing places, many ties, and texts to order by."""
    number = (
        F.when(F.col("id") % 11 == 0, F.lit(None).cast("double"))
        .when(F.col("id") % 13 == 0, F.lit(float("nan")))
        .when(F.col("id") % 17 == 0, F.lit(float("inf")))
        .when(F.col("id") % 19 == 0, F.lit(float("-inf")))
        .otherwise(F.floor(F.col("id") / 90).cast("double"))
    )
    return spark.range(900).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"),
        number.alias("x"),
        F.concat(F.lit("patient_"), (F.col("id") * 7919 % 900).cast("string")).alias("name"),
        "id",
        F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"),
    )


@pytest.mark.parametrize("limit", [10, 10**9])
@pytest.mark.parametrize("way", ["asc", "desc"])
def test_missing_keys_and_odd_places_keep_their_rows(odd, limit, way):
    order = [("x", way), ("id", way)]
    sort = [F.col(c).desc() if way == "desc" else F.col(c).asc() for c in ("x", "id")]
    w = Window.partitionBy("k").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    want = odd.withColumns({"c": F.sum("id").over(w), "f": F.last("v", ignorenulls=True).over(w)})
    sums = running_sums(odd, ["k"], order, {"c": F.col("id")}, limit)
    assert rows(sums.select("id", "c")) == rows(want.select("id", "c"))
    filled = carry_forward(odd, ["k"], order, ["v"], limit)
    assert rows(filled.select("id", F.col("v").alias("f"))) == rows(want.select("id", "f"))


@pytest.mark.parametrize("limit", [10, 10**9])
def test_text_order_is_cut_too(odd, limit):
    w = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, 0)
    got = running_sums(odd, [], [("name", "asc")], {"n": F.lit(1)}, limit)
    assert rows(got.select("name", "n")) == rows(odd.select("name", F.count("name").over(w).alias("n")))
    out, cut = ordered_slices(odd, [], [("name", "asc")], limit)
    largest = out.groupBy(SLICE).count().agg(F.max("count")).first()[0]
    assert cut == (limit == 10) and (largest <= 10 or not cut)


def test_mixed_directions_cannot_carry(odd):
    with pytest.raises(ValueError, match="all ascend"):
        carry_forward(odd, ["k"], [("x", "asc"), ("id", "desc")], ["v"])


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows", [10, 10**9])
def test_joins_meet_on_missing_keys(spark, odd, how, hot_rows):
    one = spark.createDataFrame([(None, "n"), (1, "a")], "k long, w string")
    got = skewed_join(odd, one, ["k"], rows=10**7, hot_rows=hot_rows, how=how)
    want = odd.join(one.withColumnRenamed("k", "kk"), F.col("k").eqNullSafe(F.col("kk")), how)
    assert rows(got.select("id", "w")) == rows(want.select("id", "w"))

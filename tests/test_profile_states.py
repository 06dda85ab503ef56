"""States of batches merge to the profile of all rows, in any order and over odd batches."""

from __future__ import annotations

import statistics

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from clinframe.operators import profile

TYPES = "grp string, `a.b` double, none double"


def test_merged_states_equal_the_whole(spark):
    # Far from zero, so that sums of squares would lose their digits.
    values = [1e9 + (k * 37 % 101) / 10 for k in range(90)]
    df = spark.createDataFrame([("xy"[k % 2], v, None) for k, v in enumerate(values)], TYPES).withColumn("n", F.monotonically_increasing_id())
    columns = ["a.b", "none"]
    parts = [df.where("`a.b` < 1000000003"), df.where("`a.b` >= 1000000003"), df.where("false")]
    states = [profile.profile_states(p, "grp", columns) for p in parts]
    twice = profile.merge_states(states[2].unionByName(states[1]), "grp")
    got = profile.profile_of(profile.merge_states(states[0].unionByName(twice), "grp"))
    found = {(r["grp"], r["feature"]): r for r in got.collect()}
    assert len(found) == 4
    for g in (0, 1):
        own, row = values[g::2], found["xy"[g], "a.b"]
        assert row["count"] == len(own) and (row["min"], row["max"]) == (min(own), max(own))
        assert row["mean"] == pytest.approx(statistics.fmean(own), abs=1e-6)
        assert row["std"] == pytest.approx(statistics.stdev(own), rel=1e-6)
        empty = found["xy"[g], "none"]
        assert (empty["count"], empty["mean"], empty["std"], empty["min"]) == (0, None, None, None)


def test_one_row_null_cohorts_and_one_shuffle(spark):
    df = spark.createDataFrame([("x", 2.0, None), (None, 5.0, None)], TYPES)
    states = profile.merge_states(profile.profile_states(df, "grp", ["a.b"]), "grp")
    row = profile.profile_of(states).collect()
    assert [(r["grp"], r["count"], r["mean"], r["std"]) for r in row] == [("x", 1, 2.0, None)]
    assert profile.merge_states(states.where("false"), "grp").count() == 0
    given = spark.createDataFrame(states.collect(), states.schema)
    assert plan_of(profile.merge_states(given, "grp")).count("Exchange") == 1

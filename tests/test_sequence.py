"""Imputation and sequences on edge frames, and their properties."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from clinframe.operators import profile, sequence
from clinframe.queries import inputs
from clinframe.schema import VisitSchema

SCHEMA = VisitSchema(key="id", time="t", tiebreak=("n",), targets=("y",), numeric=("a", "b"))
DDL = "id string, t int, n int, a double, b double, y double"
VISITS = [
    ("gap", 1, 1, None, 1.0, 0.0),
    ("gap", 2, 2, 5.0, None, 0.0),
    ("gap", 3, 3, None, None, 1.0),
    ("none", 1, 4, None, None, 0.0),
    ("none", 2, 5, None, None, 0.0),
    ("one", 1, 6, 7.0, None, 1.0),
    ("tie", 1, 8, None, 2.0, 0.0),
    ("tie", 1, 7, 3.0, None, 1.0),
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(VISITS, DDL).repartition(3)


@pytest.mark.parametrize("limit", [10**9, 1])
def test_forward_fill(frame, limit):
    out = sequence.forward_fill(frame, SCHEMA, fills={"a": F.lit(9.0)}, hot_rows=limit)
    assert rows(out.select("n", "a", "b")) == [
        (1, 9.0, 1.0), (2, 5.0, 1.0), (3, 5.0, 1.0), (4, 9.0, -1.0), (5, 9.0, -1.0),
        (6, 7.0, -1.0), (7, 3.0, -1.0), (8, 3.0, 2.0),
    ]
    again = sequence.forward_fill(out, SCHEMA, hot_rows=limit)
    assert rows(again.select("n", "a", "b")) == rows(out.select("n", "a", "b"))


def test_raw_fill_uses_the_medians_of_the_own_split(spark):
    data = [("x", 1, 1, None, 1.0, 0.0, "val"), ("y", 1, 2, 4.0, 1.0, 0.0, "val"), ("z", 1, 3, None, 1.0, 0.0, "train"), ("w", 1, 4, 10.0, 1.0, 0.0, "train")]
    df = spark.createDataFrame(data, DDL + ", split string")
    own = sequence.raw_fill(df, SCHEMA)
    assert rows(own.select("n", "a")) == [(1, 4.0), (2, 4.0), (3, 10.0), (4, 10.0)]
    fitted = sequence.raw_fill(df, SCHEMA, fit_on="train")
    assert rows(fitted.select("n", "a")) == [(1, 10.0), (2, 4.0), (3, 10.0), (4, 10.0)]


@pytest.mark.parametrize("limit", [10**9, 1])
def test_sequences_masks_and_times(spark, frame, limit):
    seqs = {r["id"]: r for r in sequence.to_sequences(frame, SCHEMA, hot_rows=limit).collect()}
    assert seqs["gap"]["x"] == [[None, 1.0], [5.0, None], [None, None]]
    assert [y["y"] for y in seqs["tie"]["y"]] == [1.0, 0.0]
    masks = {r["id"]: r["mask"] for r in sequence.missing_mask(frame, SCHEMA).collect()}
    assert masks["gap"] == [[1, 0], [0, 1], [1, 1]] and masks["one"] == [[0, 1]]
    dated = frame.withColumn("t", F.expr("date_add(date'2020-01-30', t)"))
    times = {r["id"]: r["times"] for r in sequence.record_times(dated, SCHEMA).collect()}
    assert times["gap"] == ["2020-01-31", "2020-02-01", "2020-02-02"]
    for row in sequence.export_records(dated, SCHEMA).collect():
        assert row["length"] == len(row["x"]) == len(row["mask"]) == len(row["times"]) == len(row["y"])


def test_a_long_record_continues_in_parts(spark):
    df = spark.range(1000).select(
        F.lit("p").alias("id"), F.col("id").alias("t"), F.lit(0).alias("n"),
        F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"), F.lit(0.0).alias("y"),
    )
    parts = sequence.to_sequences(df.repartition(4), SCHEMA, part_visits=128, hot_rows=100).orderBy("part").collect()
    assert [p["length"] for p in parts] == [128] * 7 + [104]
    assert [v[0] for p in parts for v in p["x"]] == [float(k) for k in range(1000)]


def test_padding_golden(spark):
    df = spark.createDataFrame([("a", 3, [[1.0], [2.0], [3.0]]), ("b", 1, [[4.0]])], "id string, length int, x array<array<double>>")
    got = {r["id"]: r for r in sequence.pad_sequences(df, 1).collect()}
    assert got["a"]["valid"] == [True, True, True] and got["b"]["valid"] == [True, False, False]
    assert got["b"]["padded"] == [[4.0], [0.0], [0.0]]
    last = sequence.pad_sequences(df, 1).select("id", sequence.last_step(F.col("padded"), F.col("length")))
    assert rows(last) == [("a", [3.0]), ("b", [4.0])]
    classed = sequence.pad_sequences(df, 1, to=sequence.length_class(F.col("length")))
    assert {r["id"]: len(r["padded"]) for r in classed.collect()} == {"a": 4, "b": 1}


def test_first_and_last_per_column(frame):
    last = {r["id"]: tuple(r)[1:] for r in profile.last_values(frame, SCHEMA, ["a", "b"]).collect()}
    assert last["gap"] == (5.0, 1.0) and last["none"] == (None, None) and last["tie"] == (3.0, 2.0)
    first = {r["id"]: tuple(r)[1:] for r in profile.patient_dim(frame, SCHEMA, ["a", "b"]).collect()}
    assert first["gap"] == (5.0, 1.0)
    visit = {r["id"]: tuple(r)[1:] for r in sequence.last_visit(frame, SCHEMA).collect()}
    assert visit["gap"] == (None, None, 1.0) and visit["tie"] == (None, 2.0, 0.0)


def test_first_note_skips_missing(spark):
    df = spark.createDataFrame([("p", 1, None), ("p", 2, "x"), ("q", 1, None)], "id string, t int, note string")
    assert rows(sequence.first_note(df, VisitSchema(key="id", time="t"), "note")) == [("p", "x"), ("q", None)]


def test_union_folds_is_sorted(spark):
    a = spark.createDataFrame([(3,), (1,)], "id int")
    b = spark.createDataFrame([(2,)], "id int")
    got = sequence.union_folds({"train": a, "val": b}, "id").collect()
    assert [tuple(r) for r in got] == [(1, "train"), (2, "val"), (3, "train")]


def test_no_gap_survives_and_layout_does_not_matter(spark, sf):
    visits = inputs.visits(spark, sf)
    one = sequence.forward_fill(visits.repartition(1), inputs.VISITS)
    many = sequence.forward_fill(visits.repartition(16), inputs.VISITS, hot_rows=7)
    assert one.where(" or ".join(f"{f} is null" for f in inputs.LABS)).count() == 0
    keep = ["event_id", *inputs.LABS]
    assert rows(one.select(keep)) == rows(many.select(keep))


@pytest.mark.parametrize("group_rows", [10**9, 0])
def test_cohort_profile_with_missing_values(spark, group_rows):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (0, None), (1, None), (None, 9.0)], "g int, a double")
    got = {r["g"]: r for r in profile.cohort_profile(df, "g", ["a"], group_rows).collect()}
    assert set(got) == {0, 1}
    assert (got[0]["count"], got[0]["mean"], got[0]["p25"], got[0]["max"]) == (2, 2.0, 1.5, 3.0)
    assert got[1]["count"] == 0 and got[1]["p50"] is None

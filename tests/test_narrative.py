"""Descriptions against the same rules written in plain Python."""

from __future__ import annotations

import pytest
from conftest import plan_of, rows
from pyspark.sql import functions as F

from clinframe.functions import fixed_values as fixed
from clinframe.functions import narrative as n


def column(spark, values, expression, ddl="double"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {ddl}")
    return [r[0] for r in df.orderBy("k").select(expression).collect()]


def value():
    return F.col("v")


def test_number_text(spark):
    got = column(spark, [1.5, 2.0, 3.14159, -0.001, None, 100.0, 0.1], n.number_text(value()))
    assert got == ["1.5", "2.0", "3.14", "0.0", "nan", "100.0", "0.1"]
    assert column(spark, [0.5, 0.12345, 1.0, 0.05], n.number_text(value(), 3)) == ["0.5", "0.123", "1.0", "0.05"]


def test_change(spark):
    assert column(spark, [0.1234, -0.5, 0.0], n.pct_change_desc(value())) == [12.34, 50.0, 0.0]
    assert column(spark, [1.0, -1.0, 0.0, None], n.trend_desc(value())) == ["increased", "decreased", "decreased", None]
    assert column(spark, [1.0, -1.0, 0.0], n.advice_desc(value())) == ["decrease", "increase", "increase"]


def test_range(spark):
    got = column(spark, [80.0, 100.0, 150.0, 96.0, 106.0], n.range_desc(value(), F.lit(96.0), F.lit(106.0)))
    assert got == [
        "the value is lower than normal range by 16.67%",
        "the value is within the normal range",
        "the value is higher than normal range by 41.51%",
        "the value is within the normal range",
        "the value is within the normal range",
    ]
    none = F.lit(None).cast("double")
    assert column(spark, [1.0], n.range_desc(value(), none, none)) == [""]


def test_versus_cohort(spark):
    assert column(spark, [50.0, 150.0, 100.0, None], n.vs_cohort_desc(value(), F.lit(100.0))) == [
        "50.0% lower", "50.0% higher", "equal", None,
    ]
    assert column(spark, [50.0], n.vs_cohort_desc(value(), F.lit(0.0))) == [None]


def test_levels_and_bands_at_their_bounds(spark):
    got = column(spark, [0.0, 0.4999, 0.5, 0.6999, 0.7, 1.0, None], n.risk_level(value()))
    assert got == ["a low level"] * 2 + ["a high level"] * 2 + ["an extremely high level"] * 2 + [None]
    got = column(spark, [0.399, 0.4, 0.699, 0.7], n.rank_band(value()))
    assert got == ["at the bottom 40% levels", "at the middle 30% levels", "at the middle 30% levels", "at the top 30% levels"]


def test_demographics(spark):
    assert column(spark, ["IGA肾病 II", "DN", "else"], n.original_disease(value()), "string") == ["IGA nephropathy", "DN", None]
    flags = spark.createDataFrame([(1, 0, 1)], "Diabetes int, MI int, CI int")
    for name in fixed.COMORBIDITIES:
        if name not in flags.columns:
            flags = flags.withColumn(name, F.lit(0))
    assert flags.select(n.comorbidities()).first()[0] == "Diabetes, Cerebral infarction"
    assert column(spark, [1, 0], n.sex_word(value()), "int") == ["male", "female"]
    assert column(spark, ["é" * 2000, "short"], F.length(n.truncate_note(value())), "string") == [1024, 5]


def test_top_features(spark):
    data = [("a", 0, 0.1), ("a", 1, -0.9), ("a", 2, 0.9), ("a", 3, 0.5), ("b", 0, 0.0)]
    df = spark.createDataFrame(data, "id string, position int, weight double")
    top = n.top_features(df, ["id"])
    assert rows(top.select("id", "position", "attention", "rank")) == [
        ("a", 1, 0.9, 1), ("a", 2, 0.9, 2), ("a", 3, 0.5, 3), ("b", 0, 0.0, 1),
    ]
    assert "WindowGroupLimit" in plan_of(top)


def test_series_text(spark):
    df = spark.createDataFrame([("p", [[1.5, 100.0], [2.0, None]])], "id string, x array<array<double>>")
    got = {r["feature"]: r["text"] for r in n.series_text(df, ["WBC", "Weight"]).collect()}
    assert got["WBC"] == (
        '- White blood cells: "1.5, 2.0". Measured in ×10^9/L. The healthy lie between '
        "3.5 ×10^9/L and 9.5 ×10^9/L. "
    )
    assert got["Weight"] == '- Weight: "100.0, nan". Measured in kg. Under dialysis: higher than 59 kg.'
    assert "Exchange" not in plan_of(n.series_text(df, ["WBC"]))


def test_comparison_and_context(spark):
    top = spark.createDataFrame([("p", "m", "K", 1, 0.25, 4.0)], "id string, model string, feature string, rank int, attention double, value double")
    centers = spark.createDataFrame([("K", 5.0, 4.0)], "feature string, survival double, deceased double")
    compared = n.feature_comparison(top, centers)
    text = compared.first()["text"]
    assert text == (
        "K stands at 4.0 and weighs 0.25. Survivors center on 5.0: 20.0% lower. The deceased center on 4.0: equal."
    )
    context = n.patient_context(
        spark.createDataFrame([("p", "Basics")], "id string, basic string"),
        spark.createDataFrame([("p", 0, "Series")], "id string, part int, series string"),
        spark.createDataFrame([("p", "m", 0.55, 0.9)], "id string, model string, p double, share double"),
        compared,
        "id",
    ).first()["context"]
    assert context.split("\n") == [
        "Basics",
        "Series",
        "Model m puts the risk at 0.55 (a high level; at the top 30% levels of the cohort).",
        text,
    ]


def test_fixed_tables_name_known_labs():
    labs = set(fixed.DIALYSIS_LABS)
    for table in (fixed.DISPLAY_NAMES, fixed.UNITS, fixed.HEALTHY_RANGES, fixed.DIALYSIS_RANGES):
        assert set(table) <= labs
    for table in (fixed.ICU_RANGES, fixed.ICU_UNITS):
        assert set(table) <= set(fixed.ICU_NUMERIC_LABS)


def test_descriptions_run_in_the_jvm(spark):
    df = spark.range(5).select((F.col("id") / 5).alias("v"))
    plan = plan_of(df.select(n.risk_level(value()), n.number_text(value()), n.vs_cohort_desc(value(), F.lit(0.4))))
    assert "Python" not in plan and "ArrowEval" not in plan


@pytest.mark.parametrize("number", [1e30, float("inf"), float("nan")])
def test_numbers_beyond_decimals_do_not_fail(spark, number):
    assert column(spark, [number], n.number_text(value())) == ["nan"]

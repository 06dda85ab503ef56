"""Fitted models on a planted signal, sources and sinks, and the whole preparation."""

from __future__ import annotations

import json

import numpy as np
import pytest
from conftest import plan_of, rows
from pyspark.sql import functions as F

from clinframe.operators import metrics, models
from clinframe.plans.cohort import prepare_cohort
from clinframe.queries import inputs
from clinframe.schema import VisitSchema
from clinframe.session import stored
from clinframe.sources import corpus, tables, visits


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.5 * rng.normal(size=400) > 0).astype(float)
    data = [(k, float(a), float(b), float(t), float(3 * a)) for k, ((a, b), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id int, a double, b double, y double, los double").cache()


def test_logistic_and_trees_beat_chance(signal):
    for model in (
        models.fit_logistic(signal, ["a", "b"], "y"),
        models.fit_gbt(signal, ["a", "b"], "y", trees=5, depth=3),
    ):
        scored = models.score(model, signal, ["a", "b"])
        assert metrics.ranking_metrics(scored).first()["auroc"] > 0.85


def test_logistic_minimises_the_penalised_sum_of_losses(signal):
    model = models.fit_logistic(signal, ["a", "b"], "y")
    w = np.array(models.coefficients(model))
    data = np.array([tuple(r) for r in signal.select("a", "b", "y").collect()])
    b = model.intercept
    p = 1 / (1 + np.exp(-(data[:, :2] @ w + b)))
    gradient = data[:, :2].T @ (p - data[:, 2]) + w
    assert np.abs(gradient).max() < 0.05


def test_tree_regression(signal):
    model = models.fit_gbt(signal, ["a", "b"], "los", task="los", trees=10, depth=3)
    scored = models.score(model, signal, ["a", "b"], "p_los").withColumn("y_los", F.col("los"))
    assert metrics.regression_metrics(scored).first()["r2"] > 0.8


def test_attributions_add_up_to_the_margin(signal):
    model = models.fit_logistic(signal, ["a", "b"], "y")
    w = models.coefficients(model)
    parts = models.attribute_linear(signal, "id", ["a", "b"], w, signal)
    total = parts.groupBy("id").agg(F.sum("weight").alias("m"))
    means = signal.agg(F.avg("a"), F.avg("b")).first()
    for r in total.join(signal, "id").limit(20).collect():
        assert r["m"] == pytest.approx(w[0] * (r["a"] - means[0]) + w[1] * (r["b"] - means[1]))


def test_fusion(spark, signal):
    ehr = {m: signal.select("id", F.array("a", "b").alias("vector")) for m in ("one", "two")}
    text = signal.where("id % 2 = 0").select("id", F.array("b", "b", "b").alias("vector"))
    fused = models.fusion_features(ehr, text, "id", 3)
    wide = {r["id"]: r["features"] for r in fused.collect()}
    assert len(wide) == 400 and len(wide[1]) == 7 and wide[1][4:] == [0.0] * 3 and wide[2][4] == wide[2][1]
    data = stored(fused.join(signal.select("id", F.col("y").alias("label")), "id"))
    model, log = models.fit_fusion(data.where("id % 4 > 0"), data.where("id % 4 = 0"), widths=(2, 4), iterations=20)
    assert {r["width"] for r in log.collect()} == {2, 4} and max(r["auprc"] for r in log.collect()) > 0.8
    assert model.numFeatures == 7


# --- sources and sinks -------------------------------------------------------------------------------------


def test_csv_needs_its_schema(spark, tmp_path):
    df = spark.createDataFrame([("p", 1.5), ("q", None)], "`id %` string, `a.b` double")
    df.write.option("header", True).csv(f"{tmp_path}/v")
    assert rows(visits.read_visits(spark, f"{tmp_path}/v", "csv", df.schema)) == rows(df)
    with pytest.raises(ValueError):
        visits.read_visits(spark, f"{tmp_path}/v", "csv")
    with pytest.raises(ValueError):
        visits.read_visits(spark, f"{tmp_path}/v", "xlsx")


def test_corpora(spark, tmp_path):
    docs = [{"title": f"t{k}", "content": f"c{k}"} for k in range(5)]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "one.jsonl").write_text("\n".join(json.dumps(d) for d in docs[:3]))
    (tmp_path / "lines" / "two.jsonl").write_text("\n".join(json.dumps(d) for d in docs[3:]) + "\n")
    got = corpus.read_corpus(spark, f"{tmp_path}/lines", "c")
    assert rows(got.select("doc_id", "source", "idx", "title", "content")) == [
        (f"c/{s}/{i}", s, i, f"t{k}", f"c{k}")
        for k, (s, i) in enumerate([("one", 0), ("one", 1), ("one", 2), ("two", 0), ("two", 1)])
    ]
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "x.json").write_text(json.dumps(docs[0], indent=2))
    (tmp_path / "files" / "y.json").write_text(json.dumps(docs[1], indent=2))
    got = corpus.read_corpus(spark, f"{tmp_path}/files", "c", lines=False)
    assert rows(got.select("doc_id", "title")) == [("c/x/0", "t0"), ("c/y/0", "t1")]


def test_tables_are_partitioned_and_rewritten_by_partition(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "val")], "id int, split string")
    path = tables.write_table(df, f"{tmp_path}/t", ["split"])
    tables.write_table(spark.createDataFrame([(3, "val")], "id int, split string"), path, ["split"])
    back = spark.read.parquet(path)
    assert rows(back.select("id", "split")) == [(1, "train"), (3, "val")]
    assert "PartitionFilters: [isnotnull(split" in plan_of(back.where("split = 'val'"))


def test_pending(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    assert rows(visits.pending(df, spark.createDataFrame([("a",), ("a",)], "id string"), "id")) == [("b",)]


# --- the whole preparation -----------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [10**9, 50])
def test_prepared_cohort(spark, sf, limit):
    out = prepare_cohort(inputs.visits(spark, sf), inputs.VISITS, "outcome", 0.2, 0.25, los="los", hot_rows=limit)
    seqs = out.sequences.collect()
    assert sum(r["length"] for r in seqs) == inputs.visits(spark, sf).count()
    assert {r["split"] for r in seqs} == {"train", "val", "test"}
    assert all(v is not None for r in seqs for step in r["x"] for v in step)
    raw = {(r["user_id"], r["part"]): r for r in out.raw.collect()}
    for r in seqs:
        mask = raw[r["user_id"], r["part"]]["mask"]
        assert [len(m) for m in mask] == [5] * r["length"]
    assert out.los_info.count() == 1 and out.summaries.count() == 2 * 5


def test_preparation_with_categorical_labs(spark, sf):
    frame = inputs.order_visits(spark, sf)
    out = prepare_cohort(frame, inputs.ORDER_VISITS, "outcome", 1 / 100, 4 / 99)
    assert "o_orderstatus->F" in out.schema.numeric and out.schema.categorical == ()
    width = len(out.schema.features)
    assert {len(v) for r in out.sequences.collect() for v in r["x"]} == {width}


def test_fitting_reads_only_the_train_partition(spark, sf):
    out = prepare_cohort(inputs.visits(spark, sf), inputs.VISITS, "outcome", 0.2, 0.25)
    plan = plan_of(out.visits.where("split = 'train'").agg(F.avg("f_click")))
    assert "PartitionFilters: [isnotnull(split" in plan
    assert "ReadSchema: struct<f_click:double>" in plan


def test_dotted_and_blank_names(spark):
    schema = VisitSchema(key="id", time="t", targets=("y",), numeric=("K+ -- x.y %", "a  "))
    data = [(f"p{k % 7}", k, float(k % 2), float(k), None if k % 3 else float(k)) for k in range(70)]
    df = spark.createDataFrame(data, "id string, t int, y double, `K+ -- x.y %` double, `a  ` double")
    df = df.withColumn("t", F.expr("date_add(date'2020-01-01', t)"))
    out = prepare_cohort(df, schema, "y", 0.2, 0.25)
    assert out.sequences.count() == 7
    model = models.fit_logistic(df.fillna(0.0), schema.numeric, "y")
    assert models.score(model, df.fillna(0.0), schema.numeric).count() == 70


def test_presets_have_the_published_widths():
    from clinframe import presets

    icu, covid, dialysis = presets.ICU.schema, presets.COVID.schema, presets.DIALYSIS.schema
    assert len(icu.labs) == 17 and len(icu.categorical) == 5
    assert len(covid.labs) == 97 and len(set(covid.labs)) == 97 and len(dialysis.labs) == 17


@pytest.mark.parametrize("name", ["ICU", "COVID", "DIALYSIS"])
def test_presets_run_end_to_end(spark, name):
    """Wide frames with odd names go through the whole preparation."""
    from clinframe import presets

    preset = getattr(presets, name)
    s = preset.schema
    k = F.col("id")
    frame = spark.range(120).select(
        F.format_string("p%d", k % 30).alias(s.patient or s.key),
        *([(k % 2).alias(s.admission)] if s.admission else []),
        F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, int(id))").alias(s.time),
        *[(k % 2).cast("double").alias(t) for t in s.targets],
        *[(k % (50 if t in s.scaled_static else 2)).cast("double").alias(t) for t in s.static],
        *[F.when(k % 3 != j % 3, (k * (j + 1) % 17).cast("double")).alias(t) for j, t in enumerate(s.numeric)],
        *[F.when(k % 4 != j % 4, (k % (j + 2)).cast("string")).alias(t) for j, t in enumerate(s.categorical)],
    )
    shaped = visits.select_schema(frame, s)
    out = prepare_cohort(shaped, s, preset.label, 0.2, 0.25, los=preset.los, drop_empty=preset.drop_empty)
    rows_ = out.sequences.collect()
    assert sum(r["length"] for r in rows_) == 120
    assert {len(v) for r in rows_ for v in r["x"]} == {len(out.schema.features)}
    for j, t in enumerate(s.static):
        # Codes stay as they are; ages are scaled.
        assert ({v[j] for r in rows_ for v in r["x"]} == {0.0, 1.0}) == (t not in s.scaled_static)

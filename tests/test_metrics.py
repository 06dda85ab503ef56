"""Scores: worked examples, brute force, edge frames and invariants."""

from __future__ import annotations

import math
import random

import pytest
from conftest import plan_of
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from clinframe.operators import bootstrap, fairness, metrics
from clinframe.plans import evaluation
from clinframe.queries import QUERIES, scores


def preds(spark, pairs):
    return spark.createDataFrame([(int(y), float(p)) for y, p in pairs], "y int, p double")


def brute(pairs):
    """Scores by definition: all pairs for the area, one threshold at a time for the rest."""
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    area = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    precision, weakest, recall_before = 0.0, 0.0, 0.0
    for t in sorted({p for _, p in pairs}, reverse=True):
        tp, called = sum(p >= t for p in pos), sum(p >= t for _, p in pairs)
        precision += tp / called * (tp / len(pos) - recall_before)
        recall_before = tp / len(pos)
        weakest = max(weakest, min(tp / called, tp / len(pos)))
    tp = sum(p > 0.5 for p in pos)
    fp = sum(p > 0.5 for p in neg)
    return {
        "auroc": area,
        "auprc": precision,
        "minpse": weakest,
        "accuracy": (tp + len(neg) - fp) / len(pairs),
        "f1": 2 * tp / (tp + fp + len(pos)) if tp + fp + len(pos) else 0.0,
    }


def sample(seed, n=300, levels=None):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        y = rng.random() < 0.3
        p = min(0.999, max(0.001, 0.6 * rng.random() + 0.3 * y))
        out.append((int(y), round(p * levels) / levels if levels else p))
    return out


@pytest.mark.parametrize("levels", [None, 10])
@pytest.mark.parametrize("limit", [10**9, 30])
def test_binary_metrics_by_definition(spark, levels, limit):
    pairs = sample(1, levels=levels)
    got = metrics.binary_metrics(preds(spark, pairs), hot_rows=limit).first().asDict()
    assert got == pytest.approx(brute(pairs))


def test_grouped_equals_each_alone(spark):
    a, b = sample(2), sample(3)
    df = preds(spark, a).withColumn("g", F.lit("a")).union(preds(spark, b).withColumn("g", F.lit("b")))
    for row in metrics.binary_metrics(df, ["g"]).collect():
        got = row.asDict()
        assert got.pop("g") in "ab"
        assert got == pytest.approx(brute(a if row["g"] == "a" else b))


def test_average_precision_is_not_the_trapezoid(spark):
    df = preds(spark, sample(4))
    got = metrics.ranking_metrics(df).first()
    raw = df.withColumn("rawPrediction", F.col("p")).withColumn("label", F.col("y").cast("double"))
    spark_ml = BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(raw)
    trapezoid = BinaryClassificationEvaluator(metricName="areaUnderPR").evaluate(raw)
    assert got["auroc"] == pytest.approx(spark_ml, abs=1e-9)
    assert abs(got["auprc"] - trapezoid) > 1e-6


def test_mirrored_scores_and_row_order(spark):
    df = preds(spark, sample(5))
    up = metrics.ranking_metrics(df.repartition(16)).first()
    down = metrics.ranking_metrics(df.withColumn("p", 1 - F.col("p")).repartition(1)).first()
    assert up["auroc"] + down["auroc"] == pytest.approx(1.0)
    assert metrics.ranking_metrics(df.repartition(1)).first() == pytest.approx(up)


def test_edge_frames(spark):
    one_class = metrics.binary_metrics(preds(spark, [(0, 0.1), (0, 0.9)])).first()
    assert one_class["f1"] == 0.0 and one_class["accuracy"] == 0.5
    assert one_class["auroc"] is None and one_class["auprc"] is None and one_class["minpse"] is None
    equal = metrics.binary_metrics(preds(spark, [(1, 0.5), (0, 0.5)])).first()
    assert equal["auroc"] == 0.5 and equal["auprc"] == 0.5 and equal["accuracy"] == 0.5  # 0.5 is negative
    empty = metrics.class_metrics(preds(spark, [])).first()
    assert empty["accuracy"] is None


def test_weights_stand_for_repeated_rows(spark):
    pairs = sample(6, 80, levels=20)
    weighted = spark.createDataFrame([(y, p, k % 3 + 1) for k, (y, p) in enumerate(pairs)], "y int, p double, w int")
    repeated = weighted.withColumn("r", F.explode(F.sequence(F.lit(1), F.col("w"))))
    for score in (metrics.binary_metrics, metrics.class_metrics):
        assert score(weighted, weight="w").first() == pytest.approx(score(repeated).first())
    stays = weighted.select(F.col("p").alias("y_los"), (F.col("y") * 0.7).alias("p_los"), "w")
    more = stays.withColumn("r", F.explode(F.sequence(F.lit(1), F.col("w"))))
    assert metrics.regression_metrics(stays, weight="w").first() == pytest.approx(metrics.regression_metrics(more).first())


def test_curves_end_at_full_recall(spark):
    rows = metrics.pr_curve(preds(spark, sample(7))).orderBy("score").collect()
    assert rows[0]["recall"] == 1.0
    roc = metrics.roc_curve(preds(spark, sample(7))).orderBy("score").collect()
    assert roc[0]["fpr"] == roc[0]["tpr"] == 1.0


def test_worked_examples(spark):
    df = spark.createDataFrame([(0, 0.7, 5.0, 10.0), (1, 0.7, 5.0, 10.0)], "y int, p double, y_los double, p_los double")
    assert metrics.early_score(df, [10.0]).first()["es"] == pytest.approx(0.8)
    one = spark.createDataFrame([(1, 0.7, 60.0, 10.0)], "y int, p double, y_los double, p_los double")
    assert metrics.osmae(one, 110.0, [10.0]).first()["osmae"] == pytest.approx(25.0)
    late = spark.createDataFrame([(1, 0.1, -4.0, 0.0)], "y int, p double, y_los double, p_los double")
    assert metrics.losses(late).first()["time_aware_loss"] == pytest.approx(-math.log(0.1) * math.exp(0.4) + 0.36)


def test_early_score_bounds(spark):
    ddl = "y int, p double, y_los double"
    bad = spark.createDataFrame([(1, 0.1, 0.5)] * 3 + [(1, 0.9, 0.1)], ddl)
    assert metrics.early_score(bad, [10.0]).first()["es"] == -1.0
    none = spark.createDataFrame([(0, 0.9, 5.0)], ddl)
    assert metrics.early_score(none, [10.0]).first()["es"] == 0.0


def test_log_loss_stops_at_the_floor(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (0, 1.0, 0.0, 0.0)], "y int, p double, y_los double, p_los double")
    assert metrics.losses(df).first()["log_loss"] == pytest.approx(100.0)


#: Twenty hundredths with a mean of 0.0535; as doubles they add up to less in this order, and to more in the reverse.
BETWEEN = (0, 0, 0, 2, 2, 3, 3, 3, 6, 6, 6, 7, 7, 8, 8, 8, 8, 10, 10, 10)


@pytest.mark.parametrize("parts", [1, 4])
def test_mean_between_two_thousandths_goes_up(spark, parts):
    for order in (BETWEEN, BETWEEN[::-1]):
        log = spark.createDataFrame([(v / 100,) for v in order], "x double").repartition(parts)
        assert log.agg(scores.mean_thousandths("x")).first()[0] == 0.054
    log = spark.createDataFrame([(v,) for v in [0.0494, 0.0495, 0.0495, 0.0495]], "x double")
    assert log.agg(scores.mean_thousandths("x")).first()[0] == 0.049


def test_best_checkpoint_of_equal_means_in_two_orders(spark, tmp_path):
    items = [(1, epoch, v / 100) for epoch, order in ((1, BETWEEN), (2, BETWEEN[::-1])) for v in order]
    lines = spark.createDataFrame(items, "l_suppkey bigint, l_linenumber int, l_discount double")
    lines.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("best_checkpoint", "best_checkpoint_los"):
        assert tuple(QUERIES[name](spark, str(tmp_path)).first()) == (1, 1, 0.054)


def test_best_checkpoint_takes_the_first_of_equals(spark):
    log = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7), ("a", 3, 0.7), ("a", 4, None)], "g string, epoch int, s double")
    assert tuple(metrics.best_checkpoint(log, ["g"], "epoch", "s").first()) == ("a", 2, 0.7)
    assert tuple(metrics.best_checkpoint(log, ["g"], "epoch", "s", "min").first()) == ("a", 1, 0.5)


@pytest.mark.parametrize("limit", [10**9, 20])
def test_percentile_rank(spark, limit):
    pairs = sample(8, 120, levels=25)
    df = preds(spark, pairs).withColumn("g", F.lit(1))
    values = sorted(p for _, p in pairs)
    for row in metrics.percentile_rank(df, ["g"], hot_rows=limit).collect():
        assert row["share"] == pytest.approx(sum(v <= row["p"] for v in values) / len(values))


def test_metrics_never_sort_raw_rows_in_one_task(spark):
    """The single-task window sees distinct scores only, and none at all beyond the bound."""
    df = spark.range(5000).select((F.col("id") % 2).alias("y"), (F.col("id") / 5000).alias("p"))
    plan = plan_of(metrics.curve(df, hot_rows=100))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "hashpartitioning(_slice" in plan


# --- fairness ----------------------------------------------------------------------------------------------

DDL = "y int, p double, a int"


def fair(spark, data):
    df = spark.createDataFrame(data, DDL)
    return fairness.fairness_report(df, {"a": F.col("a") == 1}).first()


def test_fairness_by_hand(spark):
    got = fair(spark, [(1, 0.5, 1), (0, 0.9, 1), (1, 0.1, 1), (0, 0.2, 1), (1, 0.8, 0), (0, 0.1, 0), (0, 0.3, 0), (1, 0.4, 0)])
    # privileged: called 2/4, tpr 1/2, fpr 1/2; others: called 1/4, tpr 1/2, fpr 0/2
    assert (got["di"], got["aod"], got["eod"], got["spd"]) == (0.5, 0.25, 0.0, 0.25)


def test_fairness_of_empty_and_silent_groups(spark):
    empty = fair(spark, [(1, 0.9, 1), (0, 0.1, 1)])
    assert empty["di"] is None and empty["spd"] is None and empty["eod"] == 1.0
    silent = fair(spark, [(1, 0.1, 1), (1, 0.2, 0)])
    assert silent["di"] is None and silent["spd"] == 0.0


def test_all_attributes_share_one_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/customer.parquet").select(
        (F.col("c_custkey") % 2).alias("y"), F.lit(0.7).alias("p"), "c_acctbal", "c_nationkey"
    )
    plan = plan_of(fairness.fairness_report(df, {"a": F.col("c_acctbal") > 0, "b": F.col("c_nationkey") < 5}))
    assert plan.count("FileScan") == 1


# --- bootstrap ---------------------------------------------------------------------------------------------


def numbered(spark, n=400):
    pairs = sample(9, n)
    return spark.createDataFrame([(k, y, p) for k, (y, p) in enumerate(pairs)], "id int, y int, p double")


def test_poisson_weights(spark):
    df = numbered(spark)
    out = bootstrap.poisson_resamples(df, ["id"], 50)
    assert out.agg(F.countDistinct("replicate")).first()[0] == 50
    total = out.agg(F.sum("weight")).first()[0]
    assert abs(total / (400 * 50) - 1) < 0.02
    kept = out.count() / (400 * 50)
    assert abs(kept - (1 - math.exp(-1))) < 0.02


def test_poisson_ladder_matches_the_uniform_number(spark):
    df = spark.range(2000).select(F.substring(F.md5(F.col("id").cast("string")), 1, 8).alias("d"))
    got = df.select("d", bootstrap.poisson_count(F.col("d")).alias("w")).collect()
    for row in got:
        u = int(row["d"], 16) / 2**32
        assert row["w"] == sum(u >= b for b in bootstrap.POISSON_1)


@pytest.mark.parametrize("limit", [10**9, 50])
def test_exact_resamples_have_the_size_of_the_data(spark, limit):
    out = bootstrap.exact_resamples(numbered(spark), ["id"], 7, hot_rows=limit)
    sizes = out.groupBy("replicate").agg(F.sum("weight").alias("n")).collect()
    assert [r["n"] for r in sizes] == [400] * 7


def test_exact_resamples_send_no_table_to_the_driver(spark):
    out = bootstrap.exact_resamples(numbered(spark), ["id"], 3)
    out.collect()
    assert "Broadcast" not in plan_of(out)


@pytest.mark.parametrize("exact", [False, True])
def test_bootstrap_is_repeatable_and_centred(spark, exact):
    df = numbered(spark)
    names = ("auroc", "auprc", "accuracy")
    run = lambda d, seed=42: {
        (r["metric"], part): r[part]
        for part in ("mean", "std")
        for r in bootstrap.bootstrap(d, metrics.binary_metrics, names, ["id"], replicates=30, seed=seed, exact=exact, largest=400).collect()
    }
    first = run(df)
    assert run(df.repartition(7)) == pytest.approx(first)
    assert run(df, 43) != first
    whole = metrics.binary_metrics(df).first()
    for name in names:
        mean, std = first[name, "mean"], first[name, "std"]
        assert abs(mean - whole[name]) < 3 * std and 0 < std < 0.1


@pytest.mark.parametrize("slices", [1, 5])
def test_rankings_of_resamples_in_slices(spark, monkeypatch, slices):
    # Rounded scores tie, also across batches; one id draws for several rows.
    df = numbered(spark).withColumn("p", F.round("p", 1)).withColumn("id", F.col("id") % 390)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = bootstrap.bootstrap_ranking(df, ["id"], replicates=9, slices=slices).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = bootstrap.bootstrap(df, metrics.ranking_metrics, ("auroc", "auprc", "minpse"), ["id"], replicates=9, largest=400).collect()
    assert {r["metric"]: (pytest.approx(r["mean"]), pytest.approx(r["std"])) for r in want} == {r["metric"]: (r["mean"], r["std"]) for r in got}


def test_rankings_of_resamples_of_one_class(spark):
    got = {r["metric"]: r["mean"] for r in bootstrap.bootstrap_ranking(preds(spark, [(0, 0.1), (0, 0.2)]), ["p"], replicates=8).collect()}
    assert got["auroc"] is None and got["auprc"] is None and got["minpse"] is None


def test_report_of_both_tasks(spark):
    df = numbered(spark).withColumn("model", F.lit("m"))
    report = evaluation.evaluate_with_spread(df, "outcome", ["id"], ["model"], 10, largest=400).first()
    assert report["model"] == "m" and " ± " in report["auroc"]
    stays = df.select("id", (F.col("p") * 10).alias("y_los"), (F.col("p") * 9).alias("p_los"))
    rows = evaluation.evaluate_with_spread(stays, "los", ["id"], replicates=10).first()
    assert " ± " in rows["mae"]

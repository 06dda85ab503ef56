"""Queries on predictions: classification, ranking, regression, fairness, bootstrap, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.functions.hashing import unit_hash
from clinframe.operators import bootstrap, fairness, metrics, scale
from clinframe.operators.quantiles import exact_quantiles
from clinframe.queries import inputs as i
from clinframe.queries.cohort import rounded, rounded_sql
from clinframe.queries.registry import query
from clinframe.session import materialise

# --- classes and rankings -----------------------------------------------------------------------------

CLASS = ("accuracy", "f1")
RANKING = ("auroc", "auprc", "minpse")
BINARY = (*CLASS, *RANKING)


def class_sql(source: str, by: str) -> str:
    return (
        f"class AS (SELECT {by}, avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, "
        "coalesce(2 * count(*) FILTER (p > 0.5 AND y = 1) / nullif(count(*) FILTER (p > 0.5) + "
        f"count(*) FILTER (y = 1), 0), 0) AS f1 FROM {source} GROUP BY ALL)"
    )


def curve_sql(source: str, by: str, pos: str = "y", neg: str = "1 - y") -> str:
    """CTE ``curve``: one row per distinct score with counts at, above and overall."""
    return (
        f"hist AS (SELECT {by}, p AS score, sum({pos})::DOUBLE AS pos, sum({neg})::DOUBLE AS neg "
        f"FROM {source} GROUP BY ALL), "
        f"curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER a AS tp_total, "
        f"sum(neg) OVER a AS fp_total FROM hist WINDOW w AS (PARTITION BY {by} ORDER BY score DESC ROWS "
        f"UNBOUNDED PRECEDING), a AS (PARTITION BY {by}))"
    )


RANKING_SQL = (
    "sum(neg * (tp - pos / 2)) / nullif(sum(pos) * sum(neg), 0) AS auroc, "
    "sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0) AS auprc, "
    "max(tp / greatest(tp + fp, tp_total)) AS minpse"
)


@query(
    "class_metrics",
    f"WITH {i.PREDS_TIES_SQL}, {class_sql('preds', 'grp')} SELECT grp, {rounded_sql(CLASS)} FROM class",
)
def class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.class_metrics(i.preds_ties(spark, sf), ["grp"]).select("grp", *rounded(CLASS))


@query(
    "ranking_metrics_ties",
    f"WITH {i.PREDS_TIES_SQL}, {curve_sql('preds', 'grp')}, r AS (SELECT grp, {RANKING_SQL} FROM curve "
    f"GROUP BY 1) SELECT grp, {rounded_sql(RANKING)} FROM r",
)
def ranking_metrics_ties(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ranking_metrics(i.preds_ties(spark, sf), ["grp"]).select("grp", *rounded(RANKING))


def one_metric(name: str) -> None:
    """auroc, auprc and minpse as queries of their own, over scores that hardly repeat."""

    @query(
        name,
        f"WITH {i.PREDS_MODELS_SQL}, {curve_sql('preds_models', 'model')}, r AS (SELECT model, "
        f"{RANKING_SQL} FROM curve GROUP BY 1) SELECT model, round({name}, 6) AS {name} FROM r",
    )
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = metrics.ranking_metrics(i.preds_models(spark, sf), ["model"])
        return out.select("model", *rounded([name]))


for _name in RANKING:
    one_metric(_name)


@query(
    "binary_metrics",
    f"WITH {i.PREDS_MODELS_SQL}, {class_sql('preds_models', 'model')}, {curve_sql('preds_models', 'model')}, "
    f"r AS (SELECT model, {RANKING_SQL} FROM curve GROUP BY 1) SELECT r.model, {rounded_sql(BINARY)} FROM r "
    "JOIN class c ON r.model = c.model",
)
def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.binary_metrics(i.preds_models(spark, sf), ["model"]).select("model", *rounded(BINARY))


@query(
    "binary_metrics_overall",
    f"WITH {i.PREDS_TIES_SQL}, one AS (SELECT 0 AS g, * FROM preds), {class_sql('one', 'g')}, "
    f"{curve_sql('one', 'g')}, r AS (SELECT g, {RANKING_SQL} FROM curve GROUP BY 1) "
    f"SELECT {rounded_sql(BINARY)} FROM r JOIN class c ON r.g = c.g",
)
def binary_metrics_overall(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.binary_metrics(i.preds_ties(spark, sf)).select(*rounded(BINARY))


@query(
    "pr_curve",
    f"WITH {i.PREDS_MODELS_SQL}, {curve_sql('preds_models', 'model')} SELECT model, round(score, 9) AS score, "
    "round(tp / (tp + fp), 6) AS precision, round(tp / tp_total, 6) AS recall FROM curve",
)
def pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.pr_curve(i.preds_models(spark, sf), ["model"])
    return out.select("model", F.round("score", 9).alias("score"), *rounded(["precision", "recall"]))


@query(
    "roc_curve",
    f"WITH {i.PREDS_TIES_SQL}, {curve_sql('preds', 'grp')} SELECT grp, round(score, 9) AS score, "
    "round(fp / fp_total, 6) AS fpr, round(tp / tp_total, 6) AS tpr FROM curve",
)
def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.roc_curve(i.preds_ties(spark, sf), ["grp"])
    return out.select("grp", F.round("score", 9).alias("score"), *rounded(["fpr", "tpr"]))


# --- regression, length of stay, losses ---------------------------------------------------------------

REGRESSION = ("mse", "rmse", "mae", "r2")
OUTCOME_SQL = "avg((p_los - y_los) * (p_los - y_los))"


@query(
    "regression_metrics",
    f"WITH {i.PREDS_LOS_SQL}, m AS (SELECT {OUTCOME_SQL} AS mse, sqrt({OUTCOME_SQL}) AS rmse, "
    f"avg(abs(p_los - y_los)) AS mae, 1 - {OUTCOME_SQL} / var_pop(y_los) AS r2 FROM preds_los) "
    f"SELECT {rounded_sql(REGRESSION)} FROM m",
)
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.regression_metrics(i.preds_los(spark, sf)).select(*rounded(REGRESSION))


THRESHOLDS = (5.0, 10.0, 20.0)
LARGE_LOS = 55.0
THRESHOLDS_SQL = "(VALUES " + ", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS) + ") t(threshold)"


@query(
    "osmae",
    f"WITH {i.PREDS_LOS_SQL}, large AS (SELECT quantile_cont(y_los, 0.95) AS l FROM preds_los), "
    "terms AS (SELECT threshold, CASE WHEN y_los <= threshold THEN 1.0 ELSE greatest(0.0, (y_los - l) / "
    "(threshold - l)) END AS fade, CASE WHEN (p > 0.5) = (y = 1) THEN abs(p_los - y_los) ELSE "
    "greatest(0.0, l - p_los) + greatest(0.0, l - y_los) END AS miss "
    f"FROM preds_los, large, {THRESHOLDS_SQL}) SELECT threshold, round(avg(fade * miss), 6) AS osmae "
    "FROM terms GROUP BY 1",
)
def osmae(spark: SparkSession, sf: str) -> DataFrame:
    preds = i.preds_los(spark, sf)
    large = exact_quantiles(preds, ["y_los"], [0.95]).select("value")
    scored = metrics.osmae(preds.withColumn("_l", large.scalar()), F.col("_l"), THRESHOLDS)
    return scored.select("threshold", *rounded(["osmae"]))


@query(
    "early_score",
    f"WITH {i.PREDS_LOS_SQL}, terms AS (SELECT threshold, CASE WHEN p > 0.5 AND y = 1 THEN "
    "least(1.0, y_los / threshold) WHEN p > 0.5 THEN -0.1 WHEN y = 1 THEN CASE WHEN y_los >= threshold "
    "THEN 0 ELSE y_los / threshold - 1 END ELSE 0 END AS got, CASE WHEN y = 1 THEN least(1.0, y_los / "
    f"threshold) ELSE 0 END AS best FROM preds_los, {THRESHOLDS_SQL}) SELECT threshold, "
    "round(greatest(-1.0, CASE WHEN sum(best) > 0 THEN sum(got) / sum(best) ELSE 0 END), 6) AS es "
    "FROM terms GROUP BY 1",
)
def early_score(spark: SparkSession, sf: str) -> DataFrame:
    scored = metrics.early_score(i.preds_los(spark, sf), THRESHOLDS)
    return scored.select("threshold", *rounded(["es"]))


LOSSES = ("log_loss", "mse_loss", "multitask_loss", "time_aware_loss")
BCE_SQL = (
    "-(y * CASE WHEN p > 0 THEN greatest(ln(p), -100.0) ELSE -100.0 END + (1 - y) * "
    "CASE WHEN 1 - p > 0 THEN greatest(ln(1 - p), -100.0) ELSE -100.0 END)"
)


@query(
    "losses",
    f"WITH {i.PREDS_LOS_SQL}, b AS (SELECT *, {BCE_SQL} AS bce, (p_los - y_los) * (p_los - y_los) AS sq "
    "FROM preds_los), m AS (SELECT avg(bce) AS log_loss, avg(sq) AS mse_loss, avg(bce) + avg(sq) AS "
    "multitask_loss, greatest(0.0, avg(bce * exp(-0.1::DOUBLE * y_los)) - 0.1::DOUBLE * avg(y_los * "
    f"abs(y - p))) AS time_aware_loss FROM b) SELECT {rounded_sql(LOSSES)} FROM m",
)
def losses(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.losses(i.preds_los(spark, sf)).select(*rounded(LOSSES))


@query(
    "losses_scored_models",
    f"WITH {i.PREDS_MODELS_SQL}, b AS (SELECT model, {BCE_SQL} AS bce, o_orderkey % 30 AS los, "
    "abs(y - p) AS gap FROM preds_models) SELECT model, round(avg(bce), 6) AS log_loss, "
    "round(greatest(0.0, avg(bce * exp(-0.1::DOUBLE * (los / 300))) - 0.1::DOUBLE * avg((los / 300) * gap)), 6) "
    "AS time_aware_loss FROM b GROUP BY 1",
)
def losses_scored_models(spark: SparkSession, sf: str) -> DataFrame:
    preds = i.preds_models(spark, sf).withColumns(
        {"y_los": F.col("o_orderkey") % 30 / 300.0, "p_los": F.lit(0.0)}
    )
    return metrics.losses(preds, ["model"]).select("model", *rounded(["log_loss", "time_aware_loss"]))


@query(
    "prediction_los_info",
    f"WITH {i.PREDS_LOS_SQL}, t AS (SELECT quantile_cont(y_los, 0.05) AS p5, quantile_cont(y_los, 0.95) AS p95 "
    "FROM preds_los) SELECT round(max(p95), 6) AS large_los, round(0.5 * avg(y_los) FILTER (y_los BETWEEN "
    "p5 AND p95), 6) AS threshold FROM preds_los, t",
)
def prediction_los_info(spark: SparkSession, sf: str) -> DataFrame:
    preds = i.preds_los(spark, sf)
    tails = exact_quantiles(preds, ["y_los"], [0.05, 0.95])
    bounds = scale.by_feature(
        tails.groupBy("feature").agg(F.min("value").alias("p5"), F.max("value").alias("p95")),
        ["y_los"],
        ["p5", "p95"],
    )
    framed = preds.select("y_los", bounds.alias("_b"))
    large = scale.fitted("_b", 0, "p95")
    inside = F.col("y_los").between(scale.fitted("_b", 0, "p5"), large)
    return framed.agg(
        F.round(F.max(large), 6).alias("large_los"),
        F.round(F.avg(F.when(inside, F.col("y_los"))) * 0.5, 6).alias("threshold"),
    )


# --- fairness ---------------------------------------------------------------------------------------------

FAIR = fairness.MEASURES


def _fair_attribute_sql(name: str, predicate: str) -> str:
    def rates(member: str) -> str:
        return (
            f"count(*) FILTER ({member}) AS n_{{k}}, count(*) FILTER (({member}) AND p >= 0.5) AS c_{{k}}, "
            f"count(*) FILTER (({member}) AND y = 1) AS p_{{k}}, "
            f"count(*) FILTER (({member}) AND y = 1 AND p >= 0.5) AS t_{{k}}"
        )

    inside, outside = rates(predicate).format(k="a"), rates(f"NOT ({predicate})").format(k="b")
    return f"SELECT '{name}' AS attribute, {inside}, {outside} FROM sensitive"


FAIR_SQL = (
    f"WITH {i.SENSITIVE_SQL}, counts AS ("
    + " UNION ALL ".join(_fair_attribute_sql(n, p) for n, p in i.PRIVILEGED_SQL.items())
    + "), rates AS (SELECT attribute, c_a / nullif(n_a, 0) AS ra, c_b / nullif(n_b, 0) AS rb, "
    "coalesce(t_a / nullif(p_a, 0), 0) - coalesce(t_b / nullif(p_b, 0), 0) AS tpr, "
    "coalesce((c_a - t_a) / nullif(n_a - p_a, 0), 0) - coalesce((c_b - t_b) / nullif(n_b - p_b, 0), 0) "
    "AS fpr FROM counts), fair AS (SELECT attribute, CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN "
    "least(ra, rb) / nullif(greatest(ra, rb), 0) END AS di, 0.5 * (fpr + tpr) AS aod, tpr AS eod, "
    "ra - rb AS spd FROM rates) "
)


@query("fairness_report", FAIR_SQL + f"SELECT attribute, {rounded_sql(FAIR)} FROM fair")
def fairness_report(spark: SparkSession, sf: str) -> DataFrame:
    out = fairness.fairness_report(i.sensitive(spark, sf), i.privileged())
    return out.select("attribute", *rounded(FAIR))


def one_measure(name: str, measure: str) -> None:
    @query(name, FAIR_SQL + f"SELECT attribute, {rounded_sql([measure])} FROM fair")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = fairness.fairness_measure(i.sensitive(spark, sf), i.privileged(), measure)
        return out.select("attribute", *rounded([measure]))


for _name, _measure in (
    ("disparate_impact", "di"),
    ("average_odds_difference", "aod"),
    ("equal_opportunity_difference", "eod"),
    ("statistical_parity_difference", "spd"),
):
    one_measure(_name, _measure)

# --- bootstrap ----------------------------------------------------------------------------------------------


def outcome_preds(spark: SparkSession, sf: str) -> DataFrame:
    """One prediction per order."""
    o = i.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    y = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    d = o.select("o_orderkey", y.alias("y"))
    return d.withColumn("p", unit_hash(F.col("o_orderkey")) * 0.7 + F.col("y") * 0.3)


_LADDER = " ".join(
    f"WHEN u < {b!r} THEN {k}" for k, b in enumerate(bootstrap.POISSON_1)
)
_PREDS_ONE = (
    "preds AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, "
    + i.sql_hash("o_orderkey::VARCHAR")
    + " * 0.7::DOUBLE + (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) * 0.3::DOUBLE AS p FROM orders)"
)
BOOTSTRAP_SQL = (
    f"WITH {_PREDS_ONE}, blocks AS (SELECT o_orderkey, y, p, block, md5(o_orderkey || ':42:' || block) AS d "
    "FROM preds, range(0, 25) b(block)), drawn AS (SELECT o_orderkey, y, p, block * 4 + slot + 1 AS replicate, "
    "('0x' || substr(d, slot * 8 + 1, 8))::BIGINT / 4294967296::DOUBLE AS u FROM blocks, range(0, 4) s(slot)), "
    f"sample AS (SELECT replicate, y, p, CASE {_LADDER} ELSE {len(bootstrap.POISSON_1)} END AS weight FROM drawn), "
)


@query(
    "bootstrap_class_metrics",
    BOOTSTRAP_SQL
    + "m AS (SELECT replicate, sum(CASE WHEN (p > 0.5) = (y = 1) THEN weight ELSE 0 END) / sum(weight) AS "
    "accuracy, 2 * sum(CASE WHEN p > 0.5 AND y = 1 THEN weight ELSE 0 END) / (sum(CASE WHEN p > 0.5 THEN weight "
    "ELSE 0 END) + sum(weight * y)) AS f1 FROM sample GROUP BY 1) SELECT 'accuracy' AS metric, "
    "round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std FROM m UNION ALL SELECT 'f1', "
    "round(avg(f1), 6), round(stddev_pop(f1), 6) FROM m",
)
def bootstrap_class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = bootstrap.bootstrap(outcome_preds(spark, sf), metrics.class_metrics, CLASS, ["o_orderkey"])
    return out.select("metric", *rounded(["mean", "std"]))


@query(
    "bootstrap_ranking_metrics",
    BOOTSTRAP_SQL
    + "kept AS (SELECT * FROM sample WHERE weight > 0), "
    + curve_sql("kept", "replicate", "weight * y", "weight * (1 - y)")
    + f", m AS (SELECT replicate, {RANKING_SQL} FROM curve GROUP BY 1) "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std FROM m"
        for m in RANKING
    ),
)
def bootstrap_ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = bootstrap.bootstrap_ranking(outcome_preds(spark, sf), ["o_orderkey"])
    return out.select("metric", *rounded(["mean", "std"]))


@query(
    "bootstrap_exact_size",
    f"WITH {_PREDS_ONE}, numbered AS (SELECT *, row_number() OVER (ORDER BY "
    + i.sql_hash("o_orderkey || ':42'")
    + ", o_orderkey) AS k, count(*) OVER () AS n FROM preds), draws AS (SELECT r AS replicate, (floor("
    + i.sql_hash("o_orderkey || ':42:' || r")
    + " * n) + 1)::BIGINT AS k FROM numbered, range(1, 21) g(r)), hits AS (SELECT replicate, k, count(*) AS weight "
    "FROM draws GROUP BY ALL), m AS (SELECT replicate, sum(weight) AS size, sum(CASE WHEN (p > 0.5) = (y = 1) "
    "THEN weight ELSE 0 END) / sum(weight) AS accuracy FROM hits JOIN numbered USING (k) GROUP BY 1) "
    "SELECT replicate, size::BIGINT AS size, round(accuracy, 6) AS accuracy FROM m",
)
def bootstrap_exact_size(spark: SparkSession, sf: str) -> DataFrame:
    sample = bootstrap.exact_resamples(outcome_preds(spark, sf), ["o_orderkey"], 20)
    # Four cells a resample: drawn and joined once, for the sizes and the scores.
    called = F.when(F.col("p") > 0.5, 1.0).otherwise(0.0)
    cells = materialise(sample.groupBy("replicate", "y", called.alias("p")).agg(F.sum("weight").alias("weight")))
    scored = metrics.class_metrics(cells, ["replicate"], weight="weight")
    sizes = cells.groupBy("replicate").agg(F.sum("weight").alias("size"))
    return sizes.join(scored, "replicate").select(
        F.col("replicate").cast("bigint").alias("replicate"), "size", *rounded(["accuracy"])
    )


def _ratio_sql(parts, x: str) -> str:
    def polynomial(factors) -> str:
        value = f"({factors[0]!r}::DOUBLE)"
        for f in factors[1:]:
            value = f"({value} * {x} + {f!r}::DOUBLE)"
        return value

    return f"{polynomial(parts[0])} / {polynomial(parts[1])}"


_TAILED = bootstrap.TAIL_FROM
#: Draws per cell: chances of means up to 100 by recursion, larger ones by the same expansion.
CELLS_SQL = (
    f"WITH RECURSIVE {i.PREDS_TIES_SQL}, cells AS (SELECT grp, y, p, count(*) AS n FROM preds GROUP BY ALL), "
    "chances AS (SELECT n, 0 AS k, exp(-n::DOUBLE) AS term, exp(-n::DOUBLE) AS total FROM (SELECT DISTINCT n FROM cells "
    f"WHERE n <= {bootstrap.EXACT_MEAN}) UNION ALL SELECT n, k + 1, term * n / (k + 1), total + term * n / (k + 1) FROM chances "
    "WHERE k < n OR total + term * n / (k + 1) > total), drawn AS (SELECT grp, y, p, n, r AS replicate, "
    + i.sql_hash("grp || ':' || y || ':' || round(p * 1000)::BIGINT || ':42:' || r")
    + f" + {0.5 / 16**13!r}::DOUBLE AS u FROM cells, range(1, 101) g(r)), placed AS (SELECT *, CASE WHEN u < {_TAILED} THEN "
    + _ratio_sql(bootstrap.TAIL, "sqrt(-2 * ln(u))")
    + f" WHEN u > 1 - {_TAILED} THEN -("
    + _ratio_sql(bootstrap.TAIL, "sqrt(-2 * ln(1 - u))")
    + ") ELSE (u - 0.5) * ("
    + _ratio_sql(bootstrap.MIDDLE, "((u - 0.5) * (u - 0.5))")
    + ") END AS z FROM drawn), sample AS (SELECT grp, y, p, replicate, CASE WHEN n > "
    + f"{bootstrap.EXACT_MEAN} THEN greatest(floor(n + z * sqrt(n) + (z * z - 1) / 6 + (z - z * z * z) / (72 * sqrt(n)) + 0.5), 0) "
    "ELSE (SELECT count(*) FROM chances c WHERE c.n = placed.n AND c.total <= u) END AS weight FROM placed), kept AS (SELECT * "
    "FROM sample WHERE weight > 0), "
)


@query(
    "bootstrap_by_cells",
    CELLS_SQL
    + curve_sql("kept", "grp, replicate", "weight * y", "weight * (1 - y)")
    + f", ranked AS (SELECT grp, replicate, {RANKING_SQL} FROM curve GROUP BY ALL), classed AS (SELECT grp, replicate, "
    "sum(CASE WHEN (p > 0.5) = (y = 1) THEN weight ELSE 0 END) / sum(weight) AS accuracy, 2 * sum(CASE WHEN p > 0.5 AND y = 1 "
    "THEN weight ELSE 0 END) / (sum(CASE WHEN p > 0.5 THEN weight ELSE 0 END) + sum(weight * y)) AS f1 FROM kept GROUP BY ALL), "
    "m AS (SELECT * FROM ranked JOIN classed USING (grp, replicate)) "
    + " UNION ALL ".join(
        f"SELECT grp, '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std FROM m GROUP BY grp" for m in BINARY
    ),
)
def bootstrap_by_cells(spark: SparkSession, sf: str) -> DataFrame:
    preds = i.preds_ties(spark, sf)
    key = [F.col("grp"), F.col("y").cast("string"), F.round(F.col("p") * 1000).cast("bigint").cast("string")]
    out = bootstrap.bootstrap_cells(preds, metrics.binary_metrics, BINARY, by=["grp"], draw_key=key)
    return out.select("grp", "metric", *rounded(["mean", "std"]))


# --- reports -----------------------------------------------------------------------------------------------


@query(
    "format_results",
    f"WITH {i.PREDS_MODELS_SQL}, m AS (SELECT model, o_orderkey % 10 AS fold, avg(CASE WHEN (p > 0.5) = "
    "(y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, avg(p) AS mean_p FROM preds_models GROUP BY ALL) "
    "SELECT model, printf('%.2f ± %.2f', round(avg(accuracy) * 100, 2), round(stddev_pop(accuracy) * 100, 2)) AS accuracy, "
    "printf('%.2f ± %.2f', round(avg(mean_p) * 100, 2), round(stddev_pop(mean_p) * 100, 2)) AS mean_p FROM m GROUP BY 1",
)
def format_results(spark: SparkSession, sf: str) -> DataFrame:
    preds = i.preds_models(spark, sf).withColumn("fold", F.col("o_orderkey") % 10)
    right = ((F.col("p") > 0.5) == (F.col("y") == 1)).cast("double")
    per_fold = preds.groupBy("model", "fold").agg(
        F.avg(right).alias("accuracy"), F.avg("p").alias("mean_p")
    )
    long = metrics.unpivot_metrics(per_fold, ["model", "fold"], ["accuracy", "mean_p"])
    stats = long.groupBy("model", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
    return metrics.format_results(stats, ["model"], ["accuracy", "mean_p"])


def mean_thousandths(name: str) -> Column:
    """Mean of numbers from 0 on, rounded half up to three decimals. Numbers are added in whole millionths,
    so a mean halfway between two thousandths does not depend on the order of adding up."""
    doubled = 2 * F.sum(F.round(F.col(name) * 1e6).cast("bigint")) + 1000 * F.count(name)
    step = 2000 * F.count(name)
    return (doubled - doubled % step) / step / 1000


def best_epoch(name: str, mode: str) -> None:
    order = "DESC" if mode == "max" else "ASC"

    @query(
        name,
        "WITH log AS (SELECT l_suppkey, l_linenumber AS epoch, ((2 * sum(round(l_discount * 1e6)::BIGINT) + 1000 * count(*)) "
        "// (2000 * count(*)))::DOUBLE / 1000 AS auprc FROM lineitem "
        "WHERE l_discount IS NOT NULL GROUP BY ALL) SELECT l_suppkey, epoch, auprc AS best FROM log QUALIFY row_number() OVER "
        f"(PARTITION BY l_suppkey ORDER BY auprc {order}, epoch) = 1",
    )
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = i.table(spark, sf, "lineitem").where(F.col("l_discount").isNotNull())
        log = rows.groupBy("l_suppkey", F.col("l_linenumber").alias("epoch")).agg(mean_thousandths("l_discount").alias("auprc"))
        return metrics.best_checkpoint(log, ["l_suppkey"], "epoch", "auprc", mode)


best_epoch("best_checkpoint", "max")
best_epoch("best_checkpoint_los", "min")

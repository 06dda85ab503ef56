"""Clinical shapes derived from the test tables, in Spark and as SQL fragments.

Every input covers its whole source table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.functions.hashing import unit_hash
from clinframe.schema import VisitSchema

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
LABS = tuple(f"f_{t}" for t in EVENT_TYPES)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sql_hash(text: str, digits: int = 13) -> str:
    """SQL of :func:`unit_hash` over a text expression."""
    return f"(('0x' || substr(md5({text}), 1, {digits}))::BIGINT / {float(16**digits)!r}::DOUBLE)"


# --- visits: one row per event, five sparse labs -------------------------------------------

VISITS = VisitSchema(
    key="user_id",
    time="ts",
    tiebreak=("event_id",),
    targets=("outcome", "los", "readmission"),
    numeric=LABS,
)


def visits(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    labs = [
        F.when(F.col("event_type") == t, F.col("value")).alias(f"f_{t}") for t in EVENT_TYPES
    ]
    return e.select(
        "user_id",
        "ts",
        "event_id",
        *labs,
        F.when(F.col("user_id") % 4 == 0, 1.0).otherwise(0.0).alias("outcome"),
        F.day("ts").cast("double").alias("los"),
        F.when(F.col("user_id") % 3 == 0, 1.0).otherwise(0.0).alias("readmission"),
    )


VISITS_SQL = (
    "visits AS (SELECT user_id, ts, event_id, "
    + ", ".join(f"CASE WHEN event_type = '{t}' THEN value END AS f_{t}" for t in EVENT_TYPES)
    + ", CASE WHEN user_id % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS outcome"
    + ", day(ts)::DOUBLE AS los"
    + ", CASE WHEN user_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS readmission"
    + " FROM events)"
)

# --- orders of a customer as visits: categorical labs, ties in time --------------------------

ORDER_VISITS = VisitSchema(
    key="o_custkey",
    time="o_orderdate",
    tiebreak=("o_orderkey",),
    targets=("outcome",),
    static=("c_acctbal",),
    numeric=("o_totalprice",),
    categorical=("o_orderstatus", "o_orderpriority"),
)


def order_visits(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    return joined.withColumn("outcome", F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))


ORDER_VISITS_SQL = (
    "order_visits AS (SELECT o.*, c_acctbal, c_mktsegment, CASE WHEN o_orderstatus = 'F' THEN "
    "1.0::DOUBLE ELSE 0.0::DOUBLE END AS outcome FROM orders o JOIN customer c "
    "ON o_custkey = c_custkey)"
)

# --- predictions -------------------------------------------------------------------------------


def preds_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Few distinct scores, many ties, one score of exactly 0.5."""
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        (F.col("l_discount") * 10).alias("p"),
        F.col("l_linestatus").alias("grp"),
    )


PREDS_TIES_SQL = (
    "preds AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, "
    "l_discount * 10::DOUBLE AS p, l_linestatus AS grp FROM lineitem)"
)

MODELS = ("forest", "linear", "recurrent")


def preds_models(spark: SparkSession, sf: str) -> DataFrame:
    """Three models per record, about one distinct score per row."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    y = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    models = F.explode(F.array(*map(F.lit, MODELS)))
    d = o.select("o_orderkey", y.alias("y"), models.alias("model"))
    return d.withColumn("p", unit_hash(F.col("o_orderkey"), F.col("model")) * 0.7 + F.col("y") * 0.3)


PREDS_MODELS_SQL = (
    "preds_models AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, "
    "model, " + sql_hash("o_orderkey || ':' || model") + " * 0.7::DOUBLE + (CASE WHEN "
    "o_orderstatus = 'F' THEN 1 ELSE 0 END) * 0.3::DOUBLE AS p FROM orders, "
    "(VALUES " + ", ".join(f"('{m}')" for m in MODELS) + ") m(model))"
)


def preds_los(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome and length-of-stay predictions per order line."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_shipdate"
    )
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    joined = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    stay = F.abs(F.datediff("l_shipdate", "o_orderdate")) % 60
    return joined.select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        (F.col("l_discount") * 10).alias("p"),
        stay.cast("double").alias("y_los"),
        F.col("l_quantity").alias("p_los"),
    )


PREDS_LOS_SQL = (
    "preds_los AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, "
    "l_discount * 10::DOUBLE AS p, "
    "(abs(datediff('day', o_orderdate, l_shipdate)) % 60)::DOUBLE AS y_los, l_quantity AS p_los "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
)


def sensitive(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions with attributes of the customer behind each order line."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_discount", "l_returnflag")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    joined = (
        lines.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return joined.select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        (F.col("l_discount") * 10).alias("p"),
        "c_mktsegment",
        "n_regionkey",
        "c_acctbal",
    )


SENSITIVE_SQL = (
    "sensitive AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, "
    "l_discount * 10::DOUBLE AS p, c_mktsegment, n_regionkey, c_acctbal FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey)"
)


def privileged() -> dict[str, Column]:
    return {
        "segment": F.col("c_mktsegment") == "BUILDING",
        "region": F.col("n_regionkey") <= 1,
        "balance": F.col("c_acctbal") > 0,
    }


PRIVILEGED_SQL = {
    "segment": "c_mktsegment = 'BUILDING'",
    "region": "n_regionkey <= 1",
    "balance": "c_acctbal > 0",
}

# --- vectors and documents ---------------------------------------------------------------------


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("record_id"), F.col("embedding").alias("vector"), "label"
    )


def corpus_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        F.col("lang").alias("corpus"),
        "source",
        F.substring("text", 1, 40).alias("title"),
        F.col("text").alias("content"),
    )


# --- reviewer responses --------------------------------------------------------------------------


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Three rounds of three reviewers per conversation; texts from its opening turns."""
    c = table(spark, sf, "conversations")
    said = c.groupBy(F.col("conv_id").alias("patient_id")).agg(
        F.min_by("text", "turn").alias("analysis"), F.max_by("text", "turn").alias("reason")
    )
    grid = said.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn(
        "reviewer", F.explode(F.sequence(F.lit(1), F.lit(3)))
    )
    who = [F.col("patient_id"), F.col("round"), F.col("reviewer")]
    return grid.select(
        *who,
        F.format_string("%.4f", unit_hash(*who)).alias("logit"),
        F.when(unit_hash(*who, F.lit("a")) < 0.7, "agree").otherwise("disagree").alias("answer"),
        (F.floor(unit_hash(*who, F.lit("c")) * 3) + 1).cast("string").alias("confidence"),
        F.when(unit_hash(F.col("patient_id"), F.col("round"), F.lit("s")) < 0.5, "Yes, go on")
        .otherwise("No")
        .alias("action"),
        "analysis",
        "reason",
        F.array(
            F.concat(F.lit("E"), F.col("round").cast("string")),
            F.concat(F.lit("R"), F.col("reviewer").cast("string")),
        ).alias("evidences"),
    )


_WHO = "patient_id || ':' || r.round || ':' || v.reviewer"
RESPONSES_SQL = (
    "said AS (SELECT conv_id AS patient_id, arg_min(text, turn) AS analysis, "
    "arg_max(text, turn) AS reason FROM conversations GROUP BY 1), "
    "responses AS (SELECT patient_id, r.round, v.reviewer, "
    f"printf('%.4f', {sql_hash(_WHO)}) AS logit, "
    f"CASE WHEN {sql_hash(_WHO + ' || ' + repr(':a'))} < 0.7 "
    "THEN 'agree' ELSE 'disagree' END AS answer, "
    f"(floor({sql_hash(_WHO + ' || ' + repr(':c'))} * 3) + 1)::BIGINT::VARCHAR AS confidence, "
    f"CASE WHEN {sql_hash('patient_id || ' + repr(':') + ' || r.round || ' + repr(':s'))} < 0.5 "
    "THEN 'Yes, go on' ELSE 'No' END AS action, analysis, reason, "
    "'E' || r.round AS e1, 'R' || v.reviewer AS e2 "
    "FROM said, (VALUES (1), (2), (3)) r(round), (VALUES (1), (2), (3)) v(reviewer))"
)


# --- split ----------------------------------------------------------------------------------------

SPLIT_TEST, SPLIT_VAL, SPLIT_SEED = 0.2, 0.25, 42


def split_sql(labels: str, key: str, label: str, test: float, val: float, seed: int) -> str:
    """CTEs ending in ``split(key, label, split)`` for a CTE ``labels``."""

    def share(source: str, size: str, fraction: float, name: str, keep: str) -> str:
        return (
            f"{name}_a AS (SELECT *, ceil({fraction!r}::DOUBLE * sum({size}) OVER ()) AS want, "
            f"sum({size}) OVER () AS total FROM {source}), "
            f"{name}_b AS (SELECT *, want * {size} / total::DOUBLE AS shr FROM {name}_a), "
            f"{name}_c AS (SELECT *, floor(shr) AS base FROM {name}_b), "
            f"{name}_d AS (SELECT {keep}, base + CASE WHEN row_number() OVER (ORDER BY shr - base DESC, "
            f"{label}) <= want - sum(base) OVER () THEN 1 ELSE 0 END AS {name} FROM {name}_c)"
        )

    return (
        f"strata AS (SELECT {label}, count(*) AS n FROM {labels} GROUP BY 1), "
        + share("strata", "n", test, "n_test", f"{label}, n")
        + f", rest AS (SELECT {label}, n_test, n - n_test AS left_n FROM n_test_d), "
        + share("rest", "left_n", val, "n_val", f"{label}, n_test")
        + f", placed AS (SELECT {key}, {label}, row_number() OVER (PARTITION BY {label} ORDER BY "
        + sql_hash(f"{key} || ':{seed}'")
        + f", {key}) AS place FROM {labels}), "
        f"split AS (SELECT {key}, p.{label}, CASE WHEN place <= n_test THEN 'test' "
        f"WHEN place <= n_test + n_val THEN 'val' ELSE 'train' END AS split "
        f"FROM placed p JOIN n_val_d q ON p.{label} = q.{label})"
    )


LABELS_SQL = (
    "labels AS (SELECT user_id, outcome FROM visits QUALIFY row_number() OVER "
    "(PARTITION BY user_id ORDER BY ts, event_id) = 1)"
)
SPLIT_SQL = (
    f"{VISITS_SQL}, labels_v AS (SELECT user_id, outcome FROM visits QUALIFY row_number() OVER "
    "(PARTITION BY user_id ORDER BY ts, event_id) = 1), "
    + split_sql("labels_v", "user_id", "outcome", SPLIT_TEST, SPLIT_VAL, SPLIT_SEED)
)
SPLIT_VISITS_SQL = SPLIT_SQL + ", parted AS (SELECT v.*, s.split FROM visits v JOIN split s USING (user_id))"
TRAIN_SQL = SPLIT_VISITS_SQL + ", train AS (SELECT * FROM parted WHERE split = 'train')"


def unpivot_sql(source: str, columns, extra: str = "") -> str:
    """Long non-missing cells of a relation."""
    keep = f"{extra}, " if extra else ""
    return " UNION ALL ".join(
        f"SELECT {keep}'{c}' AS feature, {c}::DOUBLE AS value FROM {source} WHERE {c} IS NOT NULL"
        for c in columns
    )


def stats_sql(source: str, columns) -> str:
    """CTEs ending in ``stats`` for trimmed statistics of ``source``."""
    return (
        f"cells AS ({unpivot_sql(source, columns)}), "
        "bounds AS (SELECT feature, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi "
        "FROM cells GROUP BY 1), "
        "kept AS (SELECT c.feature, value FROM cells c JOIN bounds b ON c.feature = b.feature "
        "WHERE value > lo AND value < hi), "
        "fitted AS (SELECT feature, avg(value) AS mean, stddev_samp(value) AS std, "
        "median(value) AS median FROM kept GROUP BY 1), "
        "stats AS (SELECT b.feature, lo, hi, coalesce(mean, 0) AS mean, coalesce(std, 0) AS std, "
        "coalesce(median, 0) AS median, (coalesce(median, 0) - coalesce(mean, 0)) / "
        "(coalesce(std, 0) + 1e-12) AS default_fill FROM bounds b LEFT JOIN fitted f "
        "ON b.feature = f.feature)"
    )

"""Queries on fitted models, attributions and fusion, and the composed flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.functions.hashing import unit_hash
from clinframe.operators import models, networks, sequence, split, trees
from clinframe.operators.preparation import UNSEEN, Preparation, PreparationModel
from clinframe.plans import cohort as cohort_plan
from clinframe.plans import consultation as consultation_plan
from clinframe.plans import evaluation as evaluation_plan
from clinframe.queries import inputs as i
from clinframe.queries.cohort import FILLED_SQL, LAST_SO_FAR, _wide_stats_sql, _z_sql, rounded, rounded_sql
from clinframe.queries.cohort import SCALED, visit_split
from clinframe.queries.inputs import LABS, VISITS
from clinframe.queries.registry import query
from clinframe.schema import VisitSchema, col
from clinframe.queries.scores import BINARY, RANKING_SQL, class_sql, curve_sql
from clinframe.session import scratch, stored


def last_visits(spark: SparkSession, sf: str) -> DataFrame:
    """Filled labs of every record's last visit, with its split."""
    filled = sequence.forward_fill(i.visits(spark, sf), VISITS)
    last = sequence.last_visit(filled, VISITS)
    return stored(split.apply_split(last, visit_split(spark, sf).select("user_id", "split"), "user_id"))


def _part(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("split") == name)


#: Every record with its split: what scores cover, whatever the model.
COVERED_SQL = f"WITH {i.SPLIT_SQL} SELECT user_id, split, 1 AS in_range FROM split"


def covered(scored: DataFrame, key: str = "user_id") -> DataFrame:
    """Which rows a model scored, and whether with a probability."""
    return scored.select(key, "split", F.col("p").between(0.0, 1.0).cast("int").alias("in_range"))


def beats_constant(scored: DataFrame, error: Column, constant: Column) -> DataFrame:
    """One row: whether the error on the training rows is below that of the best constant."""
    train = _part(scored, "train").select(error.alias("e"), constant.alias("c"))
    return train.agg((F.avg("e") < F.var_pop("c")).cast("int").alias("better"))


@query("logistic_scores", COVERED_SQL)
def logistic_scores(spark: SparkSession, sf: str) -> DataFrame:
    last = last_visits(spark, sf)
    model = models.fit_logistic(_part(last, "train"), LABS, "outcome")
    return covered(models.score(model, last, LABS))


@query(
    "logistic_optimality",
    "SELECT unnest(["
    + ", ".join(f"'{f}'" for f in ("intercept", *LABS))
    + "]) AS coefficient, 0.0::DOUBLE AS gradient",
)
def logistic_optimality(spark: SparkSession, sf: str) -> DataFrame:
    """Gradient of the penalised loss per row at the fitted coefficients: zero, to three digits,
    relative to the scale of each feature."""
    train = _part(last_visits(spark, sf), "train")
    model = models.fit_logistic(train, LABS, "outcome")
    weights, rows = models.coefficients(model), train.count()
    margin = F.lit(float(model.intercept))
    for f, w in zip(LABS, weights, strict=True):
        margin = margin + F.lit(w) * F.col(f)
    gap = 1 / (1 + F.exp(-margin)) - F.col("outcome")
    sums = [F.avg(gap).alias("intercept")]
    for f, w in zip(LABS, weights, strict=True):
        sums.append(((F.avg(gap * F.col(f)) + F.lit(w / rows)) / (1 + F.max(F.abs(F.col(f))))).alias(f))
    names = F.array(*[F.struct(F.lit(n).alias("coefficient"), F.round(F.col(n), 3).alias("g")) for n in ("intercept", *LABS)])
    return train.agg(*sums).select(F.inline(names)).select("coefficient", F.abs("g").alias("gradient"))


@query("boosted_tree_scores", COVERED_SQL)
def boosted_tree_scores(spark: SparkSession, sf: str) -> DataFrame:
    last = last_visits(spark, sf)
    model = models.fit_gbt(_part(last, "train"), LABS, "outcome")
    return covered(models.score(model, last, LABS))


def stay_noise() -> Column:
    """Up to one day more from the id: in the smallest tables all stays are equal."""
    return unit_hash(F.col("user_id"))


@query("boosted_tree_stay", "SELECT 1 AS better")
def boosted_tree_stay(spark: SparkSession, sf: str) -> DataFrame:
    last = last_visits(spark, sf)
    last = last.withColumn("target", F.col("los") + stay_noise())
    model = models.fit_gbt(_part(last, "train"), LABS, "target", task="los")
    scored = models.score(model, last, LABS, "p_los")
    return beats_constant(scored, F.pow(F.col("p_los") - F.col("target"), 2), F.col("target"))


@query("boosted_tree_importances", "SELECT count(*)::INTEGER AS features, 1.0::DOUBLE AS total FROM (VALUES " + ", ".join(f"('{f}')" for f in LABS) + ")")
def boosted_tree_importances(spark: SparkSession, sf: str) -> DataFrame:
    last = last_visits(spark, sf)
    model = models.fit_gbt(_part(last, "train"), LABS, "outcome")
    table = models.importances(spark, model, LABS)
    return table.agg(F.count(F.lit(1)).cast("int").alias("features"), F.round(F.sum("importance"), 6).alias("total"))


#: Coefficients of a linear model over the test labs.
COEFFICIENTS = (0.5, -0.3, 0.1, 1.0, -1.5)


@query(
    "attribute_linear",
    f"WITH {FILLED_SQL}, lastv AS (SELECT * FROM filled QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY "
    "ts DESC, event_id DESC) = 1), bg AS (SELECT "
    + ", ".join(f"avg({f}) AS m_{f}" for f in LABS)
    + " FROM filled), cells AS ("
    + " UNION ALL ".join(
        f"SELECT user_id, '{f}' AS feature, {k} AS position, {f} AS value, {w} * ({f} - m_{f}) AS weight FROM lastv, bg"
        for k, (f, w) in enumerate(zip(LABS, COEFFICIENTS, strict=True))
    )
    + ") SELECT user_id, feature, position, round(value, 6) AS value, round(weight, 9) AS weight FROM cells",
)
def attribute_linear(spark: SparkSession, sf: str) -> DataFrame:
    filled = sequence.forward_fill(i.visits(spark, sf), VISITS)
    last = sequence.last_visit(filled, VISITS)
    out = models.attribute_linear(last, "user_id", LABS, COEFFICIENTS, filled)
    return out.select(
        "user_id", "feature", "position", *rounded(["value"]), *rounded(["weight"], 9)
    )


#: Two small trees over the test labs: tree, node, parent, feature, cut, left, right, cover, value, weight.
FOREST = (
    (0, 0, None, 0, 60.0, 1, 4, 0.0, 0.0, 1.0),
    (0, 1, 0, 2, 0.0, 2, 3, 0.0, 0.0, 1.0),
    (0, 2, 1, None, None, None, None, 0.0, -1.5, 1.0),
    (0, 3, 1, None, None, None, None, 0.0, 0.25, 1.0),
    (0, 4, 0, 0, 120.0, 5, 6, 0.0, 0.0, 1.0),
    (0, 5, 4, None, None, None, None, 0.0, 2.0, 1.0),
    (0, 6, 4, None, None, None, None, 0.0, 4.0, 1.0),
    (1, 0, None, 4, 30.0, 1, 2, 0.0, 0.0, 0.1),
    (1, 1, 0, None, None, None, None, 0.0, 8.0, 0.1),
    (1, 2, 0, 1, 45.0, 3, 4, 0.0, 0.0, 0.1),
    (1, 3, 2, None, None, None, None, 0.0, -3.0, 0.1),
    (1, 4, 2, None, None, None, None, 0.0, 5.0, 0.1),
)


def _forest_sql() -> str:
    rows = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in FOREST)
    x = "[" + ", ".join(LABS) + "]"
    step = "CASE WHEN coalesce(x[n.feature + 1] <= n.cut, false) THEN n.l ELSE n.r END"
    return (
        f"WITH RECURSIVE {FILLED_SQL}, nodes(tree, node, parent, feature, cut, l, r, cover, value, weight) AS (VALUES {rows}), "
        f"bg AS (SELECT row_number() OVER () AS rid, {x} AS x FROM filled), lastv AS (SELECT user_id, {x} AS x FROM filled QUALIFY "
        "row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1), walk AS (SELECT rid, x, tree, node FROM bg, "
        f"nodes WHERE parent IS NULL UNION ALL SELECT rid, x, n.tree, {step} FROM walk w JOIN nodes n ON w.tree = n.tree AND "
        "w.node = n.node WHERE n.feature IS NOT NULL), leaves AS (SELECT rid, tree, value FROM walk JOIN nodes USING (tree, node) WHERE "
        "feature IS NULL), means AS (SELECT w.tree, w.node, avg(value) AS v FROM walk w JOIN leaves l ON w.rid = l.rid AND w.tree = "
        "l.tree GROUP BY ALL), known AS (SELECT n.* EXCLUDE (value), CASE WHEN feature IS NULL THEN value ELSE coalesce(v, value) END AS "
        "value FROM nodes n LEFT JOIN means USING (tree, node)), path AS (SELECT user_id, x, tree, node, NULL::INTEGER AS feature, "
        "0.0::DOUBLE AS w FROM lastv, known WHERE parent IS NULL UNION ALL SELECT user_id, x, n.tree, c.node, n.feature, (c.value - "
        f"n.value) * n.weight FROM path p JOIN known n ON p.tree = n.tree AND p.node = n.node JOIN known c ON c.tree = n.tree AND c.node = {step}), "
        "sums AS (SELECT user_id, feature, sum(w) AS w FROM path WHERE feature IS NOT NULL GROUP BY ALL), places AS (SELECT unnest(["
        + ", ".join(f"'{f}'" for f in LABS)
        + f"]) AS name, unnest(range({len(LABS)})) AS position) SELECT l.user_id, name AS feature, position::INTEGER AS position, "
        "round(x[position + 1], 6) AS value, round(coalesce(w, 0), 9) AS weight FROM lastv l, places LEFT JOIN sums s ON s.user_id = "
        "l.user_id AND s.feature = position"
    )


@query("attribute_trees", _forest_sql())
def attribute_trees(spark: SparkSession, sf: str) -> DataFrame:
    """What each lab adds to the score of a given forest at a record's last visit, against all visits."""
    filled = stored(sequence.forward_fill(i.visits(spark, sf), VISITS))
    last = sequence.last_visit(filled, VISITS)
    nodes = trees.with_background(spark.createDataFrame(list(FOREST), trees.NODE), filled, LABS)
    out = trees.attribute_trees(last, "user_id", LABS, nodes)
    return out.select("user_id", "feature", "position", *rounded(["value"]), *rounded(["weight"], 9))


@query(
    "boosted_tree_paths",
    f"WITH {i.SPLIT_SQL} SELECT user_id, 0.0::DOUBLE AS score_gap, 0.0::DOUBLE AS contribution_gap FROM split",
)
def boosted_tree_paths(spark: SparkSession, sf: str) -> DataFrame:
    """For each record, how far the model's prediction lies from the paths through its table of nodes,
    and the score from the expected score and all contributions."""
    last = last_visits(spark, sf).withColumn("target", F.col("los") + stay_noise())
    model = models.fit_gbt(_part(last, "train"), LABS, "target", task="los")
    nodes = trees.tree_table(spark, model)
    added = trees.attribute_trees(last, "user_id", LABS, nodes).groupBy("user_id").agg(F.sum("weight").alias("added"))
    scores = trees.tree_scores(last, "user_id", LABS, nodes)
    both = models.score(model, last, LABS).select("user_id", "p").join(scores, "user_id").join(added, "user_id")
    expected = trees.expected_score(nodes).scalar()
    gaps = {"score_gap": F.col("p") - F.col("score"), "contribution_gap": F.col("score") - F.col("added") - expected}
    return both.select("user_id", *[F.round(F.abs(c), 6).alias(n) for n, c in gaps.items()])


TEXT_DIM = 64


def fused(spark: SparkSession, sf: str) -> DataFrame:
    """Two embeddings per record and a text vector for those with a positive first element."""
    vecs = i.vectors(spark, sf)
    doubled = vecs.select("record_id", F.transform("vector", lambda v: v * 2).alias("vector"))
    texts = vecs.where(F.get("vector", F.lit(0)) > 0).select("record_id", "vector")
    ehr = {"one": vecs.select("record_id", "vector"), "two": doubled}
    return models.fusion_features(ehr, texts, "record_id", TEXT_DIM)


@query(
    "fusion_features",
    "WITH cells AS (SELECT vec_id AS record_id, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS v, "
    "embedding[1] > 0 AS has_text FROM embeddings), parts AS (SELECT record_id, k, v FROM cells UNION ALL SELECT record_id, "
    "k + 64, 2 * v FROM cells UNION ALL SELECT record_id, k + 128, CASE WHEN has_text THEN v ELSE 0 END FROM cells) "
    "SELECT record_id, count(*) AS width, round(sum(v), 6) AS total, round(sum(v * k), 4) AS weighted FROM parts GROUP BY 1",
)
def fusion_features(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("features")
    zero = F.lit(0.0)
    return fused(spark, sf).select(
        "record_id",
        F.size(x).cast("bigint").alias("width"),
        F.round(F.aggregate(x, zero, lambda a, v: a + v), 6).alias("total"),
        F.round(
            F.aggregate(F.transform(x, lambda v, k: v * (k + 1)), zero, lambda a, v: a + v), 4
        ).alias("weighted"),
    )


@query("fusion_scores", "SELECT vec_id AS record_id, 1 AS in_range FROM embeddings")
def fusion_scores(spark: SparkSession, sf: str) -> DataFrame:
    labels = i.vectors(spark, sf).select("record_id", (F.col("label") < 5).cast("double").alias("label"))
    data = fused(spark, sf).join(labels, "record_id")
    placed = split.stratified_split(labels, "record_id", "label", 0.2, 0.25)
    data = stored(split.apply_split(data, placed.select("record_id", "split"), "record_id"))
    model, _ = models.fit_fusion(_part(data, "train"), _part(data, "val"))
    from pyspark.ml.functions import array_to_vector

    ready = data.withColumn("_x", array_to_vector("features"))
    return covered(models.score_vectors(model, ready), "record_id").drop("split")


@query("fusion_forward", "SELECT vec_id AS record_id, 0.0::DOUBLE AS gap FROM embeddings")
def fusion_forward(spark: SparkSession, sf: str) -> DataFrame:
    """For each record, how far the fitted network's score lies from that of its table of units."""
    labels = i.vectors(spark, sf).select("record_id", (F.col("label") < 5).cast("double").alias("label"))
    data = stored(fused(spark, sf).join(labels, "record_id"))
    model, _ = models.fit_fusion(data, data, widths=NARROW)
    from pyspark.ml.functions import array_to_vector

    scored = models.score_vectors(model, data.withColumn("_x", array_to_vector("features")), "fitted").drop("_x")
    out = networks.network_scores(scored, networks.network_table(spark, model))
    return out.select("record_id", F.round(F.abs(F.col("p") - F.col("fitted")), 6).alias("gap"))


#: Width of the network of the query above.
NARROW = (8,)
#: A given network over the test vectors: layer, unit, weights, bias.
NETWORK = (
    *[(0, k, [((7 * k + 3 * n) % 11 - 5) / 20 for n in range(TEXT_DIM)], (k - 1) / 4) for k in range(3)],
    (1, 0, [0.5, -1.0, 0.25], 0.1),
    (1, 1, [-0.75, 1.5, 1.0], -0.2),
)


def _network_sql() -> str:
    hidden, last = ([u for u in NETWORK if u[0] == layer] for layer in (0, 1))
    sums = ", ".join(f"list_dot_product(embedding::DOUBLE[], {w}::DOUBLE[]) + {b} AS h{k}" for _, k, w, b in hidden)
    gates = [f"(1 / (1 + exp(-h{k})))" for _, k, _, _ in hidden]
    z = [" + ".join([str(b), *[f"{v} * {g}" for v, g in zip(w, gates, strict=True)]]) for _, _, w, b in last]
    return f"SELECT vec_id AS record_id, round(1 / (1 + exp(({z[0]}) - ({z[1]}))), 9) AS p FROM (SELECT vec_id, {sums} FROM embeddings)"


@query("network_scores", _network_sql())
def network_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector's score by a given network."""
    units = spark.createDataFrame(list(NETWORK), networks.UNIT)
    scored = networks.network_scores(i.vectors(spark, sf), units, "vector")
    return scored.select("record_id", F.round("p", 9).alias("p"))


# --- composed flows ------------------------------------------------------------------------------------------


@query(
    "prepared_cohort",
    f"WITH {i.TRAIN_SQL}, {i.stats_sql('train', SCALED)}, {_wide_stats_sql(('mean', 'std', 'default_fill'))}, "
    "z AS (SELECT user_id, ts, event_id, split, "
    + ", ".join(f"CASE WHEN abs({_z_sql(f)}) > 1e4 THEN 0 ELSE {_z_sql(f)} END AS {f}" for f in LABS)
    + ", "
    + ", ".join(f"default_fill_{f}" for f in LABS)
    + " FROM parted, wide), f AS (SELECT user_id, split, "
    + ", ".join(f"coalesce(last_value({f} IGNORE NULLS) {LAST_SO_FAR}, default_fill_{f}) AS {f}" for f in LABS)
    + " FROM z) SELECT user_id, split, count(*)::INTEGER AS length, "
    + ", ".join(f"round(sum({f}), 5) AS {f}" for f in LABS)
    + " FROM f GROUP BY 1, 2",
)
def prepared_cohort(spark: SparkSession, sf: str) -> DataFrame:
    out = cohort_plan.prepare_cohort(
        i.visits(spark, sf), VISITS, "outcome", i.SPLIT_TEST, i.SPLIT_VAL, los="los", seed=i.SPLIT_SEED
    )
    total = lambda k: F.aggregate("x", F.lit(0.0), lambda a, v: a + F.get(v, F.lit(k)))
    return out.sequences.select(
        "user_id",
        "split",
        "length",
        *[F.round(total(k), 5).alias(f) for k, f in enumerate(LABS)],
    )


def saved_and_loaded(spark: SparkSession, preparation: Preparation, train: DataFrame) -> PreparationModel:
    path = scratch(spark)
    preparation.fit(train).write().save(path)
    return PreparationModel.load(path)


@query(
    "fitted_preparation",
    f"WITH {i.TRAIN_SQL}, {i.stats_sql('train', SCALED)}, {_wide_stats_sql(('mean', 'std', 'default_fill'))}, "
    "z AS (SELECT user_id, ts, event_id, split, "
    + ", ".join(f"CASE WHEN abs({_z_sql(f)}) > 1e4 THEN 0 ELSE {_z_sql(f)} END AS {f}" for f in SCALED)
    + ", "
    + ", ".join(f"default_fill_{f}" for f in LABS)
    + " FROM parted, wide) SELECT event_id, split, round(los, 5) AS los, "
    + ", ".join(f"round(coalesce(last_value({f} IGNORE NULLS) {LAST_SO_FAR}, default_fill_{f}), 5) AS {f}" for f in LABS)
    + " FROM z",
)
def fitted_preparation(spark: SparkSession, sf: str) -> DataFrame:
    """Visits of all splits, prepared by a model that was fitted on the training split, saved and loaded."""
    parted = stored(split.apply_split(i.visits(spark, sf), stored(visit_split(spark, sf)), "user_id"), ["split"])
    model = saved_and_loaded(spark, Preparation(VISITS, SCALED), _part(parted, "train"))
    return model.transform(parted).select("event_id", "split", *rounded(SCALED, 5))


@query(
    "fitted_preparation_levels",
    f"WITH {i.ORDER_VISITS_SQL}, train AS (SELECT * FROM order_visits WHERE o_orderpriority <> '5-LOW'), "
    f"{i.stats_sql('train', ('o_totalprice',))} SELECT o_orderkey, (o_orderpriority = '5-LOW')::INTEGER AS unseen, "
    "(o_orderpriority = '1-URGENT')::INTEGER::DOUBLE AS urgent, (o_orderpriority <> '5-LOW')::INTEGER::DOUBLE AS seen, "
    "round(CASE WHEN abs((o_totalprice - mean) / (std + 1e-12)) > 1e4 THEN 0 ELSE (o_totalprice - mean) / (std + 1e-12) END, 5) "
    "AS o_totalprice FROM order_visits, stats",
)
def fitted_preparation_levels(spark: SparkSession, sf: str) -> DataFrame:
    """All orders, prepared by a model whose training orders hold every priority but the lowest."""
    visits = i.order_visits(spark, sf)
    train = visits.where("o_orderpriority <> '5-LOW'")
    model = saved_and_loaded(spark, Preparation(i.ORDER_VISITS, ("o_totalprice",)), train)
    levels = [col(c) for c in model.encoded_schema().labs if c.startswith("o_orderpriority->")]
    return model.transform(visits).select(
        "o_orderkey",
        F.col(UNSEEN).alias("unseen"),
        col("o_orderpriority->1-URGENT").alias("urgent"),
        sum(levels[1:], levels[0]).alias("seen"),
        *rounded(["o_totalprice"], 5),
    )


#: Orders with a code and an amount per customer: the code is not scaled, the amount is.
STATIC_VISITS = VisitSchema(
    key="o_custkey",
    time="o_orderdate",
    tiebreak=("o_orderkey",),
    targets=("outcome",),
    static=("rich", "c_acctbal"),
    scaled_static=("c_acctbal",),
    numeric=("o_totalprice",),
    categorical=("o_orderstatus",),
)
STATIC_SCALED = ("o_totalprice", "c_acctbal")
STATIC_LEVELS = ("F", "O", "P")
STATIC_SQL = (
    f"{i.ORDER_VISITS_SQL}, visits AS (SELECT *, (c_acctbal > 0)::INTEGER::DOUBLE AS rich FROM order_visits), labels_o AS "
    "(SELECT o_custkey, outcome FROM visits QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, "
    "o_orderkey) = 1), "
    + i.split_sql("labels_o", "o_custkey", "outcome", i.SPLIT_TEST, i.SPLIT_VAL, i.SPLIT_SEED)
    + ", parted AS (SELECT v.*, s.split FROM visits v JOIN split s USING (o_custkey)), train AS (SELECT * FROM parted WHERE "
    f"split = 'train'), {i.stats_sql('train', STATIC_SCALED)}, wide AS (SELECT "
    + ", ".join(f"max(CASE WHEN feature = '{f}' THEN {v} END) AS {v}_{f}" for f in STATIC_SCALED for v in ("mean", "std"))
    + " FROM stats)"
)


def static_cohort(spark: SparkSession, sf: str):
    visits = i.order_visits(spark, sf).withColumn("rich", (F.col("c_acctbal") > 0).cast("double"))
    return cohort_plan.prepare_cohort(visits, STATIC_VISITS, "outcome", i.SPLIT_TEST, i.SPLIT_VAL, seed=i.SPLIT_SEED)


def _clipped_sql(f: str) -> str:
    return f"round(CASE WHEN abs({_z_sql(f)}) > 1e4 THEN 0 ELSE {_z_sql(f)} END, 5)"


def _elements(rows: DataFrame) -> DataFrame:
    """One row per visit with every element of ``x``."""
    names = ("rich", "c_acctbal", *(f"is_{v.lower()}" for v in STATIC_LEVELS), "o_totalprice")
    visit = rows.select("o_custkey", "part", "split", F.posexplode("x").alias("step", "v"))
    return visit.select(
        "o_custkey", "part", "split", (F.col("step") + 1).cast("bigint").alias("step"),
        *[F.round(F.get("v", F.lit(k)), 5).alias(n) for k, n in enumerate(names)],
    )


def _elements_sql(amount: str, price: str) -> str:
    return (
        f"WITH {STATIC_SQL} SELECT o_custkey, 0::INTEGER AS part, split, row_number() OVER (PARTITION BY o_custkey ORDER BY "
        f"o_orderdate, o_orderkey) AS step, rich, {amount} AS c_acctbal, "
        + ", ".join(f"(o_orderstatus = '{v}')::INTEGER::DOUBLE AS is_{v.lower()}" for v in STATIC_LEVELS)
        + f", {price} AS o_totalprice FROM parted, wide"
    )


@query("prepared_cohort_static", _elements_sql(_clipped_sql("c_acctbal"), _clipped_sql("o_totalprice")))
def prepared_cohort_static(spark: SparkSession, sf: str) -> DataFrame:
    return _elements(static_cohort(spark, sf).sequences)


@query("prepared_cohort_raw", _elements_sql("round(c_acctbal, 5)", "round(o_totalprice, 5)"))
def prepared_cohort_raw(spark: SparkSession, sf: str) -> DataFrame:
    return _elements(static_cohort(spark, sf).raw)


@query(
    "evaluation_report",
    f"WITH {i.PREDS_MODELS_SQL}, {class_sql('preds_models', 'model')}, {curve_sql('preds_models', 'model')}, "
    f"r AS (SELECT model, {RANKING_SQL} FROM curve GROUP BY 1), m AS (SELECT r.model, {rounded_sql(BINARY)} FROM r "
    "JOIN class c ON r.model = c.model) "
    + " UNION ALL ".join(f"SELECT model, '{b}' AS metric, {b} AS value FROM m" for b in BINARY),
)
def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation_plan.evaluate(i.preds_models(spark, sf), "outcome", ["model"])
    return out.select("model", "metric", F.round("value", 6).alias("value"))


@query(
    "consultation_report",
    f"WITH {i.RESPONSES_SQL}, acts AS (SELECT patient_id, round, CASE WHEN action LIKE 'Yes%' THEN 1 ELSE 0 END AS act "
    "FROM responses GROUP BY ALL), s AS (SELECT patient_id, min(round) FILTER (act = 0) AS stop FROM acts GROUP BY 1), "
    "heard AS (SELECT r.*, coalesce(stop, 3) AS last FROM responses r JOIN s ON r.patient_id = s.patient_id), "
    "m AS (SELECT patient_id, round(avg(logit::DOUBLE), 9) AS mean_logit, round(sum(confidence::DOUBLE * logit::DOUBLE) / "
    "sum(confidence::DOUBLE), 9) AS weighted_logit, min(last) AS rounds FROM heard WHERE round = last GROUP BY 1) "
    "SELECT m.patient_id, rounds, (stop IS NOT NULL)::INTEGER AS consensus, mean_logit, weighted_logit FROM m JOIN s "
    "ON m.patient_id = s.patient_id",
)
def consultation_report(spark: SparkSession, sf: str) -> DataFrame:
    out = consultation_plan.summarise_consultations(i.responses(spark, sf))
    return out.select(
        "patient_id",
        "rounds",
        F.col("consensus").cast("int").alias("consensus"),
        *rounded(["mean_logit", "weighted_logit"], 9),
    )

"""Queries on descriptions, patient texts and reviewer rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.functions import fixed_values as fixed
from clinframe.functions import narrative as n
from clinframe.operators import consensus, metrics, profile, sequence
from clinframe.queries import inputs as i
from clinframe.queries.cohort import FILLED_SQL, IN_ORDER, rounded
from clinframe.queries.inputs import LABS, VISITS
from clinframe.queries.registry import query

# --- scalars ----------------------------------------------------------------------------------------------


def number_sql(x: str, decimals: int = 2) -> str:
    """SQL of :func:`number_text`."""
    text = f"round(CAST({x} AS DECIMAL(28, 8)), {decimals})::VARCHAR"
    return f"coalesce(regexp_replace({text}, '0{{1,{decimals - 1}}}$', ''), 'nan')"


CHANGE_SQL = (
    "changes AS (SELECT event_id, user_id, value, (value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / "
    "100 AS change FROM events)"
)


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """Change of the measured value since the record's previous event."""
    from pyspark.sql import Window

    e = i.table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.withColumn("change", (F.col("value") - before) / 100)


@query(
    "change_descriptions",
    f"WITH {CHANGE_SQL} SELECT event_id, round(CAST(abs(change) * 100 AS DECIMAL(28, 8)), 2)::DOUBLE AS percent, CASE WHEN change > 0 THEN "
    "'increased' WHEN change <= 0 THEN 'decreased' END AS trend, CASE WHEN change > 0 THEN 'decrease' WHEN change <= 0 "
    "THEN 'increase' END AS advice FROM changes",
)
def change_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    change = F.col("change")
    return changes(spark, sf).select(
        "event_id",
        n.pct_change_desc(change).alias("percent"),
        n.trend_desc(change).alias("trend"),
        n.advice_desc(change).alias("advice"),
    )


#: Ranges of the test labs; ``view`` has none.
RANGES = {"click": (20.0, 60.0), "error": (5.0, 30.0), "purchase": (50.0, 150.0), "signup": (1.0, 40.0)}
RANGES_SQL = "(VALUES " + ", ".join(
    f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in RANGES.items()
) + ") r(event_type, lo, hi)"


@query(
    "range_desc",
    "SELECT event_id, CASE WHEN lo IS NULL THEN '' WHEN value < lo THEN 'the value is lower than normal range by ' || "
    f"{number_sql('(lo - value) / lo * 100')} || '%' WHEN value > hi THEN 'the value is higher than normal range by ' || "
    f"{number_sql('(value - hi) / hi * 100')} || '%' ELSE 'the value is within the normal range' END AS description "
    f"FROM events e LEFT JOIN {RANGES_SQL} ON e.event_type = r.event_type",
)
def range_desc(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(k, a, b) for k, (a, b) in RANGES.items()]
    ranges = spark.createDataFrame(rows, "event_type string, lo double, hi double")
    e = i.table(spark, sf, "events").select("event_id", "event_type", "value")
    # One row per lab.
    joined = e.join(F.broadcast(ranges), "event_type", "left")
    return joined.select(
        "event_id", n.range_desc(F.col("value"), F.col("lo"), F.col("hi")).alias("description")
    )


def versus_sql(value: str, center: str) -> str:
    def percent(gap: str) -> str:
        return f"round(CAST({gap} / {center} * 100 AS DECIMAL(28, 8)), 0)::VARCHAR || '.0%'"

    return (
        f"CASE WHEN {center} = 0 THEN NULL WHEN {value} < {center} THEN {percent(f'({center} - {value})')} || ' lower' "
        f"WHEN {value} > {center} THEN {percent(f'({value} - {center})')} || ' higher' "
        f"WHEN {value} = {center} THEN 'equal' END"
    )


@query(
    "vs_cohort_desc",
    f"WITH c AS (SELECT event_type, median(value) AS center FROM events GROUP BY 1) SELECT event_id, "
    f"{versus_sql('value', 'center')} AS description FROM events e JOIN c ON e.event_type = c.event_type",
)
def vs_cohort_desc(spark: SparkSession, sf: str) -> DataFrame:
    e = i.table(spark, sf, "events").select("event_id", "event_type", "value")
    centers = profile.cohort_profile(e, "event_type", ["value"]).select(
        "event_type", F.col("p50").alias("center")
    )
    joined = e.join(F.broadcast(centers), "event_type")  # one row per lab
    return joined.select(
        "event_id", n.vs_cohort_desc(F.col("value"), F.col("center")).alias("description")
    )


RISK_SQL = "CASE WHEN p < 0.5 THEN 'a low level' WHEN p < 0.7 THEN 'a high level' ELSE 'an extremely high level' END"
BAND_SQL = (
    "CASE WHEN share * 100 < 40 THEN 'at the bottom 40% levels' WHEN share * 100 < 70 THEN "
    "'at the middle 30% levels' ELSE 'at the top 30% levels' END"
)


@query(
    "risk_level",
    f"WITH {i.PREDS_MODELS_SQL} SELECT o_orderkey, model, {RISK_SQL} AS risk FROM preds_models",
)
def risk_level(spark: SparkSession, sf: str) -> DataFrame:
    return i.preds_models(spark, sf).select(
        "o_orderkey", "model", n.risk_level(F.col("p")).alias("risk")
    )


@query(
    "rank_band",
    f"WITH {i.PREDS_MODELS_SQL}, s AS (SELECT *, cume_dist() OVER (PARTITION BY model ORDER BY p) AS share "
    f"FROM preds_models) SELECT o_orderkey, model, round(share, 6) AS share, {BAND_SQL} AS band FROM s",
)
def rank_band(spark: SparkSession, sf: str) -> DataFrame:
    ranked = metrics.percentile_rank(i.preds_models(spark, sf), ["model"])
    return ranked.select(
        "o_orderkey", "model", *rounded(["share"]), n.rank_band(F.col("share")).alias("band")
    )


WEIGHTS_SQL = (
    "weights AS (SELECT vec_id AS record_id, generate_subscripts(embedding, 1) - 1 AS position, unnest(embedding)::DOUBLE "
    "AS weight FROM embeddings)"
)


def weights(spark: SparkSession, sf: str) -> DataFrame:
    v = i.vectors(spark, sf)
    return v.select("record_id", F.posexplode("vector").alias("position", "weight")).withColumn(
        "weight", F.col("weight").cast("double")
    )


@query(
    "top_features",
    f"WITH {WEIGHTS_SQL} SELECT record_id, position, round(abs(weight), 6) AS attention, row_number() OVER "
    "(PARTITION BY record_id ORDER BY abs(weight) DESC, position) AS rank FROM weights QUALIFY rank <= 3",
)
def top_features(spark: SparkSession, sf: str) -> DataFrame:
    top = n.top_features(weights(spark, sf), ["record_id"])
    return top.select("record_id", "position", *rounded(["attention"]), "rank")


#: Names of the test labs, with the units and ranges of real ones.
TEST_DIM = {
    lab: {
        "name": fixed.DISPLAY_NAMES[real],
        "unit": fixed.UNITS[real],
        "range": fixed.HEALTHY_RANGES.get(real),
        "patient_range": fixed.DIALYSIS_RANGES.get(real),
    }
    for lab, real in zip(LABS, ("WBC", "Hb", "Glucose", "Weight", "SBP"), strict=True)
}


def line_sql(lab: str) -> str:
    known = TEST_DIM[lab]
    tail = ('". ' + n.range_suffix(known)).replace("'", "''")
    return (
        f"'- {known['name']}: \"' || string_agg({number_sql(lab)}, ', ' {IN_ORDER}) || '{tail}'"
    )


@query(
    "series_text",
    f"WITH {FILLED_SQL} "
    + " UNION ALL ".join(
        f"SELECT user_id, 0 AS part, '{lab}' AS feature, {line_sql(lab)} AS text FROM filled GROUP BY 1" for lab in LABS
    ),
)
def series_text(spark: SparkSession, sf: str) -> DataFrame:
    seqs = sequence.to_sequences(sequence.forward_fill(i.visits(spark, sf), VISITS), VISITS)
    lines = n.series_text(seqs.select("user_id", "part", "x"), LABS, TEST_DIM)
    return lines.select("user_id", "part", "feature", "text")


FLAGS = list(fixed.COMORBIDITIES)
DISEASE_WORDS = {"BUILDING": "IGA肾病", "AUTOMOBILE": "DN", "MACHINERY": "多囊肾", "HOUSEHOLD": "肾炎"}


@query(
    "decode_demographics",
    "SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN 'male' ELSE 'female' END AS sex, CASE c_mktsegment "
    + " ".join(f"WHEN '{k}' THEN '{fixed.ORIGINAL_DISEASES[v]}'" for k, v in DISEASE_WORDS.items())
    + " END AS disease, concat_ws(', ', "
    + ", ".join(
        f"CASE WHEN (c_nationkey // {2**k}) % 2 = 1 THEN '{fixed.COMORBIDITIES[f]}' END" for k, f in enumerate(FLAGS)
    )
    + ") AS comorbidities FROM customer",
)
def decode_demographics(spark: SparkSession, sf: str) -> DataFrame:
    c = i.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    coded = F.coalesce(
        *[F.when(F.col("c_mktsegment") == k, F.lit(f"{v} II")) for k, v in DISEASE_WORDS.items()],
        F.lit("- -"),
    )
    coded_flags = {
        f: F.floor(F.col("c_nationkey") / 2**k) % 2 for k, f in enumerate(FLAGS)
    }
    c = c.withColumns({"sex": F.col("c_custkey") % 2, "origin": coded, **coded_flags})
    return c.select(
        "c_custkey",
        n.sex_word(F.col("sex")).alias("sex"),
        n.original_disease(F.col("origin")).alias("disease"),
        n.comorbidities().alias("comorbidities"),
    )


@query(
    "truncate_note",
    "SELECT doc_id, md5(substr(text, 1, 1024)) AS digest, least(length(text), 1024) AS characters FROM documents",
)
def truncate_note(spark: SparkSession, sf: str) -> DataFrame:
    d = i.table(spark, sf, "documents").select("doc_id", n.truncate_note(F.col("text")).alias("note"))
    return d.select(
        "doc_id",
        F.md5(F.col("note").cast("binary")).alias("digest"),
        F.length("note").cast("bigint").alias("characters"),
    )


# --- one text per patient and model ------------------------------------------------------------------------

CONTEXT_MODELS = ("linear", "forest")
_P = i.sql_hash("user_id || ':' || model")


@query(
    "patient_context",
    f"WITH {FILLED_SQL}, lines AS ("
    + " UNION ALL ".join(
        f"SELECT user_id, {k} AS k, {line_sql(lab)} AS text FROM filled GROUP BY 1" for k, lab in enumerate(LABS)
    )
    + "), series AS (SELECT user_id, string_agg(text, chr(10) ORDER BY k) AS series FROM lines GROUP BY 1), "
    "risks AS (SELECT user_id, model, " + _P + " AS p FROM (SELECT DISTINCT user_id FROM visits), "
    "(VALUES " + ", ".join(f"('{m}')" for m in CONTEXT_MODELS) + ") m(model)), "
    "ranked AS (SELECT *, cume_dist() OVER (PARTITION BY model ORDER BY p) AS share FROM risks), "
    "lastv AS (SELECT * FROM filled QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1), "
    "cells AS (" + " UNION ALL ".join(
        f"SELECT user_id, outcome, '{lab}' AS feature, {k} AS position, {lab} AS value FROM lastv"
        for k, lab in enumerate(LABS)
    ) + "), centers AS (SELECT feature, median(value) FILTER (outcome = 0) AS survival, median(value) FILTER (outcome = 1) "
    "AS deceased FROM (" + i.unpivot_sql("filled", LABS, "outcome") + ") GROUP BY 1), "
    "weighted AS (SELECT user_id, model, feature, position, value, "
    + i.sql_hash("user_id || ':' || model || ':' || feature")
    + " - 0.5 AS weight FROM cells, (VALUES " + ", ".join(f"('{m}')" for m in CONTEXT_MODELS) + ") m(model)), "
    "top AS (SELECT *, row_number() OVER (PARTITION BY user_id, model ORDER BY abs(weight) DESC, position) AS rank "
    "FROM weighted QUALIFY rank <= 3), compared AS (SELECT user_id, model, string_agg(t.feature || "
    f"' stands at ' || {number_sql('value')} || ' and weighs ' || {number_sql('abs(weight)', 3)} || '. Survivors center on ' || "
    f"{number_sql('survival')} || ': ' || coalesce({versus_sql('value', 'survival')}, 'undefined') || '. The deceased center on ' || "
    f"{number_sql('deceased')} || ': ' || coalesce({versus_sql('value', 'deceased')}, 'undefined') || '.', chr(10) ORDER BY rank) AS text "
    "FROM top t JOIN centers c ON t.feature = c.feature GROUP BY 1, 2) "
    "SELECT r.user_id, r.model, 0 AS part, 'Patient ' || r.user_id || chr(10) || series || chr(10) || 'Model ' || r.model || "
    f"' puts the risk at ' || {number_sql('p')} || ' (' || {RISK_SQL} || '; ' || {BAND_SQL} || ' of all patients).' || chr(10) || "
    "c.text AS context FROM ranked r JOIN series s ON r.user_id = s.user_id JOIN compared c ON r.user_id = c.user_id AND r.model = c.model",
)
def patient_context(spark: SparkSession, sf: str) -> DataFrame:
    from clinframe.functions.hashing import unit_hash

    filled = sequence.forward_fill(i.visits(spark, sf), VISITS)
    seqs = sequence.to_sequences(filled, VISITS)
    series = seqs.select(
        "user_id",
        "part",
        F.concat_ws("\n", *[n.series_line(F.col("x"), k, TEST_DIM[lab]) for k, lab in enumerate(LABS)]).alias("series"),
    )
    models = F.explode(F.array(*map(F.lit, CONTEXT_MODELS))).alias("model")
    last = sequence.last_visit(filled, VISITS)
    risks = last.select("user_id", models).withColumn("p", unit_hash(F.col("user_id"), F.col("model")))
    cells = F.array(
        *[
            F.struct(F.lit(lab).alias("feature"), F.lit(k).alias("position"), F.col(lab).alias("value"))
            for k, lab in enumerate(LABS)
        ]
    )
    weighted = (
        last.select("user_id", F.inline(cells))
        .select("*", models)
        .withColumn("weight", unit_hash(F.col("user_id"), F.col("model"), F.col("feature")) - 0.5)
    )
    centers = (
        profile.cohort_profile(filled, "outcome", LABS)
        .groupBy("feature")
        .agg(
            F.max(F.when(F.col("outcome") == 0, F.col("p50"))).alias("survival"),
            F.max(F.when(F.col("outcome") == 1, F.col("p50"))).alias("deceased"),
        )
    )
    top = n.top_features(weighted, ["user_id", "model"])
    return n.patient_context(
        last.select("user_id", F.format_string("Patient %d", F.col("user_id")).alias("basic")),
        series,
        metrics.percentile_rank(risks, ["model"]),
        n.feature_comparison(top, centers),
        "user_id",
        cohort="all patients",
    ).select("user_id", "model", "part", "context")


# --- reviewer responses ------------------------------------------------------------------------------------

RAW_FORMS = (
    ("'```json' || chr(10) || props || chr(10) || '```'"),
    ("'Here is my answer. ```json ' || props || ' ``` I am sure.'"),
    ("'I think ' || props || ' is right.'"),
    ("'```json {\"reason\": [\"' || event_type"),
    ("'No object here: ' || event_type"),
    ("'```json {broken ' || event_type || '} ```'"),
)


def raw_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads wrapped as reviewers wrap them: fenced, in prose, bare, cut off, without JSON,
    and fenced but broken."""
    e = i.table(spark, sf, "events").select("event_id", "event_type", "props")
    forms = [
        F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")),
        F.concat(F.lit("Here is my answer. ```json "), F.col("props"), F.lit(" ``` I am sure.")),
        F.concat(F.lit("I think "), F.col("props"), F.lit(" is right.")),
        F.concat(F.lit('```json {"reason": ["'), F.col("event_type")),
        F.concat(F.lit("No object here: "), F.col("event_type")),
        F.concat(F.lit("```json {broken "), F.col("event_type"), F.lit("} ```")),
    ]
    raw = F.coalesce(*[F.when(F.col("event_id") % len(forms) == k, f) for k, f in enumerate(forms)])
    return e.select("event_id", "event_type", raw.alias("raw"))


RAW_SQL = (
    "raws AS (SELECT event_id, event_type, CASE event_id % 6 "
    + " ".join(f"WHEN {k} THEN {form}" for k, form in enumerate(RAW_FORMS))
    + " END AS raw FROM events), staged AS (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') || '\"]}```' AS done, "
    "CASE WHEN regexp_matches(raw, '(?s)```json(.*?)```') THEN 'fenced' WHEN regexp_matches(regexp_replace(raw, "
    "'^\\s+|\\s+$', '', 'g') || '\"]}```', '(?s)```json(.*?)```') THEN 'repaired' WHEN regexp_matches(raw, '(?s)\\{.*?\\}') "
    "THEN 'bare' ELSE 'none' END AS stage FROM raws), found AS (SELECT event_id, event_type, stage, replace(regexp_replace(CASE stage "
    "WHEN 'fenced' THEN regexp_extract(raw, '(?s)```json(.*?)```', 1) WHEN 'repaired' THEN regexp_extract(done, "
    "'(?s)```json(.*?)```', 1) WHEN 'bare' THEN regexp_extract(raw, '(?s)\\{.*?\\}', 0) END, '^\\s+|\\s+$', '', 'g'), "
    "chr(10), '') AS json FROM staged)"
)


@query(
    "extract_json",
    f"WITH {RAW_SQL} SELECT event_id, stage, json, CASE WHEN stage = 'none' THEN 'missing' WHEN json_valid(json) THEN 'ok' "
    "ELSE 'invalid' END AS status FROM found",
)
def extract_json(spark: SparkSession, sf: str) -> DataFrame:
    return raw_responses(spark, sf).select("event_id", consensus.extract_json(F.col("raw")).alias("x")).select(
        "event_id", "x.*"
    )


@query(
    "parse_responses",
    f"WITH {RAW_SQL} SELECT event_id, stage, CASE WHEN json_valid(json) THEN (json::JSON ->> '$.k')::BIGINT END AS k "
    "FROM found WHERE json_valid(json)",
)
def parse_responses(spark: SparkSession, sf: str) -> DataFrame:
    parsed = consensus.parse_responses(raw_responses(spark, sf), "raw", "k bigint, reason array<string>")
    return parsed.where(F.col("status") == "ok").select("event_id", "stage", F.col("answer.k").alias("k"))


@query(
    "response_fields",
    f"WITH {RAW_SQL} SELECT event_id, stage, CASE WHEN json_valid(json) THEN try_cast(json::JSON ->> '$.k' AS BIGINT) END AS k, "
    "CASE WHEN json_valid(json) THEN json::JSON ->> '$.reason[0]' END AS reason FROM found",
)
def response_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of two schemas from one column of answers."""
    answers = consensus.response_variants(raw_responses(spark, sf), "raw")
    fields = {"k": ("$.k", "bigint"), "reason": ("$.reason[0]", "string")}
    return consensus.response_fields(answers, fields).select("event_id", "stage", *fields)


@query(
    "response_quality",
    f"WITH {RAW_SQL} SELECT event_type, stage, CASE WHEN stage = 'none' THEN 'missing' WHEN json_valid(json) THEN 'ok' ELSE "
    "'invalid' END AS status, count(*) AS responses FROM found GROUP BY ALL",
)
def response_quality(spark: SparkSession, sf: str) -> DataFrame:
    """How often answers had to be repaired, were broken or missing, per kind of event."""
    return consensus.response_quality(consensus.response_variants(raw_responses(spark, sf), "raw"), ["event_type"])


@query(
    "parse_action",
    f"WITH {i.RESPONSES_SQL}, texts AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE 'yes: ' || text END AS t "
    "FROM conversations) SELECT conv_id, turn, CASE WHEN lower(t) LIKE '%yes%' THEN 1 WHEN lower(t) LIKE '%no%' THEN 0 ELSE -1 "
    "END AS action FROM texts",
)
def parse_action(spark: SparkSession, sf: str) -> DataFrame:
    c = i.table(spark, sf, "conversations")
    text = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("yes: "), F.col("text")))
    return c.select("conv_id", "turn", F.coalesce(consensus.parse_action(text), F.lit(-1)).alias("action"))


BAND_OF_SQL = (
    "CASE WHEN c IS NULL THEN 'low' WHEN try_cast(c AS INTEGER) = 1 THEN 'low' WHEN try_cast(c AS INTEGER) = 2 THEN "
    "'moderate' WHEN try_cast(c AS INTEGER) = 3 THEN 'high' ELSE 'invalid' END"
)


@query(
    "confidence_band",
    "WITH lines AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 7 THEN l_linenumber::VARCHAR END AS c "
    f"FROM lineitem) SELECT l_orderkey, l_linenumber, {BAND_OF_SQL} AS band FROM lines",
)
def confidence_band(spark: SparkSession, sf: str) -> DataFrame:
    lines = i.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    said = F.when(F.col("l_linenumber") < 7, F.col("l_linenumber").cast("string"))
    return lines.select("l_orderkey", "l_linenumber", consensus.confidence_band(said).alias("band"))


STATEMENT_SQL = {
    "initial": "'Diagnosis: ' || logit || chr(10) || 'Analysis: ' || analysis || chr(10) || 'Evidence: ' || e1 || chr(10) || e2",
    "vote": "'With ' || CASE confidence WHEN '1' THEN 'low' WHEN '2' THEN 'moderate' ELSE 'high' END || ' confidence: ' || "
    "answer || chr(10) || 'Reason: ' || reason || chr(10) || 'Documents: ' || e1 || chr(10) || e2",
    "revision": "'Diagnosis: ' || logit || chr(10) || 'Analysis: ' || analysis",
}


def statements(kind: str) -> None:
    number = "reviewer - 1" if kind == "revision" else "reviewer"
    tail = "" if kind == "revision" else " || chr(10)"

    @query(
        f"render_statements_{kind}",
        f"WITH {i.RESPONSES_SQL} SELECT patient_id, round, md5(string_agg('Doctor ' || ({number}) || "
        f"'''s statement is as following:' || chr(10) || {STATEMENT_SQL[kind]}, chr(10) ORDER BY reviewer){tail}) AS digest "
        "FROM responses GROUP BY 1, 2",
    )
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = consensus.render_statements(i.responses(spark, sf), kind)
        return out.select(
            "patient_id", "round", F.md5(F.col("statements").cast("binary")).alias("digest")
        )


for _kind in ("initial", "vote", "revision"):
    statements(_kind)


@query(
    "peer_opinions",
    f"WITH {i.RESPONSES_SQL} SELECT a.patient_id, a.round + 1 AS round, a.reviewer, string_agg(b.logit || ' ' || b.answer, "
    "chr(10) ORDER BY b.reviewer) AS opinions FROM responses a JOIN responses b ON a.patient_id = b.patient_id AND "
    "a.round = b.round AND a.reviewer <> b.reviewer GROUP BY 1, 2, 3",
)
def peer_opinions(spark: SparkSession, sf: str) -> DataFrame:
    said = i.responses(spark, sf).withColumn("said", F.concat_ws(" ", "logit", "answer"))
    return consensus.peer_opinions(said, "said")


def disagreements(rule: str, verdict: str) -> None:
    @query(
        f"disagreement_{rule}",
        f"WITH {i.PREDS_MODELS_SQL} SELECT o_orderkey, ({verdict})::INTEGER AS disagree FROM preds_models GROUP BY 1",
    )
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = consensus.disagreement(i.preds_models(spark, sf), "o_orderkey", "p", rule)
        return out.select("o_orderkey", F.col("disagree").cast("int").alias("disagree"))


_ACROSS = "min(p) < 0.5 AND max(p) > 0.5"
disagreements("split", _ACROSS)
disagreements("wide", f"{_ACROSS} AND max(p) - min(p) > 0.6")
disagreements("always", "true")


ROUNDS_SQL = (
    f"{i.RESPONSES_SQL}, rounds AS (SELECT patient_id, round, CASE WHEN action LIKE 'Yes%' THEN 1 ELSE 0 END AS action, "
    "'report ' || round AS report FROM responses WHERE reviewer = 1)"
)


def rounds(spark: SparkSession, sf: str) -> DataFrame:
    r = i.responses(spark, sf).groupBy("patient_id", "round").agg(F.min("action").alias("action"))
    return r.select(
        "patient_id",
        "round",
        consensus.parse_action(F.col("action")).alias("action"),
        F.concat(F.lit("report "), F.col("round").cast("string")).alias("report"),
    )


@query(
    "rounds_to_consensus",
    f"WITH {ROUNDS_SQL}, s AS (SELECT patient_id, min(round) FILTER (action = 0) AS stop FROM rounds GROUP BY 1) "
    "SELECT patient_id, coalesce(stop, 3) AS rounds, (stop IS NOT NULL)::INTEGER AS consensus, "
    "'report ' || coalesce(stop, 3) AS report FROM s",
)
def rounds_to_consensus(spark: SparkSession, sf: str) -> DataFrame:
    out = consensus.rounds_to_consensus(rounds(spark, sf))
    return out.withColumn("consensus", F.col("consensus").cast("int"))


@query(
    "fuse_mean",
    f"WITH {i.RESPONSES_SQL} SELECT patient_id, round(avg(logit::DOUBLE), 9) AS logit FROM responses WHERE round = 3 GROUP BY 1",
)
def fuse_mean(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.fuse(i.responses(spark, sf)).select("patient_id", *rounded(["logit"], 9))


@query(
    "fuse_confidence",
    f"WITH {i.RESPONSES_SQL} SELECT patient_id, round(sum(confidence::DOUBLE * logit::DOUBLE) / sum(confidence::DOUBLE), 9) AS "
    "logit FROM responses WHERE round = 3 GROUP BY 1",
)
def fuse_confidence(spark: SparkSession, sf: str) -> DataFrame:
    out = consensus.fuse(i.responses(spark, sf), "confidence")
    return out.select("patient_id", *rounded(["logit"], 9))


@query(
    "latest_opinion",
    f"WITH {i.RESPONSES_SQL} SELECT patient_id, reviewer, round, md5(reason || e1 || chr(10) || e2) AS digest FROM responses "
    "WHERE round = 3",
)
def latest_opinion(spark: SparkSession, sf: str) -> DataFrame:
    out = consensus.latest_opinion(i.responses(spark, sf))
    return out.select(
        "patient_id", "reviewer", "round", F.md5(F.col("opinion").cast("binary")).alias("digest")
    )


@query(
    "attach_truth",
    f"WITH {i.PREDS_MODELS_SQL}, fused AS (SELECT o_orderkey, avg(p) AS p FROM preds_models GROUP BY 1) SELECT f.o_orderkey, "
    "round(p, 6) AS p, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS ground_truth FROM fused f JOIN orders o "
    "ON f.o_orderkey = o.o_orderkey",
)
def attach_truth(spark: SparkSession, sf: str) -> DataFrame:
    fused = i.preds_models(spark, sf).groupBy("o_orderkey").agg(F.avg("p").alias("p"))
    o = i.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    labels = o.withColumn("outcome", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    out = consensus.attach_truth(fused, labels, "o_orderkey", "outcome")
    return out.select("o_orderkey", *rounded(["p"]), "ground_truth")

"""Rounds of reviewer responses: parsing, statements, stop rule, fusion and accounting.

(patient, round, reviewer) is the key of a response, so a gathered group (patient, round) is as
large as the panel, a handful. No pair of reviewers is ever joined: a panel is gathered once and
each member leaves out its own entry.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinframe.functions import fixed_values as fixed
from clinframe.schema import col

#: What marks a JSON answer in a text, and what completes a cut-off one.
FENCED = r"(?s)```json(.*?)```"
REPAIR = "\"]}```"
BARE = r"(?s)\{.*?\}"
SPLIT_POINT = 0.5
WIDE_GAP = 0.6
MAX_ROUND = 3
BANDS = {1: "low", 2: "moderate", 3: "high"}


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def extract_json(text: Column) -> Column:
    """``struct(stage, json, status)``: the JSON answer inside a free text.

    The first stage that matches decides: a fenced block, a fenced block after completing a
    cut-off text, a bare object. Its content must be valid JSON, else status is ``invalid``;
    without any match it is ``missing``.
    """
    completed = F.concat(_strip(text), F.lit(REPAIR))
    stage = (
        F.when(text.rlike(FENCED), "fenced")
        .when(completed.rlike(FENCED), "repaired")
        .when(text.rlike(BARE), "bare")
    )
    found = (
        F.when(stage == "fenced", F.regexp_extract(text, FENCED, 1))
        .when(stage == "repaired", F.regexp_extract(completed, FENCED, 1))
        .when(stage == "bare", F.regexp_extract(text, BARE, 0))
    )
    body = F.replace(_strip(found), F.lit("\n"), F.lit(""))
    status = (
        F.when(stage.isNull(), "missing")
        .when(F.try_parse_json(body).isNull(), "invalid")
        .otherwise("ok")
    )
    return F.struct(
        F.coalesce(stage, F.lit("none")).alias("stage"), body.alias("json"), status.alias("status")
    )


def parse_responses(df: DataFrame, raw: str, schema: str) -> DataFrame:
    """Adds ``stage``, ``status`` and the parsed struct ``answer`` of a response column."""
    out = df.withColumn("_x", extract_json(col(raw)))
    answer = F.when(F.col("_x.status") == "ok", F.from_json(F.col("_x.json"), schema))
    return out.withColumns(
        {"stage": F.col("_x.stage"), "status": F.col("_x.status"), "answer": answer}
    ).drop("_x")


def response_variants(df: DataFrame, raw: str) -> DataFrame:
    """Adds ``stage``, ``status`` and the answer of a response column as a VARIANT, ``answer``: one column for
    the answers of all phases, whatever their fields.

    ``answer`` is NULL unless ``status`` is ``ok``. An object that names a key twice is invalid, and so
    is a cut-off text that its completion does not close.
    """
    out = df.withColumn("_x", extract_json(col(raw)))
    answer = F.when(F.col("_x.status") == "ok", F.try_parse_json(F.col("_x.json")))
    return out.withColumns({"stage": F.col("_x.stage"), "status": F.col("_x.status"), "answer": answer}).drop("_x")


def response_fields(df: DataFrame, fields: Mapping[str, tuple[str, str]], answer: str = "answer") -> DataFrame:
    """Adds one column per entry of ``fields``, name → (path, type), read from a VARIANT column. A field
    that is absent, or whose value does not fit its type, is NULL."""
    return df.withColumns({n: F.try_variant_get(col(answer), path, kind) for n, (path, kind) in fields.items()})


def response_quality(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number of responses per group, stage and status, from ``response_variants``."""
    return df.groupBy(*map(col, by), "stage", "status").agg(F.count(F.lit(1)).alias("responses"))


def parse_action(text: Column) -> Column:
    """1 to go on (contains yes), 0 to stop (contains no), NULL for anything else."""
    lower = F.lower(text)
    return F.when(lower.contains("yes"), 1).when(lower.contains("no"), 0)


def confidence_band(confidence: Column) -> Column:
    """low for 1 or missing, moderate for 2, high for 3, else invalid."""
    level = confidence.try_cast("int")
    out = F.when(confidence.isNull(), BANDS[1])
    for value, word in BANDS.items():
        out = out.when(level == value, word)
    return out.otherwise("invalid")


def _evidence(evidences: Column) -> Column:
    return F.coalesce(F.array_join(evidences, "\n"), F.lit(""))


def statement(kind: str) -> Column:
    """Body of one reviewer's statement from its columns, by kind: ``initial`` (logit, analysis,
    evidences), ``vote`` (answer, reason, confidence, evidences), ``revision`` (logit, analysis)."""
    if kind == "initial":
        return F.concat(
            F.lit("Diagnosis: "), F.col("logit").cast("string"),
            F.lit("\nAnalysis: "), F.col("analysis"),
            F.lit("\nEvidence: "), _evidence(F.col("evidences")),
        )
    if kind == "vote":
        return F.concat(
            F.lit("With "), confidence_band(F.col("confidence")), F.lit(" confidence: "),
            F.col("answer"),
            F.lit("\nReason: "), F.col("reason"),
            F.lit("\nDocuments: "), _evidence(F.col("evidences")),
        )
    if kind == "revision":
        return F.concat(
            F.lit("Diagnosis: "), F.col("logit").cast("string"),
            F.lit("\nAnalysis: "), F.col("analysis"),
        )
    raise ValueError(f"unknown kind: {kind}")


def render_statements(
    responses: DataFrame,
    kind: str,
    by: Sequence[str] = ("patient_id", "round"),
    reviewer: str = "reviewer",
    header: str = fixed.STATEMENT_HEADER,
) -> DataFrame:
    """All statements of a round as one text, ordered by reviewer. Statements are numbered by
    place: from 1, in ``revision`` from 0 and without a final line break."""
    said = F.struct(col(reviewer).alias("who"), statement(kind).alias("body"))
    panel = responses.groupBy(*map(col, by)).agg(F.array_sort(F.collect_list(said)).alias("_p"))
    first = 0 if kind == "revision" else 1
    each = F.transform(
        F.col("_p"), lambda s, i: F.concat(F.format_string(header, i + first), s["body"])
    )
    text = F.array_join(each, "\n")
    if kind != "revision":
        text = F.concat(text, F.lit("\n"))
    return panel.select(*map(col, by), text.alias("statements"))


def peer_opinions(
    responses: DataFrame,
    text: str,
    patient: str = "patient_id",
    round_column: str = "round",
    reviewer: str = "reviewer",
) -> DataFrame:
    """What each reviewer hears in the next round: the opinions of all others, in order.

    The panel of a round is gathered once and handed to each of its members without their own
    entry; reviewers are not joined with each other. ``round`` in the result is the round in
    which the opinions are heard.
    """
    opinion = F.struct(col(reviewer).alias("who"), col(text).alias("said"))
    panel = responses.groupBy(col(patient), col(round_column)).agg(
        F.array_sort(F.collect_list(opinion)).alias("_p")
    )
    members = panel.select("*", F.explode(F.col("_p")["who"]).alias(reviewer))
    others = F.filter(F.col("_p"), lambda s: s["who"] != col(reviewer))
    return members.select(
        col(patient),
        (col(round_column) + 1).alias(round_column),
        col(reviewer),
        F.array_join(others["said"], "\n").alias("opinions"),
    )


def disagreement(preds: DataFrame, patient: str, p: str = "p", rule: str = "split") -> DataFrame:
    """Whether the models differ on a patient.

    ``split``: some below and some above 0.5; ``wide``: also further apart than 0.6;
    ``always`` and any unknown rule: true and false for everyone.
    """
    lo, hi = F.min(col(p)), F.max(col(p))
    across = (lo < SPLIT_POINT) & (hi > SPLIT_POINT)
    verdict = {
        "split": across,
        "wide": across & (hi - lo > WIDE_GAP),
        "always": F.count(F.lit(1)) > 0,
    }.get(rule, F.count(F.lit(1)) < 0)
    return preds.groupBy(col(patient)).agg(F.coalesce(verdict, F.lit(False)).alias("disagree"))


def rounds_to_consensus(
    rounds: DataFrame,
    patient: str = "patient_id",
    round_column: str = "round",
    action: str = "action",
    report: str = "report",
    max_round: int = MAX_ROUND,
) -> DataFrame:
    """Round that ended each consultation, whether by consensus, and its report.

    The first round with action 0 stops; otherwise ``max_round`` does. The report is that of
    the last round up to the stop.
    """
    heard = rounds.where(col(round_column) <= max_round)
    stop = F.min(F.when(col(action) == 0, col(round_column)))
    per_patient = heard.groupBy(col(patient)).agg(
        stop.alias("_stop"),
        F.max_by(col(report), col(round_column)).alias("_last"),
        F.min_by(col(report), F.when(col(action) == 0, col(round_column))).alias("_agreed"),
    )
    return per_patient.select(
        col(patient),
        F.coalesce("_stop", F.lit(max_round)).cast("int").alias("rounds"),
        F.col("_stop").isNotNull().alias("consensus"),
        F.when(F.col("_stop").isNotNull(), F.col("_agreed")).otherwise(F.col("_last")).alias("report"),
    )


def _last_round(columns: Sequence[str], round_column: str) -> Column:
    """Latest response of one reviewer."""
    return F.max_by(F.struct(*map(col, columns)), col(round_column)).alias("_r")


def _latest(
    responses: DataFrame, columns: Sequence[str], patient: str, round_column: str, reviewer: str
) -> DataFrame:
    return responses.groupBy(col(patient), col(reviewer)).agg(
        F.max(col(round_column)).alias(round_column), _last_round(columns, round_column)
    ).select(col(patient), col(reviewer), round_column, "_r.*")


def fuse(
    responses: DataFrame,
    how: str = "mean",
    patient: str = "patient_id",
    round_column: str = "round",
    reviewer: str = "reviewer",
    logit: str = "logit",
    confidence: str = "confidence",
) -> DataFrame:
    """One logit per patient from the responses of its last round.

    ``mean`` averages them, ``confidence`` weights them by confidence (NULL for zero weight).
    Values may be text; what is no number is left out.
    """
    p = col(logit).try_cast("double")
    c = col(confidence).try_cast("double") if how == "confidence" else F.lit(1.0)
    per_round = responses.groupBy(col(patient), col(round_column)).agg(
        F.sum(c * p).alias("_cp"), F.sum(F.when(p.isNotNull(), c)).alias("_c")
    )
    last = F.max_by(F.struct("_cp", "_c"), col(round_column)).alias("_l")
    fused = per_round.groupBy(col(patient)).agg(last)
    return fused.select(col(patient), F.try_divide("_l._cp", "_l._c").alias("logit"))


def latest_opinion(
    responses: DataFrame,
    patient: str = "patient_id",
    round_column: str = "round",
    reviewer: str = "reviewer",
) -> DataFrame:
    """Each reviewer's latest reason followed by its evidences."""
    last = _latest(responses, ["reason", "evidences"], patient, round_column, reviewer)
    text = F.concat(F.col("reason"), _evidence(F.col("evidences")))
    return last.select(col(patient), col(reviewer), round_column, text.alias("opinion"))


def attach_truth(final: DataFrame, labels: DataFrame, key: str, target: str) -> DataFrame:
    """Final logits with the label of the task."""
    return final.join(labels.select(col(key), col(target).alias("ground_truth")), key)

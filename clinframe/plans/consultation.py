"""From reviewer responses to the outcome of each consultation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinframe.operators import consensus
from clinframe.schema import col


def summarise_consultations(
    responses: DataFrame,
    patient: str = "patient_id",
    round_column: str = "round",
    action: str = "action",
    max_round: int = consensus.MAX_ROUND,
) -> DataFrame:
    """Rounds used, consensus, and the fused logits of the round that ended it.

    ``action`` is the summary's wish to go on, the same on every response of a round. Rounds
    after the stop do not count.
    """
    rounds = responses.groupBy(col(patient), col(round_column)).agg(
        F.min(consensus.parse_action(col(action))).alias("action"),
        F.lit(None).cast("string").alias("report"),
    )
    ended = consensus.rounds_to_consensus(
        rounds, patient, round_column, "action", "report", max_round
    ).drop("report")
    heard = responses.join(ended.select(col(patient), "rounds"), patient).where(
        col(round_column) <= F.col("rounds")
    )
    mean = consensus.fuse(heard, "mean", patient, round_column).withColumnRenamed("logit", "mean_logit")
    weighted = consensus.fuse(heard, "confidence", patient, round_column).withColumnRenamed(
        "logit", "weighted_logit"
    )
    return ended.join(mean, patient, "left").join(weighted, patient, "left")

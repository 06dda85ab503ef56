"""From raw documents to the tokens of a training mix, in five stages.

Each stage takes the documents its predecessor kept, as a table with the columns of ``documents``,
and works on all of them: toxic documents go, one document of each near-duplicate group stays,
personal data become surrogates, sources are mixed to their targets (a document stands in the mix
as often as it is copied), and the texts are encoded. Null and empty texts pass every stage; an
empty table stays empty; further columns of ``documents`` are kept up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.llm import bpe, copies, mixing, pii, toxicity
from clinframe.llm.common import apart
from clinframe.llm.queries import PII_KEY, RANKS
from clinframe.session import stored

#: Columns the stages read; all others travel beside them, whatever their names.
READ = ("doc_id", "text", "lang", "source", "n_chars")

#: Rows of one batch between Spark and Python: texts can be long, every task holds a batch several times
#: outside the heap (each buffer at up to twice its size, and on both sides), and keeps the space.
BATCH_ROWS, BATCH_BYTES = 1000, "1m"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _small_batches(stage: Stage) -> Stage:
    """``stage`` with batches of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES``, from here on in the session."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        if not 0 < rows <= BATCH_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run_stage


@_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below one half, the model being fitted on the labelled ones among
    them outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    slim, whole = apart(docs, READ)
    weights = toxicity.train(slim, labels, ~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(slim, weights)
    return whole(scored.where(F.col("toxicity.score") < 0.5))


@_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links at a five-word Jaccard similarity of 0.8 or more: that
    with the smallest doc_id."""
    return copies.keep_first(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; n_chars follows the new text."""
    slim, whole = apart(docs, READ)
    found = pii.replace(slim, PII_KEY)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.col("n_entities") > 0, length).otherwise(F.col("n_chars")))
    return whole(found)


@_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    slim, whole = apart(docs, READ)
    mixed = mixing.mix(slim.withColumn("size", mixing.words(F.col("text"))))
    return whole(mixed.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies")))))


@_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text (little-endian unsigned 32-bit integers), and the hash of the bytes that
    decoding them gives."""
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    found = bpe.token_rows(docs, ranks, public_tokenizers.PATTERN, ("doc_id", "source"))
    return found.select("doc_id", "source", "n_tokens", "ids", "decoded_sha256")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the fitted model nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read
    again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

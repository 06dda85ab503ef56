"""Reading document corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.operators.skew import running_sums

FIELDS = "title string, content string"


def read_corpus(spark: SparkSession, path: str, corpus: str, lines: bool = True) -> DataFrame:
    """``(doc_id, corpus, source, idx, title, content)`` from JSON files.

    With ``lines`` each line is a document; ``source`` is the file name and ``idx`` the line
    number within its file, counted over the file's blocks. Without ``lines`` each file is one
    document with ``idx`` 0.
    """
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl?$", "")
    if not lines:
        read = spark.read.schema(FIELDS).option("multiLine", True).json(path)
        docs = read.select(name.alias("source"), F.lit(0).cast("bigint").alias("idx"), "title", "content")
    else:
        raw = spark.read.text(path).select(
            name.alias("source"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
            F.from_json("value", FIELDS).alias("d"),
        )
        docs = _numbered(raw).select("source", "idx", "d.title", "d.content")
    key = F.concat_ws("/", F.lit(corpus), F.col("source"), F.col("idx"))
    return docs.select(key.alias("doc_id"), F.lit(corpus).alias("corpus"), "*")


def _numbered(raw: DataFrame) -> DataFrame:
    """Line numbers per file: rows rise within a block, blocks rise within a file."""
    counted = running_sums(
        raw,
        ["source"],
        [("_block", "asc"), ("_row", "asc")],
        {"_line": F.lit(1)},
    )
    return counted.withColumn("idx", F.col("_line") - 1)

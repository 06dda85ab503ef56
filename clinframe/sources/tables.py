"""Writing results as partitioned parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> str:
    """Write ``df`` as parquet; splits, tasks and modes are partitions, not parts of file names.

    Rows go to their files as they are: repartitioning by the partition columns would put a
    large split into one task. With partitions only those written are replaced.
    """
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path

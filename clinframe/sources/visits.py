"""Reading visit tables and bringing them to a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clinframe.schema import VisitSchema, col


def read_visits(
    spark: SparkSession, path: str, fmt: str = "parquet", columns: StructType | None = None
) -> DataFrame:
    """A wide visit table from parquet, or from CSV with a header and a declared schema."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        if columns is None:
            raise ValueError("a CSV visit table needs its schema: inferring it reads the file twice")
        return spark.read.schema(columns).option("header", True).csv(path)
    raise ValueError(f"unknown format: {fmt}")


def select_schema(df: DataFrame, schema: VisitSchema) -> DataFrame:
    """Keep the columns of ``schema``; labs and targets as double, NaN as NULL.

    A missing record key is built from patient and admission.
    """
    if schema.key in df.columns:
        key = col(schema.key)
    else:
        key = F.concat_ws("_", col(schema.patient), col(schema.admission)).alias(schema.key)
    kept = [key, *([col(schema.patient)] if schema.patient else []), *map(col, schema.order)]
    numbers = [*schema.targets, *schema.static, *schema.numeric]

    def number(name: str):
        value = col(name).cast("double")
        return F.when(~F.isnan(value), value).alias(name)

    return df.select(*kept, *map(number, numbers), *map(col, schema.categorical))


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose id has no finished output yet."""
    return df.join(done.select(col(key)).distinct(), key, "left_anti")

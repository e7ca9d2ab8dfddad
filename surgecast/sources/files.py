"""Metric tables and fitted parameters in files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def metrics_schema(labels: Sequence[str], metrics: Sequence[str], ts: str = "timestamp") -> T.StructType:
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in labels]
        + [T.StructField(ts, T.TimestampType())]
        + [T.StructField(c, T.DoubleType()) for c in metrics]
    )


def read_metrics_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Scan a headed CSV of metrics with a stated schema, so no pass is spent on inference.

    The text NaN is a missing value, which is NULL here.
    """
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return rows.select(*[F.nanvl(f.name, F.lit(None)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in schema])


def write_metrics_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_metrics_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_model(model: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Keep fitted coefficients, one row per series, as a table."""
    model.write.mode(mode).parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

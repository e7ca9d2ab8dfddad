"""The metric catalogue as a small dimension table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, category string, unit string, critical boolean"

# Metric name, category, unit, needed for prediction.
DEFAULT_METRICS = [
    ("cpu_usage", "resource", "cores", True),
    ("memory_usage", "resource", "bytes", True),
    ("request_rate", "traffic", "req/s", True),
    ("request_rate_by_status", "traffic", "req/s", False),
    ("response_latency_p99", "performance", "seconds", True),
    ("response_latency_p50", "performance", "seconds", False),
    ("error_rate", "health", "errors/s", True),
    ("network_receive", "health", "bytes/s", False),
    ("ready_replicas", "state", "pods", True),
    ("desired_replicas", "state", "pods", False),
]


def metric_catalog(spark: SparkSession, metrics: Sequence[tuple] | None = None) -> DataFrame:
    """The catalogue; ``None`` gives the defaults, an empty list an empty catalogue."""
    return spark.createDataFrame(list(DEFAULT_METRICS if metrics is None else metrics), SCHEMA)


def register(catalog: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    """Add or replace definitions by name; the last one given wins."""
    spark = catalog.sparkSession
    new = spark.createDataFrame([(*r, i) for i, r in enumerate(rows, start=1)], SCHEMA + ", _n int")
    every = catalog.withColumn("_n", F.lit(0)).unionByName(new)
    fields = ["category", "unit", "critical"]
    return every.groupBy("name").agg(*[F.max_by(c, "_n").alias(c) for c in fields])


def tag(samples: DataFrame, catalog: DataFrame, *, critical_only: bool = False) -> DataFrame:
    """Attach category, unit and criticality to samples by metric name.

    The catalogue holds one row per metric name; Spark broadcasts it while it is small.
    """
    wanted = catalog.filter("critical") if critical_only else catalog
    return samples.join(wanted.withColumnRenamed("name", "metric"), "metric")

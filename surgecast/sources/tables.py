"""Readers that map the given tables onto the sample and metric-frame schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantile import bucket_counts, quantile_from_counts
from ..plans.blocks import floor_to, join_series, micros, running_sum, steps_between
from ..session import materialise

SERIES = ["namespace", "deployment"]

# Upper bounds of the latency buckets.
LATENCY_BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]

METRICS = [
    "cpu_usage",
    "memory_usage",
    "request_rate",
    "response_latency_p99",
    "response_latency_p50",
    "error_rate",
    "network_receive",
    "ready_replicas",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_events(events: DataFrame) -> DataFrame:
    """Map event rows (batch or stream) to labelled raw samples, one row per event.

    Ten users form a deployment and each user is a pod. Labels stay flat columns, because
    filters on map keys are not pushed into the scan.
    """
    team = F.floor(F.col("user_id") / 10).cast("long")
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(team % 2 == 0, "prod").otherwise("staging").alias("namespace"),
        F.concat(F.lit("app-"), team).alias("deployment"),
        F.concat(F.lit("app-"), team, F.lit("-pod-"), F.col("user_id")).alias("pod"),
        F.when(F.col("event_type") == "error", "503")
        .when(F.col("event_type") == "signup", "201")
        .otherwise("200")
        .alias("status_code"),
        "value",
        F.get_json_object("props", "$.k").alias("raw"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_events(read_table(spark, sf_dir, "events"))


def value_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cumulative counter per (pod, status) that restarts every day.

    One row per event: the running total of ``value`` since midnight.
    """
    rows = samples(spark, sf_dir).withColumn("day", F.to_date("ts"))
    totals = running_sum(
        rows,
        [*SERIES, "pod", "status_code", "day"],
        "ts",
        {"total": F.col("value")},
        order=["ts", "seq"],
        slot_s=6 * 3600,
    )
    return totals.select(*SERIES, "pod", "status_code", "ts", "seq", F.round("total", 2).alias("value"))


def bucket_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative histogram-bucket counters: running count of samples with value <= le.

    ``le`` is NULL for the overflow bucket.
    """
    rows = samples(spark, sf_dir)
    hits = [F.when(F.col("value") <= b, 1).otherwise(0) for b in LATENCY_BOUNDS] + [F.lit(1)]
    names = [f"_b{i}" for i in range(len(hits))]
    counted = running_sum(
        rows, SERIES, "ts", dict(zip(names, hits)), order=["ts", "seq"], slot_s=24 * 3600
    )
    entries = [
        F.struct(F.lit(b).cast("double").alias("le"), F.col(n).cast("double").alias("value"))
        for b, n in zip([*LATENCY_BOUNDS, None], names)
    ]
    return counted.select(*SERIES, "ts", "seq", F.explode(F.array(*entries)).alias("b")).select(
        *SERIES, "ts", "seq", "b.le", "b.value"
    )


def fill_grid(df: DataFrame, keys: list[str], ts: str, step_s: int) -> DataFrame:
    """Add a row of NULLs for every missing step between a series' first and last row."""
    spans = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    return join_series(steps_between(spans, keys, ts, step_s), df, [*keys, ts])


def bin_sums() -> list[Column]:
    """Aggregates of the raw samples in one bin, from which ``bin_metrics`` makes the metrics."""
    return [
        F.count(F.lit(1)).alias("_n"),
        F.sum("value").alias("_sum"),
        F.sum(F.when(F.col("status_code").startswith("5"), 1).otherwise(0)).alias("_err"),
        F.max(F.substring_index("pod", "-", -1).cast("int") % 10).alias("_top"),
        *bucket_counts(F.col("value"), LATENCY_BOUNDS),
    ]


def bin_samples(rows: DataFrame, step_s: int) -> DataFrame:
    """Reduce raw samples to one row of metrics per (series, step); partial sums run map-side."""
    start = F.timestamp_micros(floor_to(micros("ts"), step_s))
    return bin_metrics(rows.withColumn("ts", start).groupBy(*SERIES, "ts").agg(*bin_sums()), step_s)


def bin_metrics(binned: DataFrame, step_s: int) -> DataFrame:
    """The metrics of bins (series…, ts, sums)."""
    count, total = F.col("_n").cast("double"), F.col("_sum")
    return binned.select(
        *SERIES,
        "ts",
        (total / 10).alias("cpu_usage"),
        (total / count * 10).alias("memory_usage"),
        (count / step_s).alias("request_rate"),
        quantile_from_counts(0.99, LATENCY_BOUNDS).alias("response_latency_p99"),
        quantile_from_counts(0.50, LATENCY_BOUNDS).alias("response_latency_p50"),
        (F.col("_err") / step_s).alias("error_rate"),
        (total * 1000 / step_s).alias("network_receive"),
        (F.col("_top") + 1).cast("double").alias("ready_replicas"),
    )


def metrics_from_events(spark: SparkSession, sf_dir: str, step_s: int = 7200) -> DataFrame:
    """The wide metrics frame: one row per (series, step), NULL where a step has no sample.

    The bins, far smaller than the samples, are written once, so that the raw table is
    scanned once however often the frame is used.
    """
    bins = materialise(bin_samples(samples(spark, sf_dir), step_s), "metric-bins")
    return fill_grid(bins, SERIES, "ts", step_s)

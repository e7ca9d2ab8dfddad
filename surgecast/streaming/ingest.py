"""Streams of raw samples: binning, sliding rates, last-wins de-duplication, alert runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from ..sources.tables import label_events

LATENESS = "10 minutes"


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A given table as a file stream; new files of that name pattern arrive as new rows."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(sf_dir)


def stream_samples(spark: SparkSession, sf_dir: str, lateness: str = LATENESS, files_per_batch: int | None = None) -> DataFrame:
    """Labelled raw samples with a watermark; later rows than that are dropped."""
    return label_events(stream_table(spark, sf_dir, "events", files_per_batch)).withWatermark("ts", lateness)


def tumbling_bins(stream: DataFrame, keys: Sequence[str], aggs: Sequence[Column], step: str = "1 minute") -> DataFrame:
    """One row per series and closed bin. State lasts only until the watermark passes a bin."""
    binned = stream.groupBy(*keys, F.window("ts", step).alias("_w")).agg(*aggs)
    names = [c for c in binned.columns if c not in {*keys, "_w"}]
    return binned.select(*keys, F.col("_w.start").alias("ts"), *names)


def sliding_rate(
    stream: DataFrame, keys: Sequence[str], value: Column, *, window: str = "5 minutes", step: str = "1 minute", window_s: int = 300
) -> DataFrame:
    """Increase per second over a sliding window, stamped with the window end."""
    binned = stream.groupBy(*keys, F.window("ts", window, step).alias("_w")).agg(F.sum(value).alias("_s"))
    return binned.select(*keys, F.col("_w.end").alias("ts"), (F.col("_s") / window_s).alias("rate"))


def dedup_last(stream: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The last arrival per (series, timestamp), emitted once the watermark passes it."""
    rest = [c for c in stream.columns if c not in {*keys, "ts"}]
    kept = stream.groupBy(*keys, "ts").agg(F.max_by(F.struct(*rest), seq).alias("_kept"))
    return kept.select(*keys, "ts", "_kept.*")


def condition_runs(stream: DataFrame, keys: Sequence[str], condition: Column, *, step_s: int, for_s: int) -> DataFrame:
    """Runs of consecutive steps on which a condition held for at least ``for_s`` seconds."""
    gap = F.lit(f"{step_s + 1} seconds")
    runs = stream.filter(condition).groupBy(*keys, F.session_window("ts", gap).alias("_w")).agg(F.count(F.lit(1)).alias("steps"))
    lasted = (F.col("steps") - 1) * step_s
    return runs.filter(lasted >= for_s).select(*keys, F.col("_w.start").alias("active_since"), "steps")


def run_to_table(stream: DataFrame, purpose: str) -> DataFrame:
    """Run a stream over everything available into a parquet table and read the table back."""
    spark = stream.sparkSession
    out, mark = scratch_dir(spark, purpose), scratch_dir(spark, f"{purpose}-progress")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", mark)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)

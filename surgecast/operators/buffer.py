"""The metrics buffer as a table: append, last-wins de-duplication, retention, latest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.blocks import DAY, SLOT, floor_to, micros

RETENTION_HOURS = 168
LATEST_ROWS = 60


def append(buffer: DataFrame, rows: DataFrame) -> DataFrame:
    """Union by column name; a column only one side has is NULL on the other."""
    return buffer.unionByName(rows, allowMissingColumns=True)


def dedup_last(df: DataFrame, keys: Sequence[str], ts: str, seq: str) -> DataFrame:
    """One row per (series, timestamp): the last that arrived.

    An aggregate, so copies are reduced before the shuffle and a group of many copies
    never meets in one task.
    """
    rest = [c for c in df.columns if c not in {*keys, ts}]
    kept = df.groupBy(*keys, ts).agg(F.max_by(F.struct(*rest), seq).alias("_kept"))
    return kept.select(*keys, ts, "_kept.*").select(*df.columns)


def sort_by_time(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    return df.orderBy(*keys, ts)


def retain(df: DataFrame, ts: str, as_of: Column | str, hours: float = RETENTION_HOURS) -> DataFrame:
    """Rows not older than ``hours`` before ``as_of``: a plain filter the scan can use."""
    limit = F.lit(as_of).cast("timestamp") - F.make_interval(hours=F.lit(int(hours)))
    return df.filter(F.col(ts) >= limit)


def latest_time(df: DataFrame, ts: str):
    """The newest timestamp: one aggregate, one value back."""
    return df.agg(F.max(ts)).first()[0]


def latest_rows(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    n: int = LATEST_ROWS,
    *,
    order: Sequence[str] | None = None,
    slot_s: float = DAY,
) -> DataFrame:
    """The newest ``n`` rows of every series.

    Taken per (series, time slot) first, so one task sees a slot and then at most ``n``
    rows per slot of a series.
    """
    by = [F.col(c).desc() for c in (order or [ts])]
    rows = df.withColumn(SLOT, floor_to(micros(ts), slot_s))
    inside = Window.partitionBy(*keys, SLOT).orderBy(*by)
    rows = rows.withColumn("_rn", F.row_number().over(inside)).filter(F.col("_rn") <= n)
    whole = Window.partitionBy(*keys).orderBy(*by)
    rows = rows.withColumn("_rn", F.row_number().over(whole)).filter(F.col("_rn") <= n)
    return rows.select(*df.columns)


def latest_rows_overall(df: DataFrame, order: Sequence[str], n: int = LATEST_ROWS) -> DataFrame:
    """The newest ``n`` rows of the table (a top-n, no full sort)."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def status(df: DataFrame, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    """Row and column counts with the oldest and newest timestamp."""
    aggs = [
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("int").alias("columns"),
        F.min(ts).alias("oldest"),
        F.max(ts).alias("newest"),
    ]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)

"""Instant, range and backfill reads of long-form samples ``(labels…, metric, ts, value)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import DAY, carry, ceil_to, micros, steps_between


def label_equals(df: DataFrame, **labels: str) -> DataFrame:
    """Keep the samples whose labels equal the given values."""
    for name, value in labels.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def label_matches(label: str, pattern: str) -> Column:
    """An anchored label regex. A literal followed by ``.*`` becomes a prefix test, which
    the scan can use."""
    literal = pattern[:-2] if pattern.endswith(".*") else pattern
    if literal.replace("-", "").replace("_", "").isalnum():
        col = F.col(label)
        return col.startswith(literal) if pattern.endswith(".*") else col == F.lit(literal)
    return F.col(label).rlike(f"^(?:{pattern})$")


def label_starts_with(label: str, prefix: Column | str) -> Column:
    """``{prefix}.*`` for a prefix that may hold pattern characters or come from a column."""
    return F.col(label).startswith(prefix)


def time_range(df: DataFrame, ts: str, start, end) -> DataFrame:
    return df.filter(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def select_targets(samples: DataFrame, targets: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Samples of the (namespace, deployment) pairs listed in ``targets``.

    A semi join: Spark broadcasts the list when its size allows it.
    """
    return samples.join(targets.select(*labels).distinct(), list(labels), "left_semi")


def fetch_latest(
    samples: DataFrame, keys: Sequence[str], ts: str, value: str, *, order: Sequence[str] | None = None
) -> DataFrame:
    """The latest scalar of every series; NULL where it does not parse as a number."""
    newest = F.struct(*(order or [ts]))
    out = samples.groupBy(*keys).agg(F.max_by(value, newest).alias("_v"), F.max(ts).alias(ts))
    return out.select(*keys, ts, F.col("_v").try_cast("double").alias("value"))


def snapshot(
    samples: DataFrame, keys: Sequence[str], metrics: Sequence[str], at, *, order: Sequence[str]
) -> DataFrame:
    """One row per series with the latest value of every metric at time ``at``."""
    seen = samples.filter(F.col("ts") <= F.lit(at).cast("timestamp"))
    newest = F.struct(*order)
    return seen.groupBy(*keys).agg(
        *[
            F.max_by("value", F.when(F.col("metric") == m, newest)).try_cast("double").alias(m)
            for m in metrics
        ]
    )


def grid_points(
    samples: DataFrame, keys: Sequence[str], ts: str, step_s: int, start=None, end=None
) -> DataFrame:
    """One row per series and step, from ``start`` to ``end`` or over the series' own span.

    The own span starts at the first step at or after the first sample.
    """
    lo = F.lit(start).cast("timestamp") if start is not None else F.timestamp_micros(ceil_to(micros(F.min(ts)), step_s))
    hi = F.lit(end).cast("timestamp") if end is not None else F.max(ts)
    spans = samples.groupBy(*keys).agg(lo.alias("_lo"), hi.alias("_hi")).filter("_lo <= _hi")
    return steps_between(spans, keys, ts, step_s)


def as_of(
    points: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: Sequence[str],
    *,
    order: Sequence[str] = (),
    slot_s: float = DAY,
) -> DataFrame:
    """For every point, the last known value at or before it (the as-of join).

    Points and samples are put in one time line; there is no pairing of rows, so its cost
    does not depend on how many samples precede a point. ``order`` breaks ties among
    samples of one instant.
    """
    point_cols = [c for c in points.columns if c not in values]
    marked = points.select(
        *point_cols,
        F.lit(1).alias("_is_point"),
    )
    extra = [c for c in order if c not in {*keys, ts, *values}]
    data = samples.select(*keys, ts, *extra, *values, F.lit(0).alias("_is_point"))
    line = data.unionByName(marked, allowMissingColumns=True)
    names = {f"_asof_{v}": F.col(v) for v in values}
    known = carry(line, keys, ts, names, order=[ts, "_is_point", *extra], slot_s=slot_s)
    return known.filter("_is_point = 1").select(
        *point_cols, *[F.col(f"_asof_{v}").alias(v) for v in values]
    )


def range_fetch(
    samples: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    *,
    step_s: int = 60,
    start=None,
    end=None,
    order: Sequence[str] = (),
    slot_s: float = DAY,
) -> DataFrame:
    """Values of every series sampled at a fixed step, each the last one at or before it."""
    if end is not None:
        samples = samples.filter(F.col(ts) <= F.lit(end).cast("timestamp"))
    points = grid_points(samples, keys, ts, step_s, start, end)
    return as_of(points, samples, keys, ts, [value], order=order, slot_s=slot_s)


def long_to_wide(
    samples: DataFrame,
    ts: str,
    name: str,
    value: str,
    columns: Sequence[str],
    keys: Sequence[str] = (),
    pick: str = "max",
) -> DataFrame:
    """Turn long rows into one column per name; names are given, so the plan needs no scan."""
    agg = {"max": F.max, "sum": F.sum, "first": F.first}[pick]
    return samples.groupBy(*keys, ts).pivot(name, list(columns)).agg(agg(value))


def backfill(
    samples: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[str],
    *,
    as_of_time,
    hours: float,
    step_s: int,
    order: Sequence[str] = (),
    lookback_s: int = DAY,
) -> DataFrame:
    """The last ``hours`` of every metric on one grid, aligned on the timestamp.

    The grid starts at the first of those hours; values from up to ``lookback_s`` before it
    are carried in.

    One scan and one pivot take the place of an outer join per metric. Metrics without a
    sample have no column values; see ``cleaning.drop_sparse_columns`` to drop them.
    """
    end = F.lit(as_of_time).cast("timestamp")
    start = end - F.make_interval(hours=F.lit(int(hours)))
    known = start - F.make_interval(secs=F.lit(lookback_s).cast("decimal(18,6)"))
    recent = samples.filter((F.col("ts") >= known) & (F.col("ts") <= end))
    stepped = range_fetch(recent, [*keys, "metric"], "ts", "value", step_s=step_s, start=start, end=end, order=order)
    return long_to_wide(stepped.filter("value is not null"), "ts", "metric", "value", metrics, keys)


def source_health(samples: DataFrame, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    """Whether any sample exists, and the newest timestamp."""
    aggs = [(F.count(F.lit(1)) > 0).alias("healthy"), F.max(ts).alias("newest")]
    return samples.groupBy(*keys).agg(*aggs) if keys else samples.agg(*aggs)


def melt(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """A wide frame as long samples ``(keys…, ts, metric, value)``."""
    return df.unpivot([*keys, "ts"], list(metrics), "metric", "value")

"""Counter rates, gauge roll-ups and histogram quantiles on a time grid.

Definitions. The increase of a counter sample is its difference to the previous sample of
the series; after a reset (a smaller value) it is the value itself; the first sample has
none. The rate at ``t`` is the sum of increases in ``(t - window, t]`` divided by the window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantile import histogram_quantile
from ..plans.blocks import DAY, carry, micros, own_rows, sum_of, time_blocks, trailing

RATE_WINDOW_S = 300


def counter_increase(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    *,
    order: Sequence[str] | None = None,
    slot_s: float = DAY,
    name: str = "increase",
) -> DataFrame:
    prior = carry(df, keys, ts, {"_before": F.col(value)}, order=order, slot_s=slot_s, strict=True)
    before, now = F.col("_before"), F.col(value)
    inc = F.when(now < before, now).otherwise(now - before)
    return prior.select(*df.columns, inc.alias(name))


def counter_rate(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    *,
    window_s: int = RATE_WINDOW_S,
    order: Sequence[str] | None = None,
    slot_s: float = DAY,
    name: str = "rate",
) -> DataFrame:
    """The rate at every sample of its own series."""
    inc = counter_increase(df, keys, ts, value, order=order, slot_s=slot_s, name="_inc")
    blocks = time_blocks(inc, ts, width_s=max(slot_s, window_s), back_s=window_s)
    framed = trailing(blocks.withColumn("_us", micros(ts)), keys, "_us", window_s, {"_sum": (F.sum, F.col("_inc"))})
    rate = (sum_of("_sum_tail", "_sum_head") / window_s).alias(name)
    return own_rows(framed.select(*df.columns, "_block", "_own", rate))


def step_end(ts: str, step_s: int) -> Column:
    """The grid point a sample counts for: the first one at or after it."""
    us = micros(ts)
    step = F.lit(step_s * 1_000_000)
    return F.timestamp_micros(us + F.pmod(-us, step))


def rate_on_grid(
    increases: DataFrame,
    by: Sequence[str],
    ts: str,
    sums: dict[str, Column],
    *,
    window_s: int = RATE_WINDOW_S,
    step_s: int = 60,
) -> DataFrame:
    """Summed rates per group at every grid point with a sample in its window.

    Increases are summed per step first (map-side), then each step sum is added to the
    grid points whose window holds it, so hot groups shrink before any shuffle.
    """
    if window_s % step_s:
        raise ValueError("the window must be a multiple of the step")
    binned = (
        increases.withColumn(ts, step_end(ts, step_s))
        .groupBy(*by, ts)
        .agg(*[F.sum(expr).alias(n) for n, expr in sums.items()])
    )
    reach = window_s // step_s
    if reach > 1:
        shifts = F.sequence(
            F.col(ts),
            F.timestamp_micros(micros(ts) + F.lit((reach - 1) * step_s * 1_000_000)),
            F.make_interval(secs=F.lit(step_s).cast("decimal(18,6)")),
        )
        spread = binned.withColumn(ts, F.explode(shifts))
        binned = spread.groupBy(*by, ts).agg(*[F.sum(n).alias(n) for n in sums])
    return binned.select(*by, ts, *[(F.col(n) / window_s).alias(n) for n in sums])


def is_server_error(status: str) -> Column:
    return F.col(status).startswith("5") & (F.length(status) == 3)


def gauge_on_grid(
    df: DataFrame,
    series: Sequence[str],
    by: Sequence[str],
    ts: str,
    value: str,
    *,
    step_s: int = 60,
    order: Sequence[str] | None = None,
    name: str = "value",
) -> DataFrame:
    """The last value of each series in a step, summed over the series of a group."""
    last = (
        df.withColumn("_step", step_end(ts, step_s))
        .groupBy(*series, "_step")
        .agg(F.max_by(value, F.struct(*(order or [ts]))).alias("_v"))
    )
    return last.groupBy(*by, F.col("_step").alias(ts)).agg(F.sum("_v").alias(name))


def quantile_by_bucket(
    bucket_rates: DataFrame,
    by: Sequence[str],
    quantiles: dict[str, float],
    *,
    le: str = "le",
    value: str = "value",
) -> DataFrame:
    """Histogram quantiles of cumulative bucket rates, one row per group.

    The rates of a bucket are summed first, so a group collects one entry per bound.
    """
    summed = bucket_rates.groupBy(*by, le).agg(F.sum(value).alias("_cum"))
    entry = F.struct(
        F.coalesce(le, F.lit(float("inf"))).alias("at"), F.col(le).alias("le"), F.col("_cum").alias("cum")
    )
    groups = summed.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("_buckets"))
    plain = F.transform("_buckets", lambda b: F.struct(b["le"].alias("le"), b["cum"].alias("cum")))
    return groups.select(*by, *[histogram_quantile(q, plain).alias(n) for n, q in quantiles.items()])

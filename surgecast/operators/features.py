"""Rolling, difference, lag, exponential-average and calendar features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import calendar_features
from ..plans.blocks import (
    BLOCK,
    DAY,
    OWN,
    POS,
    SLOT,
    block_window,
    join_series,
    micros,
    own_rows,
    row_blocks,
    time_blocks,
    trailing,
    with_positions,
    with_slot,
)
from ..session import materialise

# Default metrics, window lengths, lags and averaging span.
PRIMARY_METRICS = ["cpu_usage", "memory_usage", "request_rate", "response_latency_p99", "error_rate"]
ROLLING_WINDOWS = [5, 15, 60]
LAGS = [15, 60]
EMA_SPAN = 30

BLOCK_ROWS = 4096
# exp(-745) is below the smallest positive double.
_UNDERFLOW = 745.0


def _rolling(w, col: str, sizes: Sequence[int], what: Sequence[str]) -> list[Column]:
    out = []
    for n in sizes:
        frame = w.rowsBetween(-(n - 1), 0)
        if "mean" in what:
            out.append(F.avg(col).over(frame).alias(f"{col}_rolling_mean_{n}m"))
        if "std" in what:
            spread = F.coalesce(F.stddev_samp(col).over(frame), F.lit(0.0))
            out.append(spread.alias(f"{col}_rolling_std_{n}m"))
    return out


def _difference(w, col: str) -> Column:
    return F.coalesce(F.col(col) - F.lag(col).over(w), F.lit(0.0)).alias(f"{col}_rate_of_change")


def _lags(w, col: str, steps: Sequence[int]) -> list[Column]:
    return [F.lag(col, n).over(w).alias(f"lag_{col}_{n}m") for n in steps]


def _ema_weights(alpha: float, size: int) -> tuple[Column, Column]:
    """Row weight (the first row of a series counts fully) and 1-based index in the block."""
    k = F.pmod(F.col(POS) - F.lit(1), F.lit(size)) + F.lit(1)
    return F.when(F.col(POS) == 1, 1.0).otherwise(alpha), k


def _ema_carry(placed: DataFrame, keys: list[str], cols: Sequence[str], alpha: float, size: int) -> DataFrame:
    """The average at the end of the previous block, one row per (series, block).

    A block's own contribution at its end is one weighted sum. Contributions of older
    blocks shrink by ``(1-alpha)**size`` each; the terms left out are zero in doubles.
    """
    decay = 1.0 - alpha
    weight, k = _ema_weights(alpha, size)
    ends = placed.groupBy(*keys, (F.col(POS) - k).alias(BLOCK)).agg(
        *[F.sum(F.col(c) * weight * F.pow(F.lit(decay), F.lit(size) - k)).alias(f"_end_{c}") for c in cols]
    )
    shrink = decay**size
    terms = 1 + math.ceil(_UNDERFLOW / (-size * math.log(decay)))
    past = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(-terms, -1)

    def carried(c: str) -> Column:
        fold = F.aggregate(F.collect_list(f"_end_{c}").over(past), F.lit(0.0), lambda acc, end: acc * shrink + end)
        return fold.alias(f"_carry_{c}")

    return ends.select(*keys, BLOCK, *[carried(c) for c in cols])


def _ema_columns(w, cols: Sequence[str], alpha: float, size: int, span: int) -> list[Column]:
    """Inside a block the average is a running sum of inversely weighted values, rescaled."""
    decay = 1.0 - alpha
    weight, k = _ema_weights(alpha, size)
    grown = F.when(F.col(OWN), weight * F.pow(F.lit(1.0 / decay), k))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    shrink = F.pow(F.lit(decay), k)
    return [
        (shrink * (F.sum(F.col(c) * grown).over(upto) + F.col(f"_carry_{c}"))).alias(f"{c}_ema_{span}")
        for c in cols
    ]


def row_features(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    cols: Sequence[str],
    *,
    order: Sequence[str] | None = None,
    rolling: Sequence[int] = (),
    rolling_stats: Sequence[str] = ("mean", "std"),
    difference: bool = False,
    lags: Sequence[int] = (),
    ema_span: int | None = None,
    slot_s: float = DAY,
    block_rows: int = BLOCK_ROWS,
    parts: int | None = None,
) -> DataFrame:
    """Any mix of row-count features, evaluated over one shared sort per (series, block).

    ``cols`` must be free of NULLs where an exponential average is asked for. ``parts`` (see
    ``plans.blocks.parts_for``) deals the rows to so many tasks, so that none sorts more as
    the input grows.
    """
    keys = list(keys)
    base = list(df.columns)
    dealt = with_slot(df, ts, slot_s).repartition(parts, *keys, SLOT) if parts else df
    placed = with_positions(dealt, keys, ts, order=order, slot_s=slot_s)
    back = max([n - 1 for n in rolling] + list(lags) + [1 if difference else 0, 0])
    if ema_span:
        # Read twice below: for the block totals and for the rows.
        placed = materialise(placed, "numbered-rows")
    blocks = row_blocks(placed, size=block_rows, back=back)
    if parts:
        blocks = blocks.repartition(parts, *keys, BLOCK)
    if ema_span:
        alpha = 2.0 / (ema_span + 1.0)
        if -block_rows * math.log(1.0 - alpha) > 600:
            raise ValueError("block_rows is too long for this span: weights would overflow")
        blocks = blocks.join(_ema_carry(placed, keys, cols, alpha, block_rows), [*keys, BLOCK], "left")
        # The carry is known for every home block; a halo-only block has none and no own rows.
    w = block_window(keys, [POS])
    made: list[Column] = []
    for c in cols:
        made += _rolling(w, c, rolling, rolling_stats)
    made += [_difference(w, c) for c in cols] if difference else []
    for c in cols:
        made += _lags(w, c, lags)
    made += _ema_columns(w, cols, alpha, block_rows, ema_span) if ema_span else []
    return own_rows(blocks.select(*base, BLOCK, OWN, *made))


def rolling_time(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    cols: Sequence[str],
    minutes: Sequence[int] = ROLLING_WINDOWS,
    *,
    block_s: float = DAY,
) -> DataFrame:
    """Rolling mean and sample deviation over true time, for irregular rows.

    The frame of a row at ``t`` holds the rows in ``(t - minutes, t]``.
    """
    keys, base = list(keys), list(df.columns)
    blocks = time_blocks(df, ts, width_s=max(block_s, 60 * max(minutes)), back_s=60 * max(minutes))
    blocks = blocks.withColumn("_us", micros(ts))
    made = []
    for m in minutes:
        names = {c: f"_{m}_{i}" for i, c in enumerate(cols)}
        parts = {}
        for c, n in names.items():
            parts |= {f"{n}n": (F.count, F.col(c)), f"{n}a": (F.avg, F.col(c)), f"{n}v": (F.var_pop, F.col(c))}
        blocks = trailing(blocks, keys, "_us", 60 * m, parts)
        for c, n in names.items():
            made += [(c, m, *_merged_moments(n))]
    out = [
        column
        for c in cols
        for name, m, mean, std in made
        if name == c
        for column in (mean.alias(f"{c}_mean_last_{m}min"), F.coalesce(std, F.lit(0.0)).alias(f"{c}_std_last_{m}min"))
    ]
    return own_rows(blocks.select(*base, BLOCK, OWN, *out))


def _merged_moments(n: str) -> tuple[Column, Column]:
    """Mean and sample deviation of a frame from count, mean and variance of its two parts."""
    n1, n2 = (F.coalesce(f"{n}n_{part}", F.lit(0)) for part in ("tail", "head"))
    a1, a2 = (F.col(f"{n}a_{part}") for part in ("tail", "head"))
    v1, v2 = (F.col(f"{n}v_{part}") for part in ("tail", "head"))
    both, rows = (n1 > 0) & (n2 > 0), n1 + n2
    mean = F.when(both, a1 + (a2 - a1) * n2 / rows).otherwise(F.coalesce(a1, a2))
    within = F.coalesce(v1 * n1, F.lit(0.0)) + F.coalesce(v2 * n2, F.lit(0.0))
    between = F.when(both, (a2 - a1) * (a2 - a1) * n1 * n2 / rows).otherwise(0.0)
    return mean, F.when(rows > 1, F.sqrt((within + between) / (rows - 1)))


def add_calendar(df: DataFrame, ts: str) -> DataFrame:
    return df.select("*", *calendar_features(ts))


def engineer(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    primary: Sequence[str] = PRIMARY_METRICS,
    *,
    slot_s: float = 30 * DAY,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All features of every primary metric present, then rows with any NULL dropped.

    A column without any value in a series is not asked for there: its features stay NULL
    and the other features of that series survive.
    """
    present = [c for c in primary if c in df.columns]
    featured = row_features(
        df,
        keys,
        ts,
        present,
        rolling=ROLLING_WINDOWS,
        difference=True,
        lags=LAGS,
        ema_span=EMA_SPAN,
        slot_s=slot_s,
        block_rows=block_rows,
    )
    made = [c for c in featured.columns if c not in df.columns]
    base = [c for c in df.columns if c not in {*keys, ts}]
    # A feature belongs to the longest column name that it holds.
    source = {m: max([c for c in base if c in m], key=len) for m in made} | {c: c for c in base}
    has = df.groupBy(*keys).agg(*[(F.count(c) > 0).alias(f"_has_{c}") for c in base])
    rows = join_series(add_calendar(featured, ts), has, keys)
    floating = {f.name for f in featured.schema if f.dataType.typeName() in ("double", "float")}
    complete = F.lit(True)
    for name, c in source.items():
        known = F.col(name).isNotNull() & ~F.isnan(name) if name in floating else F.col(name).isNotNull()
        complete = complete & (known | ~F.col(f"_has_{c}"))
    out = rows.filter(complete)
    return out.select(*[F.when(F.col(f"_has_{source[c]}"), F.col(c)).alias(c) if c in made else F.col(c) for c in out.columns if not c.startswith("_has_")])

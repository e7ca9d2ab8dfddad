"""Sliding training windows, inference windows and the chronological split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import BLOCK, DAY, OWN, POS, block_window, own_rows, row_blocks, with_positions
from .buffer import latest_rows


def training_windows(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    features: Sequence[str],
    target: str,
    *,
    lookback: int = 60,
    horizon: int = 10,
    slot_s: float = 30 * DAY,
    block_rows: int = 4096,
) -> DataFrame:
    """One sample per full window: ``x`` holds ``lookback`` rows of features up to ``ts``,
    ``y`` the next ``horizon`` target values. A series of N rows gives N-lookback-horizon+1.
    """
    keys = list(keys)
    target = target if target in df.columns else features[0]
    placed = with_positions(df, keys, ts, slot_s=slot_s)
    blocks = row_blocks(placed, size=block_rows, back=lookback - 1, ahead=horizon)
    w = block_window(keys, [POS])
    vector = F.array(*[F.col(c).cast("float") for c in features])
    rows = blocks.select(
        *keys,
        ts,
        POS,
        BLOCK,
        OWN,
        F.collect_list(vector).over(w.rowsBetween(-(lookback - 1), 0)).alias("x"),
        F.collect_list(F.col(target).cast("float")).over(w.rowsBetween(1, horizon)).alias("y"),
    )
    full = own_rows(rows).filter((F.size("x") == lookback) & (F.size("y") == horizon))
    return full.select(*keys, (F.col(POS) - lookback).alias("sample_id"), ts, "x", "y")


def inference_window(
    df: DataFrame, keys: Sequence[str], ts: str, features: Sequence[str], *, lookback: int = 60
) -> DataFrame:
    """The newest ``lookback`` rows of each series as one array, padded with zeros on the left."""
    vector = F.array(*[F.col(c).cast("float") for c in features])
    recent = latest_rows(df, keys, ts, lookback)
    groups = recent.groupBy(*keys).agg(
        F.max(ts).alias(ts), F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), vector.alias("v")))).alias("_rows")
    )
    padding = F.array_repeat(F.array(*[F.lit(0.0).cast("float")] * len(features)), F.lit(lookback) - F.size("_rows"))
    return groups.select(*keys, ts, F.concat(padding, F.transform("_rows", lambda r: r["v"])).alias("x"))


def chronological_split(
    df: DataFrame, keys: Sequence[str], ts: str, *, share: float = 0.8, slot_s: float = 30 * DAY
) -> DataFrame:
    """Flag the first ``int(share * n)`` rows of each series, in time order, as training rows."""
    rows = with_positions(df, keys, ts, slot_s=slot_s, pos="_p", total="_n")
    return rows.select(*df.columns, (F.col("_p") <= F.floor(F.col("_n") * share)).alias("is_train"))

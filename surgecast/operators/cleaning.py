"""Gap interpolation, outlier clipping, filling and quality reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.blocks import DAY, SLOT, checked, group_starts, join_series, micros, neighbours, whole_groups, with_slot
from ..session import materialise, release

# Clip width in deviations and the share of known values a column needs.
OUTLIER_STD = 4.0
MIN_VALID_RATIO = 0.5


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of the numeric columns, from the schema alone."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)
    ]


def validate_index(df: DataFrame, ts: str) -> DataFrame:
    """Give the time column type TIMESTAMP; order is stated by each window, not stored."""
    if isinstance(df.schema[ts].dataType, T.TimestampType):
        return df
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def valid_columns(df: DataFrame, cols: Sequence[str], min_ratio: float = MIN_VALID_RATIO) -> list[str]:
    """Columns whose share of known values reaches ``min_ratio``: one pass, one row back.

    An empty frame keeps all its columns.
    """
    if not cols:
        return []
    row = df.agg(*[F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is None or row[c] >= min_ratio]


def drop_sparse_columns(df: DataFrame, cols: Sequence[str], min_ratio: float = MIN_VALID_RATIO) -> DataFrame:
    keep = set(valid_columns(df, cols, min_ratio))
    return df.select(*[c for c in df.columns if c not in cols or c in keep])


def mask_sparse(df: DataFrame, keys: Sequence[str], cols: Sequence[str], min_ratio: float = MIN_VALID_RATIO) -> tuple[DataFrame, list[str]]:
    """Decide each column in each series: where too little is known it becomes NULL throughout.

    Also returns the columns that some series keeps; the others leave the frame. One
    aggregate gives a row per series; an empty frame keeps all its columns.
    """
    if not cols:
        return df, []
    share = df.groupBy(*keys).agg(*[(F.avg(F.col(c).isNotNull().cast("int")) >= min_ratio).alias(f"_ok_{c}") for c in cols])
    share = materialise(share, "known-share")
    row = share.agg(*[F.max(f"_ok_{c}").alias(c) for c in cols]).first()
    kept = [c for c in cols if row[c] is None or row[c]]
    masked = join_series(df, share, keys)
    value = {c: F.when(F.col(f"_ok_{c}"), F.col(c)) for c in kept}
    return masked.select(*[value[c].alias(c) if c in value else F.col(c) for c in df.columns if c not in cols or c in kept]), kept


def drop_null_rows(df: DataFrame) -> DataFrame:
    return df.dropna()


def _slot_ends(names: Sequence[str], count: int):
    """Time and value of the last and the first known entry of each column, for each stretch of rows of one slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = group_starts(batch, names)
            us = batch.column("_us")
            # Rows need not be in order: the extreme times of a stretch are found by sorting it.
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            by = np.lexsort((us.fill_null(0).to_numpy(zero_copy_only=False), group))
            made = {c: batch.column(c).take(pa.array(starts)) for c in names}
            for i in range(count):
                value = batch.column(f"_v{i}")
                known = value.is_valid().to_numpy(zero_copy_only=False)[by]
                at = np.arange(n)
                for side, ends in (("p", np.maximum.reduceat(np.where(known, at, -1), starts)), ("n", np.minimum.reduceat(np.where(known, at, n), starts))):
                    none = (ends < 0) | (ends >= n)
                    rows = pa.array(by[np.where(none, 0, ends)], mask=none)
                    made |= {f"{side}t{i}": us.take(rows), f"{side}v{i}": value.take(rows)}
            yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return run


def _slot_filled(names: Sequence[str], base: Sequence[str], cols: Sequence[str], most: int | None):
    """Rows with their unknown entries filled; a slot's first row brings what is known before and after the slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, names):
            table = table.combine_chunks()
            n, k = table.num_rows, len(cols)
            stops = np.append(starts[1:], n)
            group = np.repeat(np.arange(len(starts)), stops - starts)
            whole = lambda c: table.column(c).combine_chunks()
            us = whole("_us").fill_null(0).to_numpy(zero_copy_only=False)
            head = np.zeros(n, bool)
            head[starts] = True
            times, values = (whole(c).take(pa.array(starts)).flatten() for c in ("_far_t", "_far_v"))
            far = times.is_valid().to_numpy(zero_copy_only=False).reshape(-1, 2, k)
            far_t = times.fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, 2, k)
            far_v = values.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, 2, k)
            at, rows, filled = np.arange(n), pa.array(np.flatnonzero(~head)), {}
            for i, c in enumerate(cols):
                column = whole(f"_v{i}")
                known = column.is_valid().to_numpy(zero_copy_only=False)
                v = column.fill_null(0.0).to_numpy(zero_copy_only=False).copy()
                unknown = np.flatnonzero(~known & ~head)
                g, t = group[unknown], us[unknown]
                prev = np.maximum.accumulate(np.where(known, at, -1))[unknown]
                nxt = np.minimum.accumulate(np.where(known, at, n)[::-1])[::-1][unknown]
                near0, near1 = prev >= starts[g], nxt < stops[g]
                prev, nxt = np.where(near0, prev, 0), np.where(near1, nxt, 0)
                has0, has1 = near0 | far[g, 0, i], near1 | far[g, 1, i]
                t0, v0 = np.where(near0, us[prev], far_t[g, 0, i]), np.where(near0, v[prev], far_v[g, 0, i])
                t1, v1 = np.where(near1, us[nxt], far_t[g, 1, i]), np.where(near1, v[nxt], far_v[g, 1, i])
                both = has0 & has1
                if (both & (t1 == t0)).any():
                    raise ZeroDivisionError("known values at one instant around an unknown one")
                inside = v0 + (v1 - v0) * (t - t0) / np.where(both, t1 - t0, 1)
                told = has0 | has1
                if most is not None:
                    told &= np.where(has1, t1, t) - np.where(has0, t0, t) <= most
                v[unknown] = np.where(both, inside, np.where(has0, v0, v1))
                known[unknown] = told
                filled[c] = pa.array(v, mask=~known)
            out = pa.Table.from_arrays([filled[c] if c in filled else table.column(c) for c in base], names=list(base)).take(rows)
            yield from out.combine_chunks().to_batches()

    return run


def interpolate(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    cols: Sequence[str],
    *,
    max_gap_s: float | None = None,
    slot_s: float = 7 * DAY,
) -> DataFrame:
    """Time-weighted linear interpolation; the edges take the nearest known value.

    With ``max_gap_s`` a hole is filled only if the known values around it (or, at an edge,
    the known value next to it) are at most that far apart. Results are DOUBLE.

    A task fills the slots that it holds, sorted, in Arrow batches of many slots. What is known
    before and after a slot comes as one row in front of it, carried over the slots of its series.
    """
    keys, cols, base = list(keys), list(dict.fromkeys(cols)), df.columns
    if not cols:
        return df
    names, each = [*keys, SLOT], range(len(cols))
    rows = with_slot(checked(df, keys), ts, slot_s).withColumn("_us", micros(ts))
    rows = rows.select("*", *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])

    found = T.StructType([*[rows.schema[c] for c in names], *[T.StructField(f"{side}{part}{i}", kind) for i in each for side in "pn" for part, kind in (("t", T.LongType()), ("v", T.DoubleType()))]])
    ends = rows.select(*names, "_us", *[f"_v{i}" for i in each]).mapInArrow(_slot_ends(names, len(cols)), found)
    picks = [pick(f"{side}{part}{i}", f"{side}t{i}").alias(f"{side}{part}{i}") for i in each for side, pick in (("p", F.max_by), ("n", F.min_by)) for part in "tv"]
    slots = Window.partitionBy(*keys)
    across = {
        "p": slots.orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1),
        "n": slots.orderBy(F.col(SLOT).desc()).rowsBetween(Window.unboundedPreceding, -1),
    }
    far = [F.array(*[F.last(f"{side}{part}{i}", ignorenulls=True).over(across[side]) for side in "pn" for i in each]).alias(f"_far_{part}") for part in "tv"]
    heads = ends.groupBy(*names).agg(*picks).select(*names, *far)

    both = rows.drop(*[c for c in cols if c not in names]).unionByName(heads, allowMissingColumns=True)
    dealt = both.repartition(*names).sortWithinPartitions(*names, F.col("_far_t").isNull(), "_us")
    out = T.StructType([T.StructField(c, T.DoubleType()) if c in cols else df.schema[c] for c in base])
    return dealt.mapInArrow(_slot_filled(names, base, cols, None if max_gap_s is None else int(max_gap_s * 1_000_000)), out)


def clip_limits(df: DataFrame, keys: Sequence[str], cols: Sequence[str], width: float = OUTLIER_STD) -> DataFrame:
    """Per series and column: mean ± ``width`` sample deviations, NULL where that is zero."""
    stats = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"_s_{c}") for c in cols]
    )

    def limits(c: str) -> Column:
        mean, spread = F.col(f"_m_{c}"), F.col(f"_s_{c}")
        pair = F.struct((mean - width * spread).alias("lo"), (mean + width * spread).alias("hi"))
        return F.when(spread > 0, pair).alias(f"_limit_{c}")

    return stats.select(*keys, *[limits(c) for c in cols])


def _clipped(c: str) -> Column:
    limit, value = F.col(f"_limit_{c}"), F.col(c)
    return (
        F.when(value < limit["lo"], limit["lo"]).when(value > limit["hi"], limit["hi"]).otherwise(value)
    )


def clip_outliers(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], width: float = OUTLIER_STD
) -> DataFrame:
    """Clip each column to its limits; statistics include the outliers, NULLs stay NULL."""
    return clip_to(df, clip_limits(df, keys, cols, width), keys, cols)


def clip_to(df: DataFrame, limits: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Clip to given ``limits`` (see ``clip_limits``); a series or column without one stays as it is."""
    limited = join_series(df, limits, keys)
    return limited.select(*[_clipped(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def limit_rows(limits: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``limits`` as rows ``(series…, column, lo, hi)``, the form that is stored with a model."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"_limit_{c}.lo").alias("lo"), F.col(f"_limit_{c}.hi").alias("hi")) for c in cols]
    return limits.select(*keys, F.explode(F.array(*pairs)).alias("_l")).select(*keys, "_l.*").filter("lo IS NOT NULL")


def limits_of(rows: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The way back from ``limit_rows``."""
    pair = F.struct("lo", "hi")
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == c, pair)).alias(f"_limit_{c}") for c in cols])


def clip_counts(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], width: float = OUTLIER_STD
) -> DataFrame:
    """How many values per series and column the clipping would change."""
    limited = join_series(df, clip_limits(df, keys, cols, width), keys)
    counts = limited.groupBy(*keys).agg(
        *[F.sum(F.when(F.col(c) != _clipped(c), 1).otherwise(0)).alias(c) for c in cols]
    )
    return counts.unpivot(list(keys), list(cols), "column", "clipped")


def fill_remaining(
    df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], *, slot_s: float = 7 * DAY
) -> DataFrame:
    """Forward fill, then backward fill.

    A column without any known value in its series stays NULL; its median is NULL too.
    """
    base = df.columns
    rows = neighbours(df, keys, ts, {f"_{c}": F.col(c) for c in cols}, slot_s=slot_s)
    return rows.select(
        *[F.coalesce(f"_{c}_prev", f"_{c}_next").alias(c) if c in cols else F.col(c) for c in base]
    )


def clean(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    cols: Sequence[str] | None = None,
    *,
    min_ratio: float = MIN_VALID_RATIO,
    width: float = OUTLIER_STD,
    max_gap_s: float | None = None,
    slot_s: float = 7 * DAY,
) -> DataFrame:
    """Validate, drop sparse columns, interpolate, clip and fill.

    Whether a column is too sparse is decided in each series (see ``mask_sparse``).

    Interpolation without a gap limit leaves NULLs only where a series has no value at
    all, so the fill step has work only with a limit.
    """
    df, kept = without_gaps(df, keys, ts, cols, min_ratio=min_ratio, max_gap_s=max_gap_s, slot_s=slot_s)
    if not kept:
        return df
    df = clip_outliers(df, keys, kept, width)
    return df if max_gap_s is None else fill_remaining(df, keys, ts, kept, slot_s=slot_s)


def without_gaps(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    cols: Sequence[str] | None = None,
    *,
    min_ratio: float = MIN_VALID_RATIO,
    max_gap_s: float | None = None,
    slot_s: float = 7 * DAY,
) -> tuple[DataFrame, list[str]]:
    """The steps of ``clean`` before clipping, and the columns that it keeps.

    The rows are written to the shared scratch folder before and after: the shares of known
    values, the ends of the slots and the rows are three readings of the frame, which may be a
    grid that is costly to fill, and clipping reads twice, for the limits and for the values.
    What was written before goes once the filled rows are there.
    """
    df = validate_index(df, ts)
    cols = list(cols or numeric_columns(df, [*keys, ts]))
    if not cols:
        return df, []
    df = written = materialise(df, "frame")
    df, kept = mask_sparse(df, keys, cols, min_ratio)
    if kept:
        df = materialise(interpolate(df, keys, ts, kept, max_gap_s=max_gap_s, slot_s=slot_s), "interpolated")
        release(written)
    return df, kept


def quality_report(
    df: DataFrame, keys: Sequence[str] = (), *, exclude: Sequence[str] = (), round_values: bool = True
) -> DataFrame:
    """One row per column: known and missing values, share missing, mean, deviation, range.

    Statistics of non-numeric columns are NULL. Rounding is half-even, to two places for the
    percentage and four for the statistics.
    """
    tidy = F.bround if round_values else lambda c, _: c
    keys = list(keys)
    cols = [c for c in df.columns if c not in {*keys, *exclude}]
    numeric = set(numeric_columns(df))
    aggs = []
    for c in cols:
        known = F.count(c)
        value = F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
        missing = F.count(F.lit(1)) - known
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                known.alias("count"),
                missing.alias("nulls"),
                tidy(missing / F.count(F.lit(1)) * 100, 2).alias("null_pct"),
                tidy(F.avg(value), 4).alias("mean"),
                tidy(F.stddev_samp(value), 4).alias("std"),
                tidy(F.min(value), 4).alias("min"),
                tidy(F.max(value), 4).alias("max"),
            ).alias(f"_r_{c}")
        )
    wide = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    return wide.select(*keys, F.explode(F.array(*[f"_r_{c}" for c in cols])).alias("r")).select(*keys, "r.*")

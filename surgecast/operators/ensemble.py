"""Blend two forecasts, attach a band and a confidence, adapt weights, recommend replicas.

Forecast rows: ``(series…, cycle, h, seq_pred, seasonal_pred, lower, upper[, actual])``, one
per series, forecast cycle and horizon step. A cycle has ``horizon`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.blocks import DAY, carry, with_slot
from .features import row_features

# Starting weights, error history length, band width and thresholds.
SEQ_WEIGHT, SEASONAL_WEIGHT = 0.6, 0.4
ERROR_WINDOW = 30
BAND_Z, SINGLE_STEP_MARGIN = 1.96, 0.1
EPS = 1e-8
URGENCY_HIGH, URGENCY_MEDIUM = 0.5, 0.2
TARGET_UTILIZATION, MIN_REPLICAS, MAX_REPLICAS = 0.7, 2, 50


def pair_forecasts(seq: DataFrame, seasonal: DataFrame, on: Sequence[str]) -> DataFrame:
    """Align the two models' forecasts; a step only one model covers is kept."""
    return seq.join(seasonal, list(on), "full_outer")


def blend(df: DataFrame, weights: DataFrame | None = None, on: Sequence[str] = ()) -> DataFrame:
    """Add ``blended``: the weighted sum, or the only forecast there is.

    ``weights(on…, seq_weight, seasonal_weight)``, one row for each value of ``on``,
    overrides the starting weights; see ``latest_weights``. A row without any forecast is
    an error.
    """
    if weights is not None:
        df = df.join(weights.select(*on, "seq_weight", "seasonal_weight"), list(on), "left")
        ws = F.coalesce("seq_weight", F.lit(SEQ_WEIGHT))
        wp = F.coalesce("seasonal_weight", F.lit(SEASONAL_WEIGHT))
    else:
        ws, wp = F.lit(SEQ_WEIGHT), F.lit(SEASONAL_WEIGHT)
    a, b = F.col("seq_pred"), F.col("seasonal_pred")
    value = (
        F.when(a.isNotNull() & b.isNotNull(), ws * a + wp * b)
        .when(a.isNotNull() | b.isNotNull(), F.coalesce(a, b))
        .otherwise(F.raise_error(F.lit("a step without any forecast cannot be blended")).cast("double"))
    )
    return df.withColumns({"seq_weight": ws, "seasonal_weight": wp, "blended": value})


def band(df: DataFrame, cycle: Sequence[str]) -> DataFrame:
    """Replace ``lower``/``upper``: the seasonal band where given, else ± a margin from the
    spread of the cycle's blended values."""
    w = Window.partitionBy(*cycle)
    margin = F.when(F.count("blended").over(w) > 1, F.stddev_pop("blended").over(w) * BAND_Z).otherwise(SINGLE_STEP_MARGIN)
    given = F.col("lower").isNotNull() & F.col("upper").isNotNull()
    return df.withColumn("_margin", margin).withColumns(
        {
            "lower": F.when(given, F.col("lower")).otherwise(F.col("blended") - F.col("_margin")),
            "upper": F.when(given, F.col("upper")).otherwise(F.col("blended") + F.col("_margin")),
        }
    ).drop("_margin")


def confidence() -> Column:
    """Aggregate: exp(-mean band width / mean absolute forecast), within [0, 1]."""
    width = F.avg(F.col("upper") - F.col("lower"))
    level = F.avg(F.abs(F.col("blended"))) + EPS
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(-width / level)))


def unknown(value: Column) -> Column:
    """NULL or NaN."""
    return value.isNull() | F.isnan(value.cast("double"))


def replicas_for(peak: Column, utilization=TARGET_UTILIZATION, lo=MIN_REPLICAS, hi=MAX_REPLICAS, idle: Column | None = None) -> Column:
    """Replicas that keep the peak at the target utilisation, within bounds.

    NULL for an unknown peak (NULL or NaN): ``least`` and ``greatest`` skip NULLs, so the
    bounds alone would make the maximum of it.
    """
    util = utilization if isinstance(utilization, Column) else F.lit(float(utilization))
    need = F.when(util > 0, F.ceil(F.try_divide(peak, util))).otherwise(idle if idle is not None else F.lit(1))
    bound = lambda v: v if isinstance(v, Column) else F.lit(v)
    known = ~unknown(peak) & need.isNotNull()
    return F.when(known, F.greatest(bound(lo), F.least(bound(hi), need))).cast("int")


def urgency(first: Column, last: Column, n: Column) -> Column:
    change = F.abs(last - first) / (F.abs(first) + EPS)
    return (
        F.when(n < 2, "low").when(change > URGENCY_HIGH, "high").when(change > URGENCY_MEDIUM, "medium").otherwise("low")
    )


def combine(df: DataFrame, cycle: Sequence[str], weights: DataFrame | None = None, on: Sequence[str] = ()) -> DataFrame:
    """One prediction result per cycle, values as 32-bit floats ordered by step."""
    rows = band(blend(df, weights, on), cycle)
    as_float = F.col("blended").cast("float")
    parts = F.struct(
        "h",
        as_float.alias("value"),
        F.col("lower").cast("float").alias("lower"),
        F.col("upper").cast("float").alias("upper"),
    )
    # A cycle holds one row per horizon step, so the list is bounded by the horizon.
    grouped = rows.groupBy(*cycle).agg(
        F.sort_array(F.collect_list(parts)).alias("_steps"),
        confidence().alias("confidence"),
        F.max("seq_weight").alias("seq_weight"),
        F.max("seasonal_weight").alias("seasonal_weight"),
    )
    pick = lambda n: F.transform("_steps", lambda s: s[n])
    values = F.col("predicted_values")
    peak = F.array_max(values).cast("double")
    first, last = (F.element_at(values, i).cast("double") for i in (1, -1))
    return (
        grouped.select(
            *cycle,
            pick("value").alias("predicted_values"),
            pick("lower").alias("band_lower"),
            pick("upper").alias("band_upper"),
            "confidence",
            "seq_weight",
            "seasonal_weight",
        )
        .withColumn("predicted_peak", peak)
        .withColumn("recommended_replicas", replicas_for(F.col("predicted_peak")))
        .withColumn("urgency", urgency(first, last, F.size(values)))
    )


def cycle_errors(df: DataFrame, cycle: Sequence[str]) -> DataFrame:
    """Mean absolute error of either model per cycle, from forecasts joined to actuals."""
    return df.groupBy(*cycle).agg(
        F.avg(F.abs(F.col("actual") - F.col("seq_pred"))).alias("seq_mae"),
        F.avg(F.abs(F.col("actual") - F.col("seasonal_pred"))).alias("seasonal_mae"),
    )


def adaptive_weights(
    errors: DataFrame, keys: Sequence[str], cycle_ts: str, *, window: int = ERROR_WINDOW, slot_s: float = 30 * DAY
) -> DataFrame:
    """Weights after each cycle, inverse to the mean of each model's last ``window`` errors.

    A model without an error in a cycle keeps its history; weights start once both models
    have one.
    """
    keys = list(keys)
    long = errors.unpivot([*keys, cycle_ts], ["seq_mae", "seasonal_mae"], "model", "mae").filter("mae is not null")
    rolled = row_features(long, [*keys, "model"], cycle_ts, ["mae"], rolling=[window], rolling_stats=["mean"], slot_s=slot_s)
    wide = rolled.groupBy(*keys, cycle_ts).pivot("model", ["seq_mae", "seasonal_mae"]).agg(F.max(f"mae_rolling_mean_{window}m"))
    wide = with_slot(wide, cycle_ts, slot_s)
    known = carry(
        wide, keys, cycle_ts, {"avg_seq_mae": F.col("seq_mae"), "avg_seasonal_mae": F.col("seasonal_mae")}, slot_s=slot_s
    )
    inv_a, inv_b = (1.0 / (F.col(c) + EPS) for c in ("avg_seq_mae", "avg_seasonal_mae"))
    both = F.col("avg_seq_mae").isNotNull() & F.col("avg_seasonal_mae").isNotNull()
    return known.select(
        *keys,
        cycle_ts,
        "avg_seq_mae",
        "avg_seasonal_mae",
        F.when(both, inv_a / (inv_a + inv_b)).otherwise(SEQ_WEIGHT).alias("seq_weight"),
        F.when(both, inv_b / (inv_a + inv_b)).otherwise(SEASONAL_WEIGHT).alias("seasonal_weight"),
    )


def latest_weights(weights: DataFrame, keys: Sequence[str], cycle_ts: str, before=None) -> DataFrame:
    """The weights of each series after its last cycle (before a time, if given): one row per series.

    What ``combine`` and ``blend`` take with ``on=keys``.
    """
    if before is not None:
        weights = weights.filter(F.col(cycle_ts) < F.lit(before).cast("timestamp"))
    return weights.groupBy(*keys).agg(*[F.max_by(c, cycle_ts).alias(c) for c in ("seq_weight", "seasonal_weight")])


def combiner_stats(errors: DataFrame, weights: DataFrame, keys: Sequence[str], cycle_ts: str, window: int = ERROR_WINDOW) -> DataFrame:
    """Current weights, mean errors and history lengths per series."""
    sizes = errors.groupBy(*keys).agg(
        F.least(F.count("seq_mae"), F.lit(window)).alias("seq_history"),
        F.least(F.count("seasonal_mae"), F.lit(window)).alias("seasonal_history"),
    )
    names = ["seq_weight", "seasonal_weight", "avg_seq_mae", "avg_seasonal_mae"]
    last = weights.groupBy(*keys).agg(*[F.max_by(c, cycle_ts).alias(c) for c in names])
    return sizes.join(last, list(keys), "left")

"""Alert rules, alert rows, exported gauges and dashboard queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import DAY, block_window, carry, ceil_to, floor_to, join_series, micros, own_rows, steps_between, sum_of, time_blocks, trailing, with_slot
from ..session import materialise

# Alert thresholds and the time each must hold.
LOW_CONFIDENCE, LOW_CONFIDENCE_FOR_S = 0.5, 600
HIGH_ERROR, HIGH_ERROR_FOR_S = 0.2, 900
SCALING_RATE, SCALING_RATE_WINDOW_S, SCALING_RATE_FOR_S = 0.1, 600, 300
STALE_MODEL_S = 172_800


def held_for(
    df: DataFrame, keys: Sequence[str], ts: str, condition: Column, for_s: float, *, slot_s: float = DAY
) -> DataFrame:
    """Add ``active_since`` (start of the current unbroken run of true rows) and ``firing``
    (the run has lasted ``for_s`` seconds)."""
    rows = with_slot(df.withColumn("_on", F.coalesce(condition, F.lit(False))), ts, slot_s)
    rows = carry(rows, keys, ts, {"_was": F.col("_on")}, slot_s=slot_s, strict=True)
    begins = F.col("_on") & ~F.coalesce("_was", F.lit(False))
    rows = carry(rows, keys, ts, {"_since": F.when(begins, F.col(ts))}, slot_s=slot_s)
    lasted = (micros(ts) - micros("_since")) >= int(for_s * 1_000_000)
    return rows.select(
        *df.columns, F.when(F.col("_on"), F.col("_since")).alias("active_since"), (F.col("_on") & lasted).alias("firing")
    )


def alert_intervals(held: DataFrame, keys: Sequence[str], ts: str, name: str, severity: str) -> DataFrame:
    """One row per run that fired: start, first firing and last firing time."""
    return (
        held.filter("firing")
        .groupBy(*keys, "active_since")
        .agg(F.min(ts).alias("fired_at"), F.max(ts).alias("last_seen"))
        .select(*keys, F.lit(name).alias("alert"), F.lit(severity).alias("severity"), "active_since", "fired_at", "last_seen")
    )


def event_rate(
    events: DataFrame, keys: Sequence[str], ts: str, window_s: int, *, block_s: float = DAY, name: str = "rate"
) -> DataFrame:
    """Events per second over the window that ends at each row."""
    blocks = time_blocks(events, ts, width_s=max(block_s, window_s), back_s=window_s).withColumn("_us", micros(ts))
    framed = trailing(blocks, keys, "_us", window_s, {"_n": (F.count, F.lit(1))})
    rate = (sum_of("_n_tail", "_n_head") / window_s).alias(name)
    return own_rows(framed.select(*events.columns, "_block", "_own", rate))


def stale_models(registry: DataFrame, keys: Sequence[str], at, limit_s: float = STALE_MODEL_S) -> DataFrame:
    """Series whose newest model is older than the limit, with its age."""
    last = registry.groupBy(*keys).agg(F.max("created_at").alias("last_trained"))
    age = (micros(F.lit(at).cast("timestamp")) - micros("last_trained")) / 1_000_000
    return last.withColumn("age_seconds", age).filter(F.col("age_seconds") > limit_s)

# Titles and messages of alert rows.
TITLE_SCALING = "Scaling %s: %d → %d replicas"
TEXT_SCALING = "A *%s* scaling event was triggered."
TITLE_DRIFT = "Model Drift Detected"
TEXT_DRIFT = "Prediction MAE (%.4f) exceeds threshold (%.4f). Consider retraining the model."
TITLE_CONFIDENCE = "Low Prediction Confidence"
TEXT_CONFIDENCE = "Prediction confidence has dropped to %.1f%%."


def _percent(value: Column) -> Column:
    return F.format_string("%.1f%%", value * 100)


def scaling_alerts(events: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Alert rows for executed scaling events."""
    current, target = F.col("current_replicas").cast("int"), F.col("target_replicas").cast("int")
    return events.select(
        *keys,
        ts,
        F.format_string(TITLE_SCALING, F.upper("direction"), current, target).alias("title"),
        F.format_string(TEXT_SCALING, F.col("direction")).alias("message"),
        F.when(F.col("direction") == "up", "info").otherwise("warning").alias("severity"),
        F.create_map(
            F.lit("Current Replicas"), current.cast("string"),
            F.lit("Target Replicas"), target.cast("string"),
            F.lit("Confidence"), _percent(F.col("confidence")),
        ).alias("metadata"),
    )


def drift_alerts(errors: DataFrame, keys: Sequence[str], ts: str, limit: float = HIGH_ERROR) -> DataFrame:
    """Alert rows where the error exceeds the limit."""
    return errors.filter(F.col("mae") > limit).select(
        *keys,
        ts,
        F.lit(TITLE_DRIFT).alias("title"),
        F.format_string(TEXT_DRIFT, F.col("mae"), F.lit(limit)).alias("message"),
        F.lit("warning").alias("severity"),
        F.create_map(
            F.lit("Current MAE"), F.format_string("%.4f", F.col("mae")),
            F.lit("Threshold"), F.format_string("%.4f", F.lit(limit)),
        ).alias("metadata"),
    )


def confidence_alerts(predictions: DataFrame, keys: Sequence[str], ts: str, limit: float = LOW_CONFIDENCE) -> DataFrame:
    """Alert rows where the confidence is below the limit."""
    return predictions.filter(F.col("confidence") < limit).select(
        *keys,
        ts,
        F.lit(TITLE_CONFIDENCE).alias("title"),
        F.format_string(TEXT_CONFIDENCE, F.col("confidence") * 100).alias("message"),
        F.lit("warning").alias("severity"),
        F.create_map(F.lit("Confidence"), _percent(F.col("confidence"))).alias("metadata"),
    )


def scaling_timeline(events: DataFrame, keys: Sequence[str], ts: str, window_s: int = 300) -> DataFrame:
    """Executed events per window and direction, as counts and as a rate."""
    start = F.timestamp_micros(floor_to(micros(ts), window_s))
    counted = events.withColumn(ts, start).groupBy(*keys, ts, "direction").agg(F.count(F.lit(1)).alias("events"))
    return counted.withColumn("rate", F.col("events") / window_s)


def scaling_totals(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count_if(F.col("direction") == "up").alias("up"),
        F.count_if(F.col("direction") == "down").alias("down"),
        F.count(F.lit(1)).alias("total"),
    )


def align_on_grid(
    samples: DataFrame, gauges: dict[str, Column], keys: Sequence[str], ts: str, step_s: int, *, order: Sequence[str] = (), slot_s: float = 7 * DAY
) -> DataFrame:
    """Put several gauges of one sample table on one grid, each as of the grid time.

    ``gauges`` gives each one's value in a sample, NULL where the sample is another's. One
    pass reduces the samples to their last values per series and step; the order in time is
    then worked out on that smaller table, which is written once.
    """
    names = list(gauges)
    rows = samples.select(*keys, ts, *order, *[v.alias(n) for n, v in gauges.items()])
    newest = F.struct(ts, *order)
    # A step takes what is known up to and including its own time.
    step = F.timestamp_micros(ceil_to(micros(ts), step_s))
    last = [F.max_by(n, F.when(F.col(n).isNotNull(), newest)).alias(n) for n in names]
    steps = rows.groupBy(*keys, step.alias("_step")).agg(*last, F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    steps = materialise(steps, "gauge-steps")
    # The grid ends with the last step that is not after the last sample.
    spans = steps.groupBy(*keys).agg(F.min("_step").alias("_lo"), F.max("_hi").alias("_hi")).filter("_lo <= _hi")
    line = join_series(steps_between(spans, keys, ts, step_s), steps.select(*keys, F.col("_step").alias(ts), *names), [*keys, ts])
    known = carry(line, keys, ts, {f"_asof_{n}": F.col(n) for n in names}, slot_s=slot_s)
    return known.select(*keys, ts, *[F.col(f"_asof_{n}").alias(n) for n in names])


def trend(df: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], window_s: int) -> DataFrame:
    """Mean per window of each value, and the number of rows (cycles) in it."""
    start = F.timestamp_micros(floor_to(micros(ts), window_s))
    return df.withColumn(ts, start).groupBy(*keys, ts).agg(
        *[F.avg(v).alias(f"avg_{v}") for v in values], F.count(F.lit(1)).alias("cycles")
    )


def prediction_history(
    predictions: DataFrame,
    actuals: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    horizon_s: int,
    *,
    block_s: float = 7 * DAY,
) -> DataFrame:
    """Predictions with the largest actual value in ``(ts, ts + horizon]``; NULL if none yet.

    Both go on one time line and a forward range frame takes the maximum, so predictions
    are not paired with every actual of their range.
    """
    own_cols = predictions.columns
    line = predictions.withColumn("_is_pred", F.lit(1)).unionByName(
        actuals.select(*keys, ts, F.col(value).alias("_actual"), F.lit(0).alias("_is_pred")), allowMissingColumns=True
    )
    blocks = time_blocks(line, ts, width_s=max(block_s, horizon_s), ahead_s=horizon_s).withColumn("_us", micros(ts))
    w = block_window(keys, ["_us"]).rangeBetween(1, horizon_s * 1_000_000)
    peak = F.max("_actual").over(w).alias("actual_peak")
    return own_rows(blocks.select(*own_cols, "_is_pred", "_block", "_own", peak)).filter("_is_pred = 1").drop("_is_pred")


def exported_gauges(predictions: DataFrame, guarded: DataFrame, registry: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Current gauges and counters as ``(series…, metric, direction, value)``.

    ``predictions(…, confidence, recommended_replicas, mae)``; ``direction`` labels the
    scaling counter only.
    """

    def rows(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
        wide = df.groupBy(*keys).agg(*[c.cast("double").alias(n) for n, c in metrics.items()])
        return wide.unpivot(list(keys), list(metrics), "metric", "value").withColumn("direction", F.lit(""))

    latest = rows(
        predictions,
        {
            "prediction_confidence": F.max_by("confidence", ts),
            "recommended_replicas": F.max_by("recommended_replicas", ts),
            "prediction_mae": F.max_by("mae", ts),
            "prediction_cycles_total": F.count(F.lit(1)),
        },
    )
    trained = rows(registry, {"model_last_trained_timestamp": F.max(micros("created_at") / 1_000_000)})
    scaled = (
        guarded.filter("executed")
        .groupBy(*keys, "direction")
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
        .withColumn("metric", F.lit("scaling_events_total"))
    )
    return latest.unionByName(trained).unionByName(scaled).select(*keys, "metric", "direction", "value")


def status_rollup(frame: DataFrame, predictions: DataFrame, guarded: DataFrame, registry: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """State of every series in one row: data, predictions, decisions and model.

    The four parts are stacked and folded by series in one aggregation.
    """
    parts = [
        frame.select(*keys, F.lit("data").alias("_part"), ts),
        predictions.select(*keys, F.lit("prediction").alias("_part"), ts, "confidence", "recommended_replicas"),
        guarded.select(*keys, F.lit("decision").alias("_part"), ts, "direction", "executed"),
        active_part(registry, keys, ts),
    ]
    line = parts[0]
    for p in parts[1:]:
        line = line.unionByName(p, allowMissingColumns=True)
    of = lambda part: F.col("_part") == part
    when_ = lambda part: F.when(of(part), F.col(ts))
    return line.groupBy(*keys).agg(
        F.count_if(of("data")).alias("buffer_rows"),
        F.max(when_("data")).alias("newest"),
        F.count_if(of("prediction")).alias("prediction_count"),
        F.max_by("confidence", when_("prediction")).alias("last_confidence"),
        F.max_by("recommended_replicas", when_("prediction")).alias("last_recommended"),
        F.max_by("direction", when_("decision")).alias("last_direction"),
        F.count_if(F.col("executed")).alias("events"),
        F.max("version").alias("active_version"),
    )


def active_part(registry: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    return registry.filter("is_active").select(*keys, F.lit("model").alias("_part"), F.col("created_at").alias(ts), "version")

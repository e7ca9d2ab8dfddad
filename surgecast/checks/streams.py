"""The streaming forms, run over everything available and checked against plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions
from ..plans import flows
from ..plans.blocks import OWN, POS, block_window, floor_to, micros, own_rows, row_blocks, with_positions
from ..session import release, scratch_dir
from ..sources.tables import SERIES, bin_metrics, bin_sums, label_events
from ..streaming import control, firing, ingest, weighting
from .base import BY, FRAME, KEYS, SAMPLES, STEP_S, floor_ts, frame, query, r, rounded, rs
from .deciding import D_COLS, GUARD, GUARDED, decide_sql, decided
from .forecasting import C, W_COLS, WEIGHTS, WINDOW, forecast_pairs

CLOSED = "(SELECT max(ts) FROM samples) - INTERVAL 10 MINUTES"


@query(
    "streaming_bins",
    "N1 N2",
    f"""WITH {SAMPLES} SELECT {KEYS}, {floor_ts(3600)} AS ts, count(*) AS n, {r('sum(value)', 'total')} FROM samples GROUP BY ALL
    HAVING {floor_ts(3600, 'any_value(ts)')} + INTERVAL 1 HOUR <= {CLOSED}""".replace("GROUP BY ALL", f"GROUP BY {KEYS}, {floor_ts(3600)}"),
)
def streaming_bins(spark, sf_dir):
    """Hourly bins of a watermarked stream; the SQL keeps the bins the watermark has passed."""
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]
    bins = ingest.tumbling_bins(ingest.stream_samples(spark, sf_dir), SERIES, aggs, "1 hour")
    return rounded(ingest.run_to_table(bins, "stream-bins"))


@query(
    "streaming_rate",
    "N2",
    f"""WITH {SAMPLES}, steps AS (SELECT {KEYS}, make_timestamp(epoch_us(ts) - epoch_us(ts) % 900000000 + 900000000) AS ts, sum(value) AS s
      FROM samples GROUP BY ALL),
    spread AS (SELECT {KEYS}, ts + k * INTERVAL 15 MINUTES AS ts, s FROM steps, range(4) AS t(k))
    SELECT {KEYS}, ts, {r('sum(s) / 3600', 'rate')} FROM spread WHERE ts <= {CLOSED} GROUP BY ALL""",
)
def streaming_rate(spark, sf_dir):
    """Hourly sliding rate every fifteen minutes."""
    rate = ingest.sliding_rate(
        ingest.stream_samples(spark, sf_dir), SERIES, F.col("value"), window="1 hour", step="15 minutes", window_s=3600
    )
    return rounded(ingest.run_to_table(rate, "stream-rate"))


@query(
    "streaming_dedup",
    "N3",
    f"""WITH {SAMPLES} SELECT {KEYS}, {floor_ts(3600)} AS ts, max(seq) AS seq, arg_max(value, seq) AS value FROM samples
    GROUP BY {KEYS}, {floor_ts(3600)} HAVING {floor_ts(3600, 'any_value(ts)')} <= (SELECT max({floor_ts(3600)}) FROM samples) - INTERVAL 10 MINUTES""",
)
def streaming_dedup(spark, sf_dir):
    """Samples rounded to the hour collide; the last arrival stays."""
    rows = label_events(ingest.stream_table(spark, sf_dir, "events"))
    rows = rows.select(*SERIES, F.timestamp_micros(floor_to(micros("ts"), 3600)).alias("ts"), "seq", "value")
    return ingest.run_to_table(ingest.dedup_last(rows.withWatermark("ts", ingest.LATENESS), SERIES, "seq"), "stream-dedup")


TICK_S = 7200


def peak_of_history(history):
    """Score: the largest load of the last five bins; the current replicas are a gauge."""
    placed = row_blocks(with_positions(history, SERIES, "ts", slot_s=30 * 86400), size=4096, back=4)
    peak = F.max("cpu_usage").over(block_window(SERIES, [POS]).rowsBetween(-4, 0))
    out = placed.select(*SERIES, "ts", "current_replicas", "_block", OWN, peak.cast("float").cast("double").alias("predicted_peak"))
    return own_rows(out).withColumn("confidence", F.lit(0.9))


@query(
    "streaming_tick",
    "N4",
    f"""WITH {SAMPLES}, bins AS (SELECT {KEYS}, {floor_ts(TICK_S)} AS ts, sum(value) / 10 AS cpu_usage, max(user_id % 10 + 1)::INT AS current_replicas
      FROM samples GROUP BY {KEYS}, {floor_ts(TICK_S)} HAVING {floor_ts(TICK_S, 'any_value(ts)')} + INTERVAL {TICK_S} SECONDS <= {CLOSED}),
    scored AS (SELECT *, max(cpu_usage) OVER ({BY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)::FLOAT::DOUBLE AS predicted_peak, 0.9 AS confidence FROM bins)
    SELECT {D_COLS} FROM {decide_sql('scored')}""",
)
def streaming_tick(spark, sf_dir):
    """Closed bins go through features, scoring and decision in each micro-batch."""
    top = F.max(F.substring_index("pod", "-", -1).cast("int") % 10 + 1).alias("current_replicas")
    bins = ingest.tumbling_bins(
        ingest.stream_samples(spark, sf_dir), SERIES, [(F.sum("value") / 10).alias("cpu_usage"), top], f"{TICK_S} seconds"
    )
    loop = control.TickLoop(spark, SERIES, peak_of_history, decisions.decide, history_s=30 * 86400)
    loop.run(bins, trigger={"availableNow": True}).awaitTermination()
    return loop.decisions(spark).select(*SERIES, "ts", "current_replicas", "target_replicas", "direction", "approved")


def as_stream(df, purpose: str):
    """Write a table and read it back as a file stream."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query("streaming_guard", "N5 K5 K6", f"WITH RECURSIVE {GUARDED} SELECT {D_COLS}, executed FROM guarded")
def streaming_guard(spark, sf_dir):
    """The safety rules with per-series state; must equal the batch result."""
    guarded = control.guard_stream(as_stream(decided(spark, sf_dir), "decision-stream"), SERIES, GUARD)
    return ingest.run_to_table(guarded, "stream-guarded")


@query(
    "streaming_alert_runs",
    "N6 M1",
    f"""WITH {FRAME}, flagged AS (SELECT *, coalesce(cpu_usage > 8, FALSE) AS is_on FROM frame),
    starts AS (SELECT *, is_on AND NOT coalesce(lag(is_on) OVER ({BY}), FALSE) AS starts FROM flagged),
    runs AS (SELECT *, sum(starts::INT) OVER ({BY}) AS run FROM starts),
    held AS (SELECT {KEYS}, run, min(ts) AS active_since, max(ts) AS last, count(*) AS steps FROM runs WHERE is_on GROUP BY ALL)
    SELECT {KEYS}, active_since, steps FROM held
    WHERE steps >= 4 AND last + INTERVAL 7201 SECONDS <= (SELECT max(ts) FROM frame) - INTERVAL 10 MINUTES""",
)
def streaming_alert_runs(spark, sf_dir):
    """Load above eight for six hours, found by session windows; only closed runs are out."""
    rows = as_stream(frame(spark, sf_dir).select(*SERIES, "ts", "cpu_usage"), "metric-stream").withWatermark("ts", ingest.LATENESS)
    runs = ingest.condition_runs(rows, SERIES, F.col("cpu_usage") > 8, step_s=7200, for_s=6 * 3600)
    return ingest.run_to_table(runs, "stream-runs")


@query(
    "streaming_alert_firing",
    "N6 M1",
    f"""WITH {FRAME}, passed AS (SELECT max(ts) - INTERVAL 10 MINUTES AS w FROM frame),
    flagged AS (SELECT {KEYS}, ts, coalesce(cpu_usage > 8, FALSE) AS is_on FROM frame, passed WHERE ts <= w),
    starts AS (SELECT *, is_on AND NOT coalesce(lag(is_on) OVER ({BY}), FALSE) AS starts,
      min(CASE WHEN NOT is_on THEN ts END) OVER ({BY} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ends FROM flagged)
    SELECT {KEYS}, ts AS active_since, ts + INTERVAL 6 HOURS AS fired_at FROM starts, passed
    WHERE starts AND ts + INTERVAL 6 HOURS <= w AND (ends IS NULL OR ends > ts + INTERVAL 6 HOURS)""",
)
def streaming_alert_firing(spark, sf_dir):
    """Load above eight for six hours: an alert comes out at that moment, also of a run that has not ended."""
    rows = as_stream(frame(spark, sf_dir).select(*SERIES, "ts", "cpu_usage"), "metric-stream").withWatermark("ts", ingest.LATENESS)
    return ingest.run_to_table(firing.firing_alerts(rows, SERIES, F.col("cpu_usage") > 8, 6 * 3600), "stream-firing")


@query(
    "streaming_weights",
    "N5 J4",
    f"""WITH {WEIGHTS} SELECT {C}, {rs(W_COLS)} FROM weights
    WHERE cycle + INTERVAL 1 DAY <= (SELECT max(cycle) FROM pairs) - INTERVAL 10 MINUTES""",
)
def streaming_weights(spark, sf_dir):
    """Weights kept as state while forecasts and actual values stream in; must equal the batch result."""
    pairs = forecast_pairs(spark, sf_dir)
    made = as_stream(pairs.select(*SERIES, "cycle", "ts", "seq_pred", "seasonal_pred"), "forecast-stream")
    seen = as_stream(pairs.select(*SERIES, "ts", F.col("actual").alias("value")), "actual-stream")
    out = weighting.weights_stream(made, seen, SERIES, horizon_s=86_400, window=WINDOW)
    return rounded(ingest.run_to_table(out, "stream-weights"))


@query(
    "streaming_history",
    "N1 D4",
    f"""WITH {SAMPLES}, bins AS (SELECT {KEYS}, {floor_ts(3600)} AS ts, count(*) AS n, sum(value) AS total FROM samples
      GROUP BY {KEYS}, {floor_ts(3600)} HAVING {floor_ts(3600, 'any_value(ts)')} + INTERVAL 1 HOUR <= {CLOSED})
    SELECT {KEYS}, ts, n, {r('total')} FROM bins WHERE ts >= (SELECT max(ts) FROM bins) - INTERVAL 168 HOURS""",
)
def streaming_history(spark, sf_dir):
    """What is left of closed bins after a replay with a retention of 168 hours."""
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]
    bins = ingest.tumbling_bins(ingest.stream_samples(spark, sf_dir), SERIES, aggs, "1 hour")
    kept = control.History(scratch_dir(spark, "history"), bins.schema)
    mark = scratch_dir(spark, "history-progress")
    bins.writeStream.foreachBatch(kept.add).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return rounded(kept.rows(spark))


def metric_bins(spark, sf_dir):
    """Closed bins of all metrics from the stream of samples."""
    stream = ingest.stream_samples(spark, sf_dir)
    return bin_metrics(ingest.tumbling_bins(stream, SERIES, bin_sums(), f"{STEP_S} seconds"), STEP_S)


@query("streaming_model_tick", "N4 N1 A11")
def streaming_model_tick(spark, sf_dir):
    """Closed bins go through a control cycle with stored models in each micro-batch."""
    path = scratch_dir(spark, "models")
    fitted = flows.train(frame(spark, sf_dir), SERIES, "ts", lookback=24, horizon=10, base_path=path, store=True)
    # The loop reads the stored models.
    release(fitted.seasonal, fitted.sequence, fitted.scaler, fitted.limits)
    # Open bins of all series wait outside the heap.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", control.ROCKSDB)
    bins = metric_bins(spark, sf_dir)
    loop = control.ControlLoop(
        spark, SERIES, lambda s: flows.load(fitted.registry, SERIES, path, fitted.columns), bins.schema,
        step_s=STEP_S, keep_s=60 * 86_400, guard=GUARD, lookback=24, horizon=10,
    )
    loop.run(bins, trigger={"availableNow": True}).awaitTermination()
    return loop.decisions(spark)

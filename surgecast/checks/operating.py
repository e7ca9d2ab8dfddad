"""Model registry, alerts, exported gauges and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts, ensemble, lifecycle
from ..plans import flows
from ..session import materialise, release, scratch_dir
from ..sources.tables import SERIES, samples
from .base import FRAME, KEYS, SAMPLES, ceil_ts, floor_ts, frame, query, r, rounded, rs
from .deciding import AS_OF, GUARD, GUARDED, INPUTS, decision_inputs, guarded
from .forecasting import C, CYCLE, PAIRS, RESULTS, forecast_pairs
from .preparing import cleaned

# -- registry ---------------------------------------------------------------------------

# A training run per series and day.
RUNS = f"""{FRAME},
runs AS (SELECT {KEYS}, max(ts) AS created_at, round(stddev_samp(cpu_usage) / 50, 6) AS mae FROM frame GROUP BY {KEYS}, date_trunc('day', ts)),
registry AS (SELECT {KEYS}, n, 'v' || n || '_' || strftime(created_at, '%Y%m%d_%H%M%S') AS version, created_at, mae
  FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY created_at) AS n FROM runs)),
best AS (SELECT {KEYS}, arg_min(version, (mae, n)) AS version FROM registry WHERE mae IS NOT NULL GROUP BY ALL),
promoted AS (SELECT r.*, coalesce(r.version = b.version, FALSE) AS is_active FROM registry r LEFT JOIN best b USING ({KEYS}))"""


def registry(spark, sf_dir, grid=None):
    runs = (frame(spark, sf_dir) if grid is None else grid).groupBy(*SERIES, F.date_trunc("day", "ts")).agg(
        F.max("ts").alias("created_at"), F.round(F.stddev_samp("cpu_usage") / 50, 6).alias("mae")
    )
    runs = runs.select(*SERIES, "created_at", F.create_map(F.lit("mae"), F.col("mae").cast("string")).alias("metrics"))
    half = F.dayofmonth("created_at") <= 15
    runs = materialise(runs, "runs")
    first = lifecycle.create_versions(None, runs.filter(half), SERIES, "models")
    return materialise(lifecycle.create_versions(first, runs.filter(~half), SERIES, "models"), "registry")


def promoted(spark, sf_dir, grid=None):
    rows = registry(spark, sf_dir, grid)
    mae = F.col("metrics")["mae"].cast("double")
    best = rows.groupBy(*SERIES).agg(F.min_by("version", F.when(mae.isNotNull(), F.struct(mae, "n"))).alias("version"))
    return materialise(lifecycle.promote(rows, best, SERIES), "promoted")


@query("create_versions", "L1", f"WITH {RUNS} SELECT {KEYS}, n, version, created_at FROM registry")
def create_versions(spark, sf_dir):
    """Versions of two training batches, numbered through."""
    return registry(spark, sf_dir).select(*SERIES, "n", "version", "created_at")


@query("promote_version", "L2", f"WITH {RUNS} SELECT {KEYS}, version, is_active FROM promoted")
def promote_version(spark, sf_dir):
    return promoted(spark, sf_dir).select(*SERIES, "version", "is_active")


@query("active_versions", "L3", f"WITH {RUNS} SELECT {KEYS}, version, created_at FROM promoted WHERE is_active")
def active_versions(spark, sf_dir):
    return lifecycle.active_versions(promoted(spark, sf_dir)).select(*SERIES, "version", "created_at")


@query("list_versions", "L3 D3", f"WITH {RUNS} SELECT {KEYS}, n, version, is_active FROM promoted ORDER BY {KEYS}, n")
def list_versions(spark, sf_dir):
    return lifecycle.list_versions(promoted(spark, sf_dir), SERIES).select(*SERIES, "n", "version", "is_active")


CURRENT = f"current AS (SELECT {KEYS}, stddev_samp(cpu_usage) / 50 AS mae FROM frame GROUP BY ALL)"


@query(
    "retrain_check",
    "L4",
    f"""WITH {RUNS}, {CURRENT}, active AS (SELECT * FROM promoted WHERE is_active AND deployment <> 'app-3'),
    why AS (SELECT c.namespace, c.deployment, version, c.mae, CASE WHEN version IS NULL THEN 'no active model' WHEN c.mae > 0.2 THEN 'high error'
      WHEN c.deployment = 'app-5' THEN 'bad timestamp'
      WHEN epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at) > 400 * 3600000000 THEN 'stale model' ELSE 'none' END AS why
      FROM current c LEFT JOIN active USING ({KEYS}))
    SELECT {KEYS}, version, {r('mae')}, why <> 'none' AS retrain, why FROM why""",
)
def retrain_check(spark, sf_dir):
    """One series has no active model and one an unreadable creation time."""
    rows = promoted(spark, sf_dir).withColumns(
        {
            "is_active": F.col("is_active") & (F.col("deployment") != "app-3"),
            "created_at": F.when(F.col("deployment") == "app-5", "yesterday").otherwise(F.col("created_at").cast("string")),
        }
    )
    current = frame(spark, sf_dir).groupBy(*SERIES).agg((F.stddev_samp("cpu_usage") / 50).alias("mae"))
    return rounded(lifecycle.retrain_check(rows, current, SERIES, AS_OF, max_age_hours=400))


@query(
    "prune_versions",
    "L5",
    f"""WITH {RUNS} SELECT {KEYS}, n, version, is_active FROM promoted QUALIFY count(*) OVER (PARTITION BY {KEYS}) <= 5 OR is_active
    OR row_number() OVER (PARTITION BY {KEYS}, is_active ORDER BY n DESC) <= 4""",
)
def prune_versions(spark, sf_dir):
    return lifecycle.prune(promoted(spark, sf_dir), SERIES).select(*SERIES, "n", "version", "is_active")


@query(
    "versions_past_limit",
    "L1 L2 L5",
    f"""WITH {RUNS} SELECT {KEYS}, n, version, n = top AS is_active
    FROM (SELECT *, max(n) OVER (PARTITION BY {KEYS}) AS top FROM registry WHERE n <= 8) WHERE n > top - 5""",
)
def versions_past_limit(spark, sf_dir):
    """Eight trainings of every series with five versions kept: numbers go on and the newest is active."""
    runs = registry(spark, sf_dir).select(*SERIES, "n", "created_at", "metrics")
    kept = None
    for i in range(1, 9):
        kept = lifecycle.create_versions(kept, runs.filter(F.col("n") == i).drop("n"), SERIES, "models")
        kept = lifecycle.promote(kept, lifecycle.latest_choice(kept, SERIES), SERIES)
        kept = materialise(lifecycle.prune(kept, SERIES), "kept")
    return kept.select(*SERIES, "n", "version", "is_active")


# -- alerts -----------------------------------------------------------------------------


def held_sql(source: str, keys: str, condition: str, for_s: float, name: str, severity: str) -> str:
    """Runs of consecutive true rows that lasted long enough, by counting run starts."""
    order = f"PARTITION BY {keys} ORDER BY ts"
    return f"""flagged AS (SELECT {keys}, ts, coalesce({condition}, FALSE) AS is_on FROM {source}),
    starts AS (SELECT *, is_on AND NOT coalesce(lag(is_on) OVER ({order}), FALSE) AS starts FROM flagged),
    runs_of AS (SELECT *, sum(starts::INT) OVER ({order}) AS run FROM starts),
    held AS (SELECT {keys}, ts, min(ts) OVER (PARTITION BY {keys}, run) AS active_since FROM runs_of WHERE is_on)
    SELECT {keys}, '{name}' AS alert, '{severity}' AS severity, active_since, min(ts) AS fired_at, max(ts) AS last_seen
    FROM held WHERE epoch_us(ts) - epoch_us(active_since) >= {int(for_s * 1_000_000)} GROUP BY {keys}, active_since"""


@query(
    "low_confidence_alert",
    "M1",
    f"WITH {INPUTS}, "
    + held_sql("inputs", KEYS, "confidence < 0.72", 4 * 3600, "LowPredictionConfidence", "warning"),
)
def low_confidence_alert(spark, sf_dir):
    """Confidence below 0.72 for four hours."""
    rows = materialise(decision_inputs(spark, sf_dir).select(*SERIES, "ts", "confidence"), "confidence")
    held = alerts.held_for(rows, SERIES, "ts", F.col("confidence") < 0.72, 4 * 3600)
    return alerts.alert_intervals(held, SERIES, "ts", "LowPredictionConfidence", "warning")


CYCLE_MAE = f"cycle_mae AS (SELECT {KEYS}, cycle AS ts, avg(abs(actual - seq_pred)) AS mae FROM pairs GROUP BY ALL)"


@query(
    "high_error_alert",
    "M2",
    f"WITH {PAIRS}, {CYCLE_MAE}, " + held_sql("cycle_mae", KEYS, "mae > 8", 86400, "HighPredictionError", "critical"),
)
def high_error_alert(spark, sf_dir):
    """Daily error above eight for two days running."""
    rows = ensemble.cycle_errors(forecast_pairs(spark, sf_dir), CYCLE).select(*SERIES, F.col("cycle").alias("ts"), F.col("seq_mae").alias("mae"))
    held = alerts.held_for(materialise(rows, "cycle-mae"), SERIES, "ts", F.col("mae") > 8, 86400, slot_s=7 * 86400)
    return alerts.alert_intervals(held, SERIES, "ts", "HighPredictionError", "critical")


@query(
    "frequent_events_alert",
    "M3",
    f"""WITH {SAMPLES}, rated AS (SELECT namespace, ts, seq, count(*) OVER (PARTITION BY namespace ORDER BY epoch_us(ts)
      RANGE BETWEEN {3600 * 1_000_000 - 1} PRECEDING AND CURRENT ROW) / 3600 AS rate FROM samples), """
    + held_sql("rated", "namespace", "rate > 0.0025", 1200, "FrequentScaling", "warning"),
)
def frequent_events_alert(spark, sf_dir):
    """Raw events per namespace: more than nine an hour, held for twenty minutes."""
    rows = samples(spark, sf_dir).select("namespace", "ts", "seq")
    rated = materialise(alerts.event_rate(rows, ["namespace"], "ts", 3600), "rated")
    held = alerts.held_for(rated, ["namespace"], "ts", F.col("rate") > 0.0025, 1200)
    return alerts.alert_intervals(held, ["namespace"], "ts", "FrequentScaling", "warning")


@query(
    "stale_model_alert",
    "M4",
    f"""WITH {RUNS} SELECT {KEYS}, max(created_at) AS last_trained,
    (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(created_at))) / 1000000 AS age_seconds FROM registry
    WHERE namespace = 'prod' OR day(created_at) <= 20 GROUP BY ALL HAVING age_seconds > 172800""",
)
def stale_model_alert(spark, sf_dir):
    """Staging is taken to have stopped training after the 20th."""
    rows = registry(spark, sf_dir).filter((F.col("namespace") == "prod") | (F.dayofmonth("created_at") <= 20))
    return alerts.stale_models(rows, SERIES, AS_OF)


@query(
    "alert_rows",
    "M5",
    f"""WITH RECURSIVE {GUARDED} SELECT {KEYS}, ts, 'Scaling ' || upper(direction) || ': ' || current_replicas || ' → ' || target_replicas || ' replicas' AS title,
      CASE direction WHEN 'up' THEN 'info' ELSE 'warning' END AS severity FROM guarded WHERE executed
    UNION ALL SELECT {KEYS}, ts, 'Low Prediction Confidence', 'warning' FROM guarded WHERE confidence < 0.6""",
)
def alert_rows(spark, sf_dir):
    rows = guarded(spark, sf_dir)
    scaled = alerts.scaling_alerts(rows.filter("executed"), SERIES, "ts")
    return scaled.unionByName(alerts.confidence_alerts(rows, SERIES, "ts", 0.6)).select(*SERIES, "ts", "title", "severity")


@query(
    "drift_alert_rows",
    "M5",
    f"""WITH {PAIRS}, {CYCLE_MAE} SELECT {KEYS}, ts, 'Model Drift Detected' AS title,
    printf('Prediction MAE (%.4f) exceeds threshold (8.0000). Consider retraining the model.', mae) AS message, 'warning' AS severity
    FROM cycle_mae WHERE mae > 8""",
)
def drift_alert_rows(spark, sf_dir):
    rows = ensemble.cycle_errors(forecast_pairs(spark, sf_dir), CYCLE).select(*SERIES, F.col("cycle").alias("ts"), F.col("seq_mae").alias("mae"))
    return alerts.drift_alerts(rows, SERIES, "ts", 8.0).drop("metadata")


# -- dashboards -------------------------------------------------------------------------


@query(
    "scaling_timeline",
    "M6",
    f"""WITH RECURSIVE {GUARDED} SELECT {KEYS}, {floor_ts(86400)} AS ts, direction, count(*) AS events, {r('count(*) / 86400', 'rate', 9)}
    FROM guarded WHERE executed GROUP BY ALL""",
)
def scaling_timeline(spark, sf_dir):
    return rounded(alerts.scaling_timeline(guarded(spark, sf_dir).filter("executed"), SERIES, "ts", 86400), 9)


@query(
    "scaling_totals",
    "M6",
    f"""WITH RECURSIVE {GUARDED} SELECT {KEYS}, count(*) FILTER (direction = 'up') AS up, count(*) FILTER (direction = 'down') AS down, count(*) AS total
    FROM guarded WHERE executed GROUP BY ALL""",
)
def scaling_totals(spark, sf_dir):
    return alerts.scaling_totals(guarded(spark, sf_dir).filter("executed"), SERIES)


def _asof(name: str, cond: str) -> str:
    return f"""{name} AS (SELECT {KEYS}, ts, arg_max(v, seq) AS value FROM (SELECT *, (user_id % 10 + 1)::DOUBLE AS v FROM samples) WHERE {cond} GROUP BY {KEYS}, ts)"""


_NAMES = {"recommended": "status_code = '200'", "ready": "status_code = '201'", "desired": "status_code = '503'"}


@query(
    "replica_alignment",
    "M7 C10",
    f"""WITH {SAMPLES}, {', '.join(_asof(n, c) for n, c in _NAMES.items())},
    ends AS (SELECT {KEYS}, {ceil_ts(3600, 'min(ts)')} AS lo, max(ts) AS hi FROM samples GROUP BY ALL),
    points AS (SELECT {KEYS}, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM ends)
    SELECT p.namespace, p.deployment, p.ts, {', '.join(f'{n}.value AS {n}' for n in _NAMES)} FROM points p
    {' '.join(f'ASOF LEFT JOIN {n} ON {n}.namespace = p.namespace AND {n}.deployment = p.deployment AND p.ts >= {n}.ts' for n in _NAMES)}""",
)
def replica_alignment(spark, sf_dir):
    """Three gauges put on one hourly grid, each as of the grid time."""
    rows = samples(spark, sf_dir).withColumn("value", (F.substring_index("pod", "-", -1).cast("int") % 10 + 1).cast("double"))
    codes = {"recommended": "200", "ready": "201", "desired": "503"}
    gauges = {n: F.when(F.col("status_code") == c, F.col("value")) for n, c in codes.items()}
    return alerts.align_on_grid(rows, gauges, SERIES, "ts", 3600, order=["seq"], slot_s=86400)


PREDICTIONS = f"""{RESULTS},
maes AS (SELECT {C}, avg(abs(actual - blended)) AS mae FROM banded GROUP BY ALL),
prediction AS (SELECT {KEYS}, cycle AS ts, confidence, predicted_peak, recommended_replicas, urgency, mae FROM predictions JOIN maes USING ({C}))"""


def predictions(spark, sf_dir, clean=None):
    rows = forecast_pairs(spark, sf_dir, clean)
    results = ensemble.combine(rows, CYCLE)
    blended = ensemble.blend(rows)
    error = F.avg(F.abs(F.col("actual") - F.col("blended"))).alias("mae")
    out = results.join(blended.groupBy(*CYCLE).agg(error), CYCLE)
    names = ["confidence", "predicted_peak", "recommended_replicas", "urgency", "mae"]
    return materialise(out.select(*SERIES, F.col("cycle").alias("ts"), *names), "predictions")


TREND = ["confidence", "mae", "recommended_replicas"]


@query(
    "prediction_trend",
    "M8",
    f"""WITH {PREDICTIONS} SELECT {KEYS}, {floor_ts(7 * 86400)} AS ts, {', '.join(r(f'avg({c})', f'avg_{c}') for c in TREND)}, count(*) AS cycles
    FROM prediction GROUP BY {KEYS}, {floor_ts(7 * 86400)}""",
)
def prediction_trend(spark, sf_dir):
    return rounded(alerts.trend(predictions(spark, sf_dir), SERIES, "ts", TREND, 7 * 86400))


@query(
    "prediction_history",
    "M9",
    f"""WITH {PREDICTIONS}, joined AS (SELECT p.namespace, p.deployment, p.ts, any_value(p.predicted_peak) AS predicted_peak, max(f.cpu_usage) AS actual_peak,
      any_value(recommended_replicas) AS recommended_replicas
      FROM prediction p LEFT JOIN frame f ON f.namespace = p.namespace AND f.deployment = p.deployment AND f.ts > p.ts AND f.ts <= p.ts + INTERVAL 20 HOURS
      GROUP BY 1, 2, 3)
    SELECT {KEYS}, ts, {rs(['predicted_peak'], 4)}, {rs(['actual_peak'])}, recommended_replicas FROM joined""",
)
def prediction_history(spark, sf_dir):
    """Predicted peak beside the largest value of the following twenty hours."""
    made = predictions(spark, sf_dir).select(*SERIES, "ts", "predicted_peak", "recommended_replicas")
    out = alerts.prediction_history(made, frame(spark, sf_dir), SERIES, "ts", "cpu_usage", 20 * 3600)
    return out.withColumns(
        {"predicted_peak": F.round(F.col("predicted_peak") + 3.1e-6, 4), "actual_peak": F.round(F.col("actual_peak") + 3.1e-8, 6)}
    )


# Guarded decisions, predictions and the registry in one statement.
EVERYTHING = f"""{GUARDED},
{PREDICTIONS[PREDICTIONS.index('pairs AS'):]},
{RUNS[RUNS.index('runs AS'):]}"""


def shared(spark, sf_dir):
    """The metric grid and its cleaned rows, made once for a query that reads them several times."""
    grid = materialise(frame(spark, sf_dir), "grid")
    return grid, materialise(cleaned(spark, sf_dir, grid).select(*SERIES, "ts", "cpu_usage"), "cleaned")


@query(
    "exported_gauges",
    "A13",
    f"""WITH RECURSIVE {EVERYTHING}, gauges AS (
      SELECT {KEYS}, 'prediction_confidence' AS metric, '' AS direction, arg_max(confidence, ts) AS value FROM prediction GROUP BY ALL
      UNION ALL SELECT {KEYS}, 'recommended_replicas', '', arg_max(recommended_replicas, ts) FROM prediction GROUP BY ALL
      UNION ALL SELECT {KEYS}, 'prediction_mae', '', arg_max(mae, ts) FROM prediction GROUP BY ALL
      UNION ALL SELECT {KEYS}, 'prediction_cycles_total', '', count(*) FROM prediction GROUP BY ALL
      UNION ALL SELECT {KEYS}, 'model_last_trained_timestamp', '', epoch_us(max(created_at)) / 1000000 FROM registry GROUP BY ALL
      UNION ALL SELECT {KEYS}, 'scaling_events_total', direction, count(*) FROM guarded WHERE executed GROUP BY ALL)
    SELECT {KEYS}, metric, direction, {r('value')} FROM gauges""",
)
def exported_gauges(spark, sf_dir):
    grid, clean = shared(spark, sf_dir)
    return rounded(alerts.exported_gauges(predictions(spark, sf_dir, clean), guarded(spark, sf_dir, clean), registry(spark, sf_dir, grid), SERIES, "ts"))


@query(
    "status_rollup",
    "M10 D7",
    f"""WITH RECURSIVE {EVERYTHING},
    a AS (SELECT {KEYS}, count(*) AS buffer_rows, max(ts) AS newest FROM frame GROUP BY ALL),
    b AS (SELECT {KEYS}, count(*) AS prediction_count, arg_max(confidence, ts) AS last_confidence, arg_max(recommended_replicas, ts) AS last_recommended FROM prediction GROUP BY ALL),
    c AS (SELECT {KEYS}, arg_max(direction, ts) AS last_direction, count(*) FILTER (executed) AS events FROM guarded GROUP BY ALL),
    d AS (SELECT {KEYS}, version AS active_version FROM promoted WHERE is_active)
    SELECT {KEYS}, buffer_rows, newest, prediction_count, {r('last_confidence')}, last_recommended, last_direction, events, active_version
    FROM a LEFT JOIN b USING ({KEYS}) LEFT JOIN c USING ({KEYS}) LEFT JOIN d USING ({KEYS})""",
)
def status_rollup(spark, sf_dir):
    grid, clean = shared(spark, sf_dir)
    out = alerts.status_rollup(grid, predictions(spark, sf_dir, clean), guarded(spark, sf_dir, clean), promoted(spark, sf_dir, grid), SERIES, "ts")
    return rounded(out)


# -- whole flows ------------------------------------------------------------------------


def trained(spark, sf_dir, base_path="models", store=False, grid=None):
    grid = frame(spark, sf_dir) if grid is None else grid
    return flows.train(grid, SERIES, "ts", lookback=24, horizon=10, base_path=base_path, store=store)


@query("training_run", "I1 I2 I5 I6 L1 L2 L5")
def training_run(spark, sf_dir):
    """Train, register and promote a version of both models for every deployment."""
    out = trained(spark, sf_dir)
    return out.registry.join(out.summary, SERIES).drop("metrics")


@query("control_tick", "J1 J2 J3 J4 J6 J7 K1 K2 K3 K4 K5 K6 K10 A11")
def control_tick(spark, sf_dir):
    """Train and store, then one cycle with the stored models: forecast ten steps, decide, guard, act.

    Weights are those after the last cycle with actuals, and the cooldown runs from the last
    executed decision of the history.
    """
    rows, clean = shared(spark, sf_dir)
    # What a tick needs of the history is a row for each series; the rest goes before the next step.
    pairs = forecast_pairs(spark, sf_dir, clean)
    errors = ensemble.cycle_errors(pairs, CYCLE)
    weights = materialise(ensemble.latest_weights(ensemble.adaptive_weights(errors, SERIES, "cycle"), SERIES, "cycle"), "weights")
    release(pairs)
    acted = guarded(spark, sf_dir, clean)
    last = materialise(acted.filter("executed").groupBy(*SERIES).agg(F.max("ts").alias("last_executed")), "last-executed")
    release(acted, clean)
    path = scratch_dir(spark, "models")
    fitted = trained(spark, sf_dir, path, True, rows)
    models = flows.load(fitted.registry, SERIES, path, fitted.columns)
    release(fitted.seasonal, fitted.sequence, fitted.scaler, fitted.limits)
    replicas = rows.groupBy(*SERIES).agg(F.max_by("ready_replicas", F.when(F.col("ready_replicas").isNotNull(), F.col("ts"))).cast("int").alias("current_replicas"))
    return flows.tick(
        rows, SERIES, "ts", models, replicas, last_executed=last, weights=weights, guard=GUARD, step_s=7200, lookback=24, horizon=10
    )

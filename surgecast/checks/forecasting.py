"""Forecasters and the ensemble."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting, ensemble, features, forecasting, lifecycle, normalize, sequences
from ..plans import flows, model_store
from ..session import materialise, release, scratch_dir
from ..sources import files
from ..sources.tables import SERIES
from .base import BY, CLEANED, FRAME, KEYS, SQL, STEP_S, frame, query, r, rounded, rs
from .preparing import cleaned

HORIZON = 10
LAST = f"last AS (SELECT {KEYS}, max(ts) AS ts FROM frame GROUP BY ALL)"
GRID = f"{FRAME}, {LAST}, points AS (SELECT {KEYS}, h, ts + h * INTERVAL {STEP_S} SECONDS AS ts FROM last, range(1, {HORIZON + 1}) AS t(h))"


def last_times(spark, sf_dir):
    return frame(spark, sf_dir).groupBy(*SERIES).agg(F.max("ts").alias("ts"))


@query("forecast_grid", "I3", f"WITH {GRID} SELECT {KEYS}, h::INT AS h, ts FROM points")
def forecast_grid(spark, sf_dir):
    return forecasting.forecast_grid(last_times(spark, sf_dir), SERIES, "ts", STEP_S, HORIZON)


@query(
    "seasonal_naive",
    "I7",
    f"""WITH {GRID}, means AS (SELECT {KEYS}, isodow(ts) AS d, hour(ts) AS hr, avg(cpu_usage) AS yhat FROM frame GROUP BY ALL)
    SELECT p.namespace, p.deployment, p.h::INT AS h, p.ts, {r('m.yhat', 'yhat')} FROM points p LEFT JOIN means m
    ON m.namespace = p.namespace AND m.deployment = p.deployment AND m.d = isodow(p.ts) AND m.hr = hour(p.ts)""",
)
def seasonal_naive(spark, sf_dir):
    history = frame(spark, sf_dir)
    last = history.groupBy(*SERIES).agg(F.max("ts").alias("ts"))
    points = forecasting.forecast_grid(last, SERIES, "ts", STEP_S, HORIZON)
    return rounded(forecasting.seasonal_naive(history, points, SERIES, "ts", "cpu_usage"))


@query(
    "naive_error",
    "I5 I7",
    f"""WITH {FRAME}, m AS (SELECT {KEYS}, isodow(ts) AS d, hour(ts) AS hr, avg(cpu_usage) AS yhat FROM frame GROUP BY ALL)
    SELECT f.namespace, f.deployment, {r('avg(abs(f.cpu_usage - m.yhat))', 'mae')}, count(*) AS n FROM frame f JOIN m
    ON m.namespace = f.namespace AND m.deployment = f.deployment AND m.d = isodow(f.ts) AND m.hr = hour(f.ts) GROUP BY ALL""",
)
def naive_error(spark, sf_dir):
    """In-sample error of the seasonal-naive forecast."""
    history = frame(spark, sf_dir)
    fitted = forecasting.seasonal_naive(history, history, SERIES, "ts", "cpu_usage")
    return rounded(forecasting.mae(fitted, SERIES, "cpu_usage", "yhat"))


@query(
    "long_enough",
    "I6",
    f"""WITH {FRAME} SELECT {KEYS}, {r('(epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000', 'hours')},
    (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000 >= 718 AS trains_sequence FROM frame GROUP BY ALL""",
)
def long_enough(spark, sf_dir):
    return rounded(forecasting.long_enough(frame(spark, sf_dir), SERIES, "ts", min_hours=718))


@query("seasonal_forecast", "I2 I4")
def seasonal_forecast(spark, sf_dir):
    """Trend and daily and weekly seasons per deployment, with an 80 % band."""
    history = materialise(cleaned(spark, sf_dir).select(*SERIES, "ts", "cpu_usage"), "history")
    model = materialise(forecasting.fit_seasonal(history, SERIES, "ts", "cpu_usage"), "fitted")
    last = history.groupBy(*SERIES).agg(F.max("ts").alias("ts"))
    return forecasting.forecast_seasonal(model, last, SERIES, "ts", step_s=STEP_S, horizon=HORIZON)


SEQ_FEATURES = ["cpu_usage", "request_rate", "error_rate"]


def fitted_sequence(spark, sf_dir):
    rows = materialise(cleaned(spark, sf_dir).select(*SERIES, "ts", *SEQ_FEATURES), "sequence-rows")
    train = sequences.chronological_split(rows, SERIES, "ts").filter("is_train")
    params = materialise(normalize.fit(train, SERIES, SEQ_FEATURES), "scaler")
    scaled = normalize.transform(rows, params, SERIES, SEQ_FEATURES)
    model = forecasting.fit_sequence(scaled, SERIES, "ts", SEQ_FEATURES, "cpu_usage", lookback=24, horizon=HORIZON)
    return scaled, params, model


@query("sequence_forecast", "I1 G6 H2")
def sequence_forecast(spark, sf_dir):
    """Multi-horizon regression on the last 24 scaled rows, brought back to its units."""
    scaled, params, model = fitted_sequence(spark, sf_dir)
    windows = sequences.inference_window(scaled, SERIES, "ts", SEQ_FEATURES, lookback=24)
    steps = forecasting.forecast_sequence(model, windows, SERIES, HORIZON)
    arrays = steps.groupBy(*SERIES, "ts").agg(F.sort_array(F.collect_list(F.struct("h", "yhat"))).alias("s"))
    arrays = arrays.select(*SERIES, "ts", F.transform("s", lambda s: s["yhat"]).alias("v"))
    back = normalize.inverse_transform_array(arrays, params, SERIES, "v", "cpu_usage")
    return back.select(*SERIES, "ts", F.posexplode("v").alias("i", "yhat")).select(*SERIES, (F.col("i") + 1).alias("h"), "yhat")


_LINE = f"""{CLEANED},
timed AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY {KEYS})) / 1e6 AS sec, lag(cpu_usage) OVER ({BY}) AS before,
  row_number() OVER ({BY}) AS i, count(*) OVER (PARTITION BY {KEYS}) AS n FROM cleaned),"""


@query(
    "straight_line_forecast",
    "I2 I3 I4",
    f"""WITH {_LINE}
    fit AS (SELECT {KEYS}, max(ts) AS last, max(sec) AS top, regr_slope(cpu_usage, sec) AS slope, regr_intercept(cpu_usage, sec) AS level,
      sqrt(regr_syy(cpu_usage, sec) * (1 - regr_r2(cpu_usage, sec)) / count(*)) AS sigma FROM timed GROUP BY ALL),
    ahead AS (SELECT *, unnest(generate_series(1, {HORIZON})) AS h FROM fit),
    made AS (SELECT {KEYS}, h::INT AS h, level + slope * (top + h * {STEP_S}) AS yhat, sigma FROM ahead)
    SELECT {KEYS}, h, {r('yhat', places=4)}, {r(f'yhat - {forecasting.INTERVAL_WIDTH_Z}::DOUBLE * sigma', 'yhat_lower', 4)},
      {r(f'yhat + {forecasting.INTERVAL_WIDTH_Z}::DOUBLE * sigma', 'yhat_upper', 4)} FROM made""",
)
def straight_line_forecast(spark, sf_dir):
    """The seasonal model with its changepoints and seasons off is a regression line with a band."""
    history = materialise(cleaned(spark, sf_dir).select(*SERIES, "ts", "cpu_usage"), "history")
    model = materialise(forecasting.fit_seasonal(history, SERIES, "ts", "cpu_usage", changepoints=0, daily=0, weekly=0), "fitted")
    last = history.groupBy(*SERIES).agg(F.max("ts").alias("ts"))
    out = forecasting.forecast_seasonal(model, last, SERIES, "ts", step_s=STEP_S, horizon=HORIZON)
    return rounded(out.select(*SERIES, "h", "yhat", "yhat_lower", "yhat_upper"), 4)


_LAMBDA = f"{forecasting.NOISE_SCALE**2 / forecasting.CHANGEPOINT_PRIOR!r}::DOUBLE"


@query(
    "sparse_changepoint",
    "I2",
    f"""WITH {CLEANED},
    sized AS (SELECT {KEYS}, min(epoch_us(ts)) AS t0, greatest(max(epoch_us(ts)) - min(epoch_us(ts)), 1) AS span, greatest(max(abs(cpu_usage)), 1e-12) AS scale FROM cleaned GROUP BY ALL),
    placed AS (SELECT {KEYS}, (epoch_us(ts) - t0) / span::DOUBLE AS t, greatest(0, (epoch_us(ts) - t0) / span::DOUBLE - 0.4::DOUBLE) AS h, cpu_usage / scale AS y
      FROM cleaned JOIN sized USING ({KEYS}) WHERE cpu_usage IS NOT NULL),
    moments AS (SELECT {KEYS}, count(*) AS n, avg(t) AS mt, avg(h) AS mh, avg(y) AS my, regr_sxx(t, t) AS tt, regr_sxy(h, t) AS ht, regr_sxy(y, t) AS yt, regr_sxx(h, h) AS hh,
      regr_sxy(y, h) AS yh FROM placed GROUP BY ALL),
    bent AS (SELECT *, yh - ht * yt / tt AS c FROM moments),
    hinged AS (SELECT *, sign(c) * greatest(abs(c) - {_LAMBDA}, 0) / (hh - ht * ht / tt) AS hinge FROM bent)
    SELECT {KEYS}, n, {r('my - (yt - hinge * ht) / tt * mt - hinge * mh', 'level', 4)}, {r('(yt - hinge * ht) / tt', 'slope', 4)}, {r('hinge', places=4)}
    FROM hinged""",
)
def sparse_changepoint(spark, sf_dir):
    """One hinge with a Laplace prior: a soft threshold on what a line leaves."""
    history = materialise(cleaned(spark, sf_dir).select(*SERIES, "ts", "cpu_usage"), "history")
    model = forecasting.fit_seasonal(history, SERIES, "ts", "cpu_usage", changepoints=1, daily=0, weekly=0, sparse=True)
    part = lambda i: F.get("trend", F.lit(i))
    return rounded(model.select(*SERIES, "n", part(0).alias("level"), part(1).alias("slope"), part(2).alias("hinge")), 4)


@query("model_store_retry", "A11 I4 L1", SQL["straight_line_forecast"])
def model_store_retry(spark, sf_dir):
    """A line for each series, stored twice and broken off once more, forecasts as if it had been stored once."""
    history = materialise(cleaned(spark, sf_dir).select(*SERIES, "ts", "cpu_usage"), "history")
    model = materialise(forecasting.fit_seasonal(history, SERIES, "ts", "cpu_usage", changepoints=0, daily=0, weekly=0), "fitted")
    last = history.groupBy(*SERIES).agg(F.max("ts").alias("ts"))
    runs = last.select(*SERIES, F.col("ts").alias("created_at"), F.create_map(F.lit("kind"), F.lit("line")).alias("metrics"))
    path = scratch_dir(spark, "models")
    registry = lifecycle.create_versions(None, runs, SERIES, path)
    registry = materialise(lifecycle.promote(registry, lifecycle.latest_choice(registry, SERIES), SERIES), "registry")
    for _ in range(2):
        model_store.publish({"seasonal": model}, registry, SERIES, path)
    # A run that never reached its commit.
    model.withColumn("sigma", F.lit(0.0)).join(registry.select(*SERIES, "version"), SERIES).write.parquet(f"{path}/seasonal/run=rbroken")
    wanted = model_store.manifest(spark, SERIES, path).join(lifecycle.active_versions(registry).select(*SERIES, "version"), [*SERIES, "version"])
    found = model_store.stored(spark, "seasonal", wanted, SERIES, path)
    out = forecasting.forecast_seasonal(found, last, SERIES, "ts", step_s=STEP_S, horizon=HORIZON)
    return rounded(out.select(*SERIES, "h", "yhat", "yhat_lower", "yhat_upper"), 4)


@query(
    "one_step_regression",
    "I1",
    f"""WITH {_LINE}
    train AS (SELECT {KEYS}, regr_slope(cpu_usage, before) AS slope, regr_intercept(cpu_usage, before) AS level, count(*) AS n
      FROM timed WHERE before IS NOT NULL AND i - 1 <= floor((n - 1) * 0.8) GROUP BY ALL),
    held AS (SELECT {KEYS}, avg(abs(cpu_usage - (level + slope * before))) AS val_mae FROM timed JOIN train USING ({KEYS})
      WHERE i - 1 > floor((timed.n - 1) * 0.8) GROUP BY ALL)
    SELECT {KEYS}, n, {r('level', places=4)}, {r('slope', places=4)}, {r('val_mae', places=4)} FROM train LEFT JOIN held USING ({KEYS})""",
)
def one_step_regression(spark, sf_dir):
    """The sequence model with one feature, one row back and one step ahead is a regression on the row before."""
    rows = cleaned(spark, sf_dir).select(*SERIES, "ts", "cpu_usage")
    out = forecasting.fit_sequence(rows, SERIES, "ts", ["cpu_usage"], "cpu_usage", lookback=1, horizon=1, penalty=0.0)
    out = out.select(*SERIES, "n", F.get("coef", F.lit(0)).alias("level"), F.get("coef", F.lit(1)).alias("slope"), "val_mae")
    return rounded(out, 4)


_BINS, _MIN_ROWS, _RATE = 16, 5, 0.5


@query(
    "boosted_stump",
    "I1",
    f"""WITH {_LINE}
    train AS (SELECT {KEYS}, before::FLOAT::DOUBLE AS x, cpu_usage::FLOAT::DOUBLE AS y FROM timed WHERE before IS NOT NULL AND i - 1 <= floor((n - 1) * 0.8)),
    sized AS (SELECT {KEYS}, min(x) AS lo, max(x) AS hi, avg(y) AS base, count(*) AS n FROM train GROUP BY ALL),
    placed AS (SELECT {KEYS}, y - base AS g, 1 + len(list_filter(range(1, {_BINS}), lambda j: lo + (hi - lo) * j / {_BINS} < x)) AS b FROM train JOIN sized USING ({KEYS})),
    hist AS (SELECT {KEYS}, b, sum(g) AS g, count(*) AS c FROM placed GROUP BY ALL),
    upto AS (SELECT {KEYS}, b, sum(g) OVER u AS gl, sum(c) OVER u AS nl, sum(g) OVER whole AS ga, sum(c) OVER whole AS na
      FROM hist WINDOW whole AS (PARTITION BY {KEYS}), u AS (PARTITION BY {KEYS} ORDER BY b ROWS UNBOUNDED PRECEDING)),
    gains AS (SELECT *, round(gl * gl / (nl + 1) + (ga - gl) * (ga - gl) / (na - nl + 1) - ga * ga / (na + 1), 9) AS gain
      FROM upto WHERE nl >= {_MIN_ROWS} AND na - nl >= {_MIN_ROWS}),
    best AS (SELECT * FROM gains WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY gain DESC, b) = 1)
    SELECT {KEYS}, n, {r(f'lo + (hi - lo) * b / {_BINS}', 'threshold', 4)}, {r(f'base + {_RATE} * gl / (nl + 1)', 'below', 4)},
      {r(f'base + {_RATE} * (ga - gl) / (na - nl + 1)', 'above', 4)} FROM best JOIN sized USING ({KEYS})""",
)
def boosted_stump(spark, sf_dir):
    """One round of depth one on the row before is the best of the bins' cuts, with a shrunk mean on either side."""
    rows = cleaned(spark, sf_dir).select(*SERIES, "ts", "cpu_usage")
    model = boosting.fit_boosted_sequence(
        rows, SERIES, "ts", ["cpu_usage"], "cpu_usage", lookback=1, horizon=1, rounds=1, depth=1, bins=_BINS, rate=_RATE, min_rows=_MIN_ROWS, by="width"
    )
    tree = F.get("trees", F.lit(0))
    at = lambda part, i: F.get(tree[part], F.lit(i))
    out = model.select(
        *SERIES,
        "n",
        F.get(F.get("edges", at("f", 1)), at("b", 1) - 1).alias("threshold"),
        (F.col("base") + at("v", 2)).alias("below"),
        (F.col("base") + at("v", 3)).alias("above"),
    )
    return rounded(out.filter("threshold is not null"), 4)


@query("feature_forecast", "I1 F10 H1 H2 G6")
def feature_forecast(spark, sf_dir):
    """Boosted trees on all engineered features of the last rows, forecast in the target's own units."""
    made = flows.train_on_features(frame(spark, sf_dir), SERIES, "ts", lookback=2, horizon=2, rounds=6, depth=2)
    return flows.forecast_on_features(made, SERIES, "ts")


@query("sequence_error", "I1 I5 H3")
def sequence_error(spark, sf_dir):
    """Validation error of the sequence model on the last fifth of each series' samples."""
    return fitted_sequence(spark, sf_dir)[2].select(*SERIES, "n", "val_mae")


@query("model_round_trip", "A11")
def model_round_trip(spark, sf_dir):
    """Fit, write the coefficients, read them and score with what was read."""
    history = materialise(cleaned(spark, sf_dir).select(*SERIES, "ts", "cpu_usage"), "history")
    path = scratch_dir(spark, "model")
    files.save_model(forecasting.fit_seasonal(history, SERIES, "ts", "cpu_usage"), path)
    scored = forecasting.score_seasonal(history, files.load_model(spark, path), SERIES, "ts")
    return forecasting.mae(scored, SERIES, "cpu_usage", "yhat")


# -- ensemble ---------------------------------------------------------------------------

# Two simple forecasts of every step, for the ensemble to work on: the mean of the twelve
# rows before it, and the value twelve rows (a day) before it. Cycles are days.
PAIRS = f"""{CLEANED},
pairs AS (
  SELECT {KEYS}, date_trunc('day', ts)::TIMESTAMP AS cycle, (hour(ts) // 2 + 1)::INT AS h, ts, cpu_usage AS actual,
         avg(cpu_usage) OVER p AS seq_pred, lag(cpu_usage, 12) OVER o AS seasonal_pred,
         CASE WHEN namespace = 'prod' THEN lag(cpu_usage, 12) OVER o - coalesce(stddev_samp(cpu_usage) OVER p, 0) END AS lower,
         CASE WHEN namespace = 'prod' THEN lag(cpu_usage, 12) OVER o + coalesce(stddev_samp(cpu_usage) OVER p, 0) END AS upper
  FROM cleaned WINDOW p AS ({BY} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), o AS ({BY})
  QUALIFY seq_pred IS NOT NULL)"""
CYCLE = [*SERIES, "cycle"]
C = ", ".join(CYCLE)


def forecast_pairs(spark, sf_dir, clean=None):
    rows = (cleaned(spark, sf_dir) if clean is None else clean).select(*SERIES, "ts", "cpu_usage")
    mean, std = "cpu_usage_rolling_mean_12m", "cpu_usage_rolling_std_12m"
    rows = features.row_features(rows, SERIES, "ts", ["cpu_usage"], rolling=[12], lags=[12], slot_s=30 * 86400)
    rolled = materialise(rows, "rolled")
    rows = features.row_features(rolled, SERIES, "ts", [mean, std], lags=[1], slot_s=30 * 86400)
    seasonal, spread = F.col("lag_cpu_usage_12m"), F.col(f"lag_{std}_1m")
    prod = F.col("namespace") == "prod"
    out = rows.select(
        *SERIES,
        F.date_trunc("day", "ts").alias("cycle"),
        F.floor(F.hour("ts") / 2 + 1).cast("int").alias("h"),
        "ts",
        F.col("cpu_usage").alias("actual"),
        F.col(f"lag_{mean}_1m").alias("seq_pred"),
        seasonal.alias("seasonal_pred"),
        F.when(prod, seasonal - spread).alias("lower"),
        F.when(prod, seasonal + spread).alias("upper"),
    )
    made = materialise(out.filter("seq_pred is not null"), "forecast-pairs")
    release(rolled)
    return made


PAIR_COLS = ["seq_pred", "seasonal_pred", "lower", "upper", "actual"]


@query("forecast_pairs", "J1", f"WITH {PAIRS} SELECT {C}, h, ts, {rs(PAIR_COLS)} FROM pairs")
def pairs(spark, sf_dir):
    return rounded(forecast_pairs(spark, sf_dir))


@query(
    "pair_forecasts",
    "J1",
    f"""WITH {PAIRS}, a AS (SELECT {C}, h, seq_pred FROM pairs WHERE seq_pred IS NOT NULL),
    b AS (SELECT {C}, h, seasonal_pred FROM pairs WHERE seasonal_pred IS NOT NULL)
    SELECT {C}, h, {rs(['seq_pred', 'seasonal_pred'])} FROM a FULL JOIN b USING ({C}, h)""",
)
def pair_forecasts(spark, sf_dir):
    """Forecasts of two models that cover different steps, aligned."""
    rows = forecast_pairs(spark, sf_dir)
    a = rows.filter("seq_pred is not null").select(*CYCLE, "h", "seq_pred")
    b = rows.filter("seasonal_pred is not null").select(*CYCLE, "h", "seasonal_pred")
    return rounded(ensemble.pair_forecasts(a, b, [*CYCLE, "h"]))


BLENDED = f"""{PAIRS},
blended AS (SELECT *, CASE WHEN seasonal_pred IS NULL THEN seq_pred ELSE 0.6::DOUBLE * seq_pred + 0.4::DOUBLE * seasonal_pred END AS blended FROM pairs),
margins AS (SELECT {C}, CASE WHEN count(*) > 1 THEN stddev_pop(blended) * 1.96 ELSE 0.1 END AS margin FROM blended GROUP BY ALL),
banded AS (SELECT b.* EXCLUDE (lower, upper), coalesce(lower, blended - margin) AS lower, coalesce(upper, blended + margin) AS upper
  FROM blended b JOIN margins USING ({C}))"""


@query("blend", "J1", f"WITH {BLENDED} SELECT {C}, h, {rs(['blended'])} FROM blended")
def blend(spark, sf_dir):
    return rounded(ensemble.blend(forecast_pairs(spark, sf_dir)).select(*CYCLE, "h", "blended"))


@query("confidence_band", "J2", f"WITH {BLENDED} SELECT {C}, h, {rs(['lower', 'upper'])} FROM banded")
def confidence_band(spark, sf_dir):
    rows = ensemble.band(ensemble.blend(forecast_pairs(spark, sf_dir)), CYCLE)
    return rounded(rows.select(*CYCLE, "h", "lower", "upper"))


RESULTS = f"""{BLENDED},
results AS (
  SELECT {C}, greatest(0, least(1, exp(-avg(upper - lower) / (avg(abs(blended)) + 1e-8)))) AS confidence,
         max(blended::FLOAT)::DOUBLE AS predicted_peak, count(*) AS n,
         arg_min(blended::FLOAT, h)::DOUBLE AS first, arg_max(blended::FLOAT, h)::DOUBLE AS final
  FROM banded GROUP BY ALL),
predictions AS (
  SELECT *, greatest(2, least(50, ceil(predicted_peak / 0.7::DOUBLE)))::INT AS recommended_replicas,
         CASE WHEN n < 2 THEN 'low' WHEN abs(final - first) / (abs(first) + 1e-8) > 0.5 THEN 'high'
              WHEN abs(final - first) / (abs(first) + 1e-8) > 0.2 THEN 'medium' ELSE 'low' END AS urgency
  FROM results)"""


@query(
    "prediction_results",
    "J3 J6 J7",
    f"WITH {RESULTS} SELECT {C}, {rs(['confidence', 'predicted_peak', 'first', 'final'], 5)}, n::INT AS steps, recommended_replicas, urgency FROM predictions",
)
def prediction_results(spark, sf_dir):
    out = ensemble.combine(forecast_pairs(spark, sf_dir), CYCLE)
    values = F.col("predicted_values")
    return rounded(
        out.select(
            *CYCLE,
            "confidence",
            "predicted_peak",
            F.element_at(values, 1).cast("double").alias("first"),
            F.element_at(values, -1).cast("double").alias("final"),
            F.size(values).alias("steps"),
            "recommended_replicas",
            "urgency",
        ),
        5,
    )


ERRORS = f"""{PAIRS},
errors AS (SELECT {C}, avg(abs(actual - seq_pred)) AS seq_mae, avg(abs(actual - seasonal_pred)) AS seasonal_mae FROM pairs GROUP BY ALL)"""


@query("cycle_errors", "J4 I5", f"WITH {ERRORS} SELECT {C}, {rs(['seq_mae', 'seasonal_mae'])} FROM errors")
def cycle_errors(spark, sf_dir):
    return rounded(ensemble.cycle_errors(forecast_pairs(spark, sf_dir), CYCLE))


# Thirty days give no more than thirty cycles, so the check uses a history of seven errors.
WINDOW = 7


def _recent(model):
    return f"""avg({model}) FILTER ({model} IS NOT NULL) OVER (PARTITION BY {KEYS} ORDER BY cycle ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)"""


# The seasonal error is unknown only in a series' first cycle, so frames of rows are exact.
WEIGHTS = f"""{ERRORS},
recent AS (SELECT {C}, {_recent('seq_mae')} AS avg_seq_mae, {_recent('seasonal_mae')} AS avg_seasonal_mae FROM errors),
weights AS (
  SELECT *, coalesce((1 / (avg_seq_mae + 1e-8)) / (1 / (avg_seq_mae + 1e-8) + 1 / (avg_seasonal_mae + 1e-8)), 0.6) AS seq_weight,
         coalesce((1 / (avg_seasonal_mae + 1e-8)) / (1 / (avg_seq_mae + 1e-8) + 1 / (avg_seasonal_mae + 1e-8)), 0.4) AS seasonal_weight
  FROM recent)"""
W_COLS = ["avg_seq_mae", "avg_seasonal_mae", "seq_weight", "seasonal_weight"]


def weights_of(rows):
    errors = materialise(ensemble.cycle_errors(rows, CYCLE), "cycle-errors")
    return errors, ensemble.adaptive_weights(errors, SERIES, "cycle", window=WINDOW)


@query("adaptive_weights", "J4", f"WITH {WEIGHTS} SELECT {C}, {rs(W_COLS)} FROM weights")
def adaptive_weights(spark, sf_dir):
    return rounded(weights_of(forecast_pairs(spark, sf_dir))[1])


@query(
    "adapted_blend",
    "J1 J4",
    f"""WITH {WEIGHTS}, learned AS (SELECT {KEYS}, cycle + INTERVAL 1 DAY AS cycle, seq_weight, seasonal_weight FROM weights)
    SELECT {C}, h, {r('''CASE WHEN seasonal_pred IS NULL THEN seq_pred ELSE coalesce(seq_weight, 0.6) * seq_pred
    + coalesce(seasonal_weight, 0.4) * seasonal_pred END''', 'blended')} FROM pairs LEFT JOIN learned USING ({C})""",
)
def adapted_blend(spark, sf_dir):
    """Blend with the weights learned up to the day before."""
    rows = forecast_pairs(spark, sf_dir)
    weights = weights_of(rows)[1].withColumn("cycle", F.col("cycle") + F.make_dt_interval(F.lit(1)))
    return rounded(ensemble.blend(rows, weights, CYCLE).select(*CYCLE, "h", "blended"))


@query(
    "combiner_stats",
    "J5",
    f"""WITH {WEIGHTS}, sizes AS (SELECT {KEYS}, least(count(seq_mae), {WINDOW}) AS seq_history, least(count(seasonal_mae), {WINDOW}) AS seasonal_history
      FROM errors GROUP BY ALL),
    newest AS (SELECT * FROM weights QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY cycle DESC) = 1)
    SELECT {KEYS}, seq_history, seasonal_history, {rs(W_COLS)} FROM sizes JOIN newest USING ({KEYS})""",
)
def combiner_stats(spark, sf_dir):
    errors, weights = weights_of(forecast_pairs(spark, sf_dir))
    return rounded(ensemble.combiner_stats(errors, weights, SERIES, "cycle", WINDOW))

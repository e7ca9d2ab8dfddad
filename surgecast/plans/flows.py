"""The three end-to-end flows: prepare training data, train, and predict and decide."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boosting, cleaning, decisions, ensemble, features, forecasting, lifecycle, normalize, sequences
from ..operators.decisions import DecisionConfig, GuardConfig
from ..plans.blocks import join_series
from ..session import materialise, release
from . import model_store

#: Rows before the window that a prediction reads for interpolation.
HISTORY_ROWS = 240
CALENDAR = ["hour_sin", "hour_cos", "dow_sin", "dow_cos"]


@dataclass(frozen=True)
class Prepared:
    """Scaled feature rows, the fitted scaler parameters and the scaled columns."""

    rows: DataFrame
    params: DataFrame
    columns: list[str]


def prepare(
    frame: DataFrame,
    keys: Sequence[str],
    ts: str,
    *,
    method: str = "minmax",
    share: float = 0.8,
    fit_on_all: bool = False,
    min_ratio: float = cleaning.MIN_VALID_RATIO,
) -> Prepared:
    """Clean, derive features and scale.

    The scaler learns from the first ``share`` of each series only, so that validation rows
    do not leak into it; ``fit_on_all`` lets it see every row.
    """
    cleaned = cleaning.clean(frame, keys, ts, min_ratio=min_ratio)
    # Fitting and scaling both read the feature rows.
    featured = materialise(features.engineer(cleaned, keys, ts), "features")
    columns = cleaning.numeric_columns(featured, [*keys, ts])
    part = featured
    if not fit_on_all:
        part = sequences.chronological_split(featured, keys, ts, share=share).filter("is_train")
    params = materialise(normalize.fit(part, keys, columns, method), "scaler")
    return Prepared(normalize.transform(featured, params, keys, columns), params, columns)


@dataclass(frozen=True)
class TrainedOnFeatures:
    """Boosted trees per (series, step), with the prepared rows and scaler they read."""

    model: DataFrame
    prepared: Prepared
    target: str
    lookback: int
    horizon: int
    depth: int


def train_on_features(
    frame: DataFrame,
    keys: Sequence[str],
    ts: str,
    *,
    target: str = "cpu_usage",
    lookback: int = 60,
    horizon: int = 10,
    share: float = 0.8,
    depth: int = 3,
    **fit,
) -> TrainedOnFeatures:
    """Prepare, window and fit: the sequence model on every engineered feature.

    Cleaning limits, features and scaler come from the same ``prepare`` call that forecasts
    read, so both sides see rows treated alike.
    """
    made = prepare(frame, keys, ts, share=share)
    # Read for the windows of training and for those of forecasting.
    rows = materialise(made.rows, "prepared")
    model = boosting.fit_boosted_sequence(rows, keys, ts, made.columns, target, lookback=lookback, horizon=horizon, share=share, depth=depth, **fit)
    return TrainedOnFeatures(materialise(model, "boosted-model"), Prepared(rows, made.params, made.columns), target, lookback, horizon, depth)


def forecast_on_features(made: TrainedOnFeatures, keys: Sequence[str], ts: str) -> DataFrame:
    """The next steps of every series from its newest prepared rows: ``(series…, h, yhat)``."""
    windows = sequences.inference_window(made.prepared.rows, keys, ts, made.prepared.columns, lookback=made.lookback)
    steps = boosting.forecast_boosted(made.model, windows.withColumnRenamed(ts, "ts"), keys, horizon=made.horizon, depth=made.depth)
    arrays = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("h", "yhat"))).alias("_s"))
    arrays = arrays.select(*keys, F.transform("_s", lambda s: s["yhat"]).alias("_v"))
    back = normalize.inverse_transform_array(arrays, made.prepared.params, keys, "_v", made.target)
    return back.select(*keys, F.posexplode("_v").alias("_i", "yhat")).select(*keys, (F.col("_i") + 1).alias("h"), "yhat")


@dataclass(frozen=True)
class Trained:
    seasonal: DataFrame
    sequence: DataFrame
    scaler: DataFrame
    columns: list[str]
    registry: DataFrame
    summary: DataFrame
    #: ``(series…, column, lo, hi)``: what training clipped to, and forecasts clip to.
    limits: DataFrame | None = None


def train(
    frame: DataFrame,
    keys: Sequence[str],
    ts: str,
    *,
    target: str = "cpu_usage",
    lookback: int = 60,
    horizon: int = 10,
    min_hours: float = 72,
    share: float = 0.8,
    registry: DataFrame | None = None,
    base_path: str = "models",
    keep: int = lifecycle.KEEP_VERSIONS,
    store: bool = False,
    sparse_trend: bool = True,
) -> Trained:
    """Train both models for every series, register, promote and prune a version each.

    A series shorter than ``min_hours`` gets the seasonal model only. With ``store`` the
    coefficients, scalers and clipping limits are kept under ``base_path`` (see ``load``).
    """
    keys = list(keys)
    whole, kept = cleaning.without_gaps(frame, keys, ts)
    limits = materialise(cleaning.limit_rows(cleaning.clip_limits(whole, keys, kept), keys, kept), "limits")
    cleaned = materialise(cleaning.clip_to(whole, cleaning.limits_of(limits, keys, kept), keys, kept), "cleaned")
    release(whole)
    hours = forecasting.long_enough(cleaned, keys, ts, min_hours)

    seasonal = materialise(forecasting.fit_seasonal(cleaned, keys, ts, target, sparse=sparse_trend), "seasonal")

    columns = [c for c in features.PRIMARY_METRICS if c in cleaned.columns]
    columns = list(dict.fromkeys([target, *columns])) + CALENDAR
    eligible = cleaned.join(hours.filter("trains_sequence").select(*keys), keys, "left_semi")
    rows = materialise(features.add_calendar(eligible, ts).select(*keys, ts, *columns), "sequence-rows")
    flagged = sequences.chronological_split(rows, keys, ts, share=share).filter("is_train")
    scaler = materialise(normalize.fit(flagged, keys, columns), "sequence-scaler")
    scaled = materialise(normalize.transform(rows, scaler, keys, columns), "scaled-rows")
    release(rows)
    sequence = forecasting.fit_sequence(scaled, keys, ts, columns, target, lookback=lookback, horizon=horizon, share=share)
    release(scaled)

    fitted = hours.join(seasonal.select(*keys, F.col("mae").alias("_seasonal")), keys, "left")
    fitted = fitted.join(sequence.select(*keys, F.col("val_mae").alias("_sequence"), F.lit(True).alias("_has")), keys, "left")
    summary = fitted.select(
        *keys,
        F.coalesce("_has", F.lit(False)).alias("sequence_trained"),
        F.col("_seasonal").isNotNull().alias("seasonal_trained"),
        F.round("hours", 1).alias("training_hours"),
        F.col("_sequence").alias("sequence_val_mae"),
        F.col("_seasonal").alias("seasonal_mae"),
    )
    summary = materialise(summary, "training-summary")
    names = ["sequence_trained", "seasonal_trained", "training_hours", "sequence_val_mae", "seasonal_mae"]
    newest = cleaned.groupBy(*keys).agg(F.max(ts).alias("created_at"))
    metrics = F.create_map(*[part for n in names for part in (F.lit(n), F.col(n).cast("string"))])
    runs = summary.join(newest, keys).select(*keys, "created_at", metrics.alias("metrics"))
    versions = materialise(lifecycle.create_versions(registry, runs, keys, base_path), "versions")
    release(cleaned)
    newest_version = lifecycle.latest_choice(versions, keys)
    if store:
        model_store.publish({"seasonal": seasonal, "sequence": sequence, "scaler": scaler, "limits": limits}, newest_version, keys, base_path)
    versions = lifecycle.promote(versions, newest_version, keys)
    versions = materialise(lifecycle.prune(versions, keys, keep), "registry")
    return Trained(seasonal, sequence, scaler, columns, versions, summary, limits)


def load(registry: DataFrame, keys: Sequence[str], base_path: str, columns: Sequence[str]) -> Trained:
    """The stored models of every series' active version, as the last commit left them (see ``model_store``).

    The set of runs is fixed here; what is published later is seen by the next call.
    """
    spark = registry.sparkSession
    active = lifecycle.active_versions(registry).select(*keys, "version")
    wanted = materialise(join_series(model_store.manifest(spark, keys, base_path), active, [*keys, "version"], "inner"), "wanted")

    def part(name: str) -> DataFrame:
        return model_store.stored(spark, name, wanted, keys, base_path)

    # Models stored before limits were have none.
    limits = part("limits") if model_store.children(spark, f"{base_path}/limits") else None
    return Trained(part("seasonal"), part("sequence"), part("scaler"), list(columns), registry, registry.select(*keys).distinct(), limits)


def tick(
    frame: DataFrame,
    keys: Sequence[str],
    ts: str,
    models: Trained,
    replicas: DataFrame,
    *,
    last_executed: DataFrame | None = None,
    weights: DataFrame | None = None,
    config: DecisionConfig = DecisionConfig(),
    guard: GuardConfig = GuardConfig(),
    **predicting,
) -> DataFrame:
    """One control cycle: predict, decide, guard. One row per series with ``executed``.

    ``weights`` are those of each series' last cycle (``ensemble.latest_weights``) and
    ``last_executed(series…, last_executed)`` its last action. ``decisions.actions`` lists
    what to carry out; executed rows are the events that the next cycle needs.
    """
    made = predict(frame, keys, ts, models, weights=weights, **predicting)
    decided = decide(made, replicas, keys, config)
    return decisions.guard_now(decided, last_executed, keys, "cycle", guard)


def predict(
    frame: DataFrame,
    keys: Sequence[str],
    ts: str,
    models: Trained,
    *,
    target: str = "cpu_usage",
    step_s: int = 60,
    lookback: int = 60,
    horizon: int = 10,
    weights: DataFrame | None = None,
) -> DataFrame:
    """One prediction result per series for the steps after its last row.

    Recent rows are clipped to the limits of the series' training; models without them take
    the limits of the recent rows themselves.
    """
    keys = list(keys)
    # The rows that the window and the gaps around it can reach; the models know the rest.
    ends = frame.groupBy(*keys).agg(F.max(ts).alias("_end"))
    reach = F.col("_end") - F.make_interval(secs=F.lit(step_s * (lookback + HISTORY_ROWS)).cast("decimal(18,6)"))
    recent = join_series(frame, ends, keys).filter(F.col(ts) >= reach).drop("_end")
    filled, kept = cleaning.without_gaps(recent, keys, ts, slot_s=7 * 86400)
    known = cleaning.clip_limits(filled, keys, kept) if models.limits is None else cleaning.limits_of(models.limits, keys, kept)
    cleaned = materialise(cleaning.clip_to(filled, known, keys, kept), "recent")
    release(filled)
    last = cleaned.groupBy(*keys).agg(F.max(ts).alias("cycle"))
    grid = last.withColumnRenamed("cycle", ts)
    seasonal = forecasting.forecast_seasonal(models.seasonal, grid, keys, ts, step_s=step_s, horizon=horizon)
    seasonal = seasonal.select(
        *keys, "h", F.col("yhat").alias("seasonal_pred"), F.col("yhat_lower").alias("lower"), F.col("yhat_upper").alias("upper")
    )
    scaled = normalize.transform(features.add_calendar(cleaned, ts), models.scaler, keys, models.columns)
    # Written before the coefficients meet them, which are larger by far.
    windows = materialise(sequences.inference_window(scaled, keys, ts, models.columns, lookback=lookback).withColumnRenamed(ts, "ts"), "windows")
    steps = forecasting.forecast_sequence(models.sequence, windows, keys, horizon)
    arrays = steps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("h", "yhat"))).alias("_s"))
    arrays = arrays.select(*keys, F.transform("_s", lambda s: s["yhat"]).alias("v"))
    back = normalize.inverse_transform_array(arrays, models.scaler, keys, "v", target)
    sequence = back.select(*keys, F.posexplode("v").alias("_i", "seq_pred")).select(*keys, (F.col("_i") + 1).alias("h"), "seq_pred")
    both = ensemble.pair_forecasts(sequence, seasonal, [*keys, "h"]).join(last, keys)
    return ensemble.combine(both, [*keys, "cycle"], weights, keys)


def decide(predictions: DataFrame, replicas: DataFrame, keys: Sequence[str], config: DecisionConfig = DecisionConfig()) -> DataFrame:
    """Decisions for prediction results, given ``replicas(series…, current_replicas)``.

    A series without a replica count is held and not approved.
    """
    rows = join_series(predictions, replicas.select(*keys, "current_replicas"), keys)
    return decisions.decide(rows, config)

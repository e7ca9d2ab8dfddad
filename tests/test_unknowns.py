"""Nothing is lost or invented where inputs are unknown."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from conftest import service_minutes
from pyspark.sql import functions as F

from surgecast.operators import cleaning, decisions, ensemble, features, fetch, forecasting, lifecycle, normalize
from surgecast.sources import files, tables

T0 = datetime(2026, 1, 1)
NAN = float("nan")


@pytest.mark.parametrize("peak,conf,current", [(None, 0.9, 3), (NAN, 0.9, 3), (9.0, None, 3), (9.0, NAN, 3), (9.0, 0.9, None)])
def test_unknown_inputs_hold(spark, peak, conf, current):
    rows = spark.createDataFrame([("a", T0, peak, conf, current)], "s string, ts timestamp, predicted_peak double, confidence double, current_replicas int")
    out = decisions.decide(rows).first()
    assert (out["direction"], out["approved"], out["target_replicas"]) == ("none", False, current)
    assert "unknown" in out["reason"]
    ran = decisions.guard_decisions(decisions.decide(rows), ["s"], "ts").first()
    assert not ran["executed"] and not ran["approved"]


def test_unknown_peak_needs_nothing(spark):
    out = spark.range(1).select(*[ensemble.replicas_for(F.lit(v).cast("double")).alias(n) for n, v in (("null", None), ("nan", NAN), ("low", 0.1))]).first()
    assert (out["null"], out["nan"], out["low"]) == (None, None, 2)


def test_a_metric_missing_in_one_series(spark):
    pdf = pd.concat([service_minutes(200), service_minutes(200, seed=5).assign(s="b", error_rate=np.nan)])
    df = spark.createDataFrame(pdf).withColumn("error_rate", F.nanvl("error_rate", F.lit(None)))
    out = features.engineer(cleaning.clean(df, ["s"], "ts"), ["s"], "ts")
    got = out.groupBy("s").agg(F.count("*").alias("n"), F.count("cpu_usage_ema_30").alias("cpu"), F.count("error_rate_ema_30").alias("errors"), F.count("lag_error_rate_60m").alias("lags"))
    assert {r["s"]: tuple(r)[1:] for r in got.collect()} == {"a": (140, 140, 140, 140), "b": (140, 140, 0, 0)}


def test_sparse_column_of_one_series_is_masked(spark):
    rows = [("a", T0 + timedelta(minutes=i), 1.0 * i) for i in range(10)] + [("b", T0 + timedelta(minutes=i), 5.0 if i == 3 else None) for i in range(10)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, v double")
    out = cleaning.clean(df, ["s"], "ts")
    assert {r["s"]: r["n"] for r in out.groupBy("s").agg(F.count("v").alias("n")).collect()} == {"a": 10, "b": 0}


def test_grid_keeps_a_sample_on_its_first_point(spark):
    rows = [("a", T0, 1.0), ("a", T0 + timedelta(minutes=2), 2.0)]
    out = fetch.range_fetch(spark.createDataFrame(rows, "s string, ts timestamp, value double"), ["s"], "ts", "value", step_s=60)
    assert [(r["ts"].minute, r["value"]) for r in out.orderBy("ts").collect()] == [(0, 1.0), (1, 1.0), (2, 2.0)]


def test_long_grid_is_whole(spark):
    rows = [("a", T0, 1.0), ("a", T0 + timedelta(seconds=2500), 2.0)]
    out = fetch.grid_points(spark.createDataFrame(rows, "s string, ts timestamp, value double"), ["s"], "ts", 1)
    assert out.count() == out.distinct().count() == 2501


def test_backfill_carries_values_into_its_first_step(spark):
    rows = [("a", "m", T0 - timedelta(hours=1, minutes=30), 1.0), ("a", "m", T0 - timedelta(minutes=10), 2.0)]
    df = spark.createDataFrame(rows, "s string, metric string, ts timestamp, value double")
    out = fetch.backfill(df, ["s"], ["m"], as_of_time=T0, hours=1, step_s=1800)
    assert [r["m"] for r in out.orderBy("ts").collect()] == [1.0, 1.0, 2.0]


def test_null_series_key(spark):
    rows = [(k, T0 + timedelta(minutes=i), float(i)) for k in ("a", None) for i in range(5)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, v double")
    assert cleaning.clip_outliers(df, ["s"], ["v"]).count() == 10
    assert normalize.fit_transform(df, ["s"], ["v"])[0].filter("v is not null").count() == 10
    assert tables.fill_grid(df, ["s"], "ts", 60).filter("v is not null").count() == 10
    with pytest.raises(Exception, match="must not be NULL"):
        cleaning.interpolate(df, ["s"], "ts", ["v"]).collect()


def test_series_without_scaler_row_stays(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "s string, v double")
    params = normalize.fit(df.filter("s = 'a'"), ["s"], ["v"])
    assert sorted((r["s"], r["v"]) for r in normalize.transform(df, params, ["s"], ["v"]).collect() if r["v"] is not None) == [("a", 0.0), ("a", 1.0)]
    assert normalize.transform(df, params, ["s"], ["v"]).count() == 3


def trend_rows(spark, keys=("a",), n=300, value=lambda i: 0.02 * i - 3.0):
    rows = [(k, T0 + timedelta(hours=i), value(i)) for k in keys for i in range(n)]
    return spark.createDataFrame(rows, "s string, ts timestamp, v double")


def test_season_fit_uses_rows_where_the_trend_is_zero(spark):
    model = forecasting.fit_seasonal(trend_rows(spark), ["s"], "ts", "v").first()
    assert model["n"] == 300 and model["mae"] < 0.05


def test_seasonal_switches_make_a_straight_line(spark):
    df = trend_rows(spark, value=lambda i: 5.0 + 0.01 * i + (i % 7) * 0.1)
    model = forecasting.fit_seasonal(df, ["s"], "ts", "v", changepoints=0, daily=0, weekly=0)
    got = forecasting.score_seasonal(df.select("s", "ts"), model, ["s"], "ts").orderBy("ts").toPandas()["yhat"]
    v = df.orderBy("ts").toPandas()["v"]
    slope, level = np.polyfit(np.arange(300), v, 1)
    np.testing.assert_allclose(got, level + slope * np.arange(300), atol=1e-6)


def test_unknown_features_do_not_stop_training(spark):
    rng = np.random.default_rng(0)
    rows = [("a", T0 + timedelta(minutes=i), float(rng.normal()), None if i == 50 else 1.0) for i in range(200)]
    rows += [("b", T0 + timedelta(minutes=i), float(rng.normal()), None) for i in range(200)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, v double, w double")
    model = {r["s"]: r["n"] for r in forecasting.fit_sequence(df, ["s"], "ts", ["v", "w"], "v", lookback=5, horizon=2).collect()}
    assert model["a"] == int(194 * 0.8) - 5 and model.get("b", 0) == 0


def test_many_short_blocks(spark):
    df = trend_rows(spark, n=4000, value=lambda i: float(np.sin(i / 9)))
    a = forecasting.fit_sequence(df, ["s"], "ts", ["v"], "v", lookback=2, horizon=1, block_rows=3).first()
    b = forecasting.fit_sequence(df, ["s"], "ts", ["v"], "v", lookback=2, horizon=1, block_rows=4096).first()
    assert a["n"] == b["n"]
    np.testing.assert_allclose(a["coef"], b["coef"], rtol=1e-6)


def test_numbers_go_on_after_pruning(spark):
    kept = None
    for i in range(8):
        run = spark.createDataFrame([("a", T0 + timedelta(days=i), {"mae": "0.1"})], "s string, created_at timestamp, metrics map<string,string>")
        kept = lifecycle.create_versions(kept, run, ["s"], "models")
        kept = lifecycle.promote(kept, lifecycle.latest_choice(kept, ["s"]), ["s"])
        kept = spark.createDataFrame(lifecycle.prune(kept, ["s"]).collect(), kept.schema)
    assert sorted((r["n"], r["is_active"]) for r in kept.collect()) == [(4, False), (5, False), (6, False), (7, False), (8, True)]


def test_weights_of_the_last_cycle_keep_one_row_for_each_step(spark):
    weights = spark.createDataFrame([("a", T0, 0.5, 0.5), ("a", T0 + timedelta(days=1), 0.2, 0.8)], "s string, cycle timestamp, seq_weight double, seasonal_weight double")
    pairs = spark.createDataFrame([("a", h, 1.0, 2.0) for h in (1, 2)], "s string, h int, seq_pred double, seasonal_pred double")
    out = ensemble.blend(pairs, ensemble.latest_weights(weights, ["s"], "cycle"), ["s"]).collect()
    assert [r["blended"] for r in out] == [pytest.approx(1.8)] * 2
    assert ensemble.latest_weights(weights, ["s"], "cycle", T0 + timedelta(days=1)).first()["seq_weight"] == 0.5


def test_nan_text_is_null(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    with open(path, "w") as f:
        f.write("timestamp,v\n2026-01-01 00:00:00,NaN\n2026-01-01 00:01:00,2.5\n")
    out = files.read_metrics_csv(spark, path, files.metrics_schema([], ["v"])).orderBy("timestamp").collect()
    assert [r["v"] for r in out] == [None, 2.5]

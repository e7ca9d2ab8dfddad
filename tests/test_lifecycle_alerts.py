from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from surgecast.operators import alerts, lifecycle

T0 = datetime(2026, 1, 1)
RUN = "s string, created_at timestamp, metrics map<string,string>"


def runs(spark, n, s="a", start=0):
    return spark.createDataFrame([(s, T0 + timedelta(hours=start + i), {"mae": "0.1"}) for i in range(n)], RUN)


def registry(spark, n):
    return lifecycle.create_versions(None, runs(spark, n), ["s"], "models")


def test_create_numbers_on(spark):
    reg = lifecycle.create_versions(registry(spark, 2), runs(spark, 1, start=9), ["s"], "models")
    got = [r["version"] for r in lifecycle.list_versions(reg, ["s"]).collect()]
    assert got == ["v1_20260101_000000", "v2_20260101_010000", "v3_20260101_090000"]


def choose(spark, version):
    return spark.createDataFrame([("a", version)], "s string, version string")


def test_promote(spark):
    reg = lifecycle.promote(registry(spark, 2), choose(spark, "v2_20260101_010000"), ["s"])
    assert [r["version"] for r in lifecycle.active_versions(reg).collect()] == ["v2_20260101_010000"]
    with pytest.raises(KeyError):
        lifecycle.promote(reg, choose(spark, "v9"), ["s"])


@pytest.mark.parametrize("active,mae,hours,want", [(False, 0.1, 1, True), (True, 0.5, 1, True), (True, 0.1, 1, False), (True, 0.1, 60, True)])
def test_retrain(spark, active, mae, hours, want):
    reg = registry(spark, 1)
    reg = lifecycle.promote(reg, lifecycle.latest_choice(reg, ["s"]), ["s"]) if active else reg
    current = spark.createDataFrame([("a", mae)], "s string, mae double")
    row = lifecycle.retrain_check(reg, current, ["s"], T0 + timedelta(hours=hours)).first()
    assert row["retrain"] is want


@pytest.mark.parametrize("n,active,left", [(10, 1, {1, 9, 10}), (10, 10, {8, 9, 10}), (10, None, {9, 10}), (3, None, {1, 2, 3}), (3, 1, {1, 2, 3})])
def test_prune(spark, n, active, left):
    reg = registry(spark, n).withColumn("is_active", F.lit(False) if active is None else F.col("n") == active)
    assert {r["n"] for r in lifecycle.prune(reg, ["s"], keep=3).collect()} == left


@pytest.mark.parametrize("slot_s", [180, 86400])
def test_held_for(spark, slot_s):
    on = [0, 1, 1, 1, 0, 1, 1, 1, 1, 1, 1, 0, None, 1]
    df = spark.createDataFrame([("a", T0 + timedelta(minutes=i), v) for i, v in enumerate(on)], "s string, ts timestamp, v int")
    held = alerts.held_for(df, ["s"], "ts", F.col("v") == 1, 240, slot_s=slot_s)
    got = alerts.alert_intervals(held, ["s"], "ts", "x", "warning").collect()
    minute = lambda t: (t - T0).total_seconds() / 60
    assert [(minute(r["active_since"]), minute(r["fired_at"]), minute(r["last_seen"])) for r in got] == [(5, 9, 10)]


def test_alert_rows(spark):
    df = spark.createDataFrame(
        [("a", T0, 2, 5, "up", 0.914, 0.3), ("a", T0, 5, 3, "down", 0.4, 0.1)],
        "s string, ts timestamp, current_replicas int, target_replicas int, direction string, confidence double, mae double",
    )
    up, down = alerts.scaling_alerts(df, ["s"], "ts").collect()
    assert up["title"] == "Scaling UP: 2 → 5 replicas" and up["severity"] == "info" and up["metadata"]["Confidence"] == "91.4%"
    assert down["severity"] == "warning"
    assert alerts.drift_alerts(df, ["s"], "ts").first()["metadata"] == {"Current MAE": "0.3000", "Threshold": "0.2000"}
    assert alerts.confidence_alerts(df, ["s"], "ts").first()["message"] == "Prediction confidence has dropped to 40.0%."


def test_prediction_history_uses_only_later_values(spark):
    pred = spark.createDataFrame([("a", T0, 5.0), ("a", T0 + timedelta(hours=3), 5.0)], "s string, ts timestamp, p double")
    actual = spark.createDataFrame(
        [("a", T0 + timedelta(minutes=m), float(v)) for m, v in [(0, 99), (10, 1), (60, 7), (61, 50), (181, 3)]],
        "s string, ts timestamp, y double",
    )
    for width in (3600, 86400):
        out = alerts.prediction_history(pred, actual, ["s"], "ts", "y", 3600, block_s=width).orderBy("ts").collect()
        assert [r["actual_peak"] for r in out] == [7.0, 3.0]

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surgecast.operators import decisions, ensemble
from surgecast.operators.decisions import DecisionConfig, GuardConfig

SCHEMA = "s string, cycle timestamp, h int, seq_pred double, seasonal_pred double, lower double, upper double, actual double"
T0 = datetime(2026, 1, 1)


def pair_rows(seq, seasonal, lower=None, upper=None, actual=None, cycle=T0):
    n = len(seq if seq is not None else seasonal)
    pick = lambda a, i: None if a is None else float(a[i])
    return [("a", cycle, i + 1, pick(seq, i), pick(seasonal, i), pick(lower, i), pick(upper, i), pick(actual, i)) for i in range(n)]


def pairs(spark, *args, **kwargs):
    return spark.createDataFrame(pair_rows(*args, **kwargs), SCHEMA)


def test_blend_weights(spark):
    out = ensemble.combine(pairs(spark, [1, 2, 3], [1.5, 2.5, 3.5]), ["s", "cycle"]).first()
    np.testing.assert_allclose(out["predicted_values"], [1.2, 2.2, 3.2], rtol=1e-6)
    assert 0 <= out["confidence"] <= 1


@pytest.mark.parametrize("seq,seasonal", [([1, 2, 3], None), (None, [1, 2, 3])])
def test_single_model_passes_through(spark, seq, seasonal):
    out = ensemble.combine(pairs(spark, seq, seasonal), ["s", "cycle"]).first()
    np.testing.assert_allclose(out["predicted_values"], [1, 2, 3])
    margin = np.std([1, 2, 3]) * 1.96
    np.testing.assert_allclose(out["band_upper"], np.array([1, 2, 3]) + margin, rtol=1e-6)


def test_single_step_margin(spark):
    out = ensemble.combine(pairs(spark, [2.0], None), ["s", "cycle"]).first()
    assert out["band_lower"][0] == pytest.approx(1.9) and out["urgency"] == "low"


def test_no_model_is_an_error(spark):
    rows = pairs(spark, [1.0], None).withColumn("seq_pred", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="without any forecast"):
        ensemble.blend(rows).collect()


def test_given_band_and_confidence(spark):
    mid = [0.38, 0.42, 0.48, 0.53, 0.58]
    out = ensemble.combine(
        pairs(spark, mid, mid, [v - 0.05 for v in mid], [v + 0.05 for v in mid]), ["s", "cycle"]
    ).first()
    assert out["confidence"] == pytest.approx(np.exp(-0.1 / (np.mean(mid) + 1e-8)))


@pytest.mark.parametrize("values,want", [([1, 1.6], "high"), ([1, 1.3], "medium"), ([1, 1.1], "low"), ([0, 1], "high")])
def test_urgency(spark, values, want):
    assert ensemble.combine(pairs(spark, values, None), ["s", "cycle"]).first()["urgency"] == want


def test_replicas_go_through_float32(spark):
    """6.3 / 0.7 is 9 in doubles; the forecast's 32-bit 6.3 is a little more."""
    assert ensemble.combine(pairs(spark, [6.3, 6.0], None), ["s", "cycle"]).first()["recommended_replicas"] == 10
    direct = spark.range(1).select(ensemble.replicas_for(F.lit(6.3)).alias("r"), ensemble.replicas_for(F.lit(6.3), 0.0).alias("z"))
    assert direct.first()["r"] == 9 and direct.first()["z"] == 2


def test_weights_adapt(spark):
    rows = []
    rng = np.random.default_rng(1)
    errors = []
    for i in range(45):
        actual = rng.normal(10, 1, 4)
        a, b = actual + rng.normal(0, 0.1, 4), actual + rng.normal(0, 1, 4)
        rows += pair_rows(a, None if i in (0, 20) else b, actual=actual, cycle=T0 + timedelta(hours=i))
        errors.append((np.abs(actual - a).mean(), None if i in (0, 20) else np.abs(actual - b).mean()))
    out = ensemble.adaptive_weights(ensemble.cycle_errors(spark.createDataFrame(rows, SCHEMA), ["s", "cycle"]), ["s"], "cycle", slot_s=6 * 3600)
    got = out.orderBy("cycle").toPandas()
    hist_a, hist_b = [], []
    for (ea, eb), (_, row) in zip(errors, got.iterrows()):
        hist_a.append(ea)
        if eb is not None:
            hist_b.append(eb)
        if not hist_b:
            assert row["seq_weight"] == 0.6
            continue
        ia, ib = 1 / (np.mean(hist_a[-30:]) + 1e-8), 1 / (np.mean(hist_b[-30:]) + 1e-8)
        assert row["seq_weight"] == pytest.approx(ia / (ia + ib))
        assert row["seq_weight"] + row["seasonal_weight"] == pytest.approx(1)
    assert got["seq_weight"].iloc[-1] > 0.6


CASES = [
    (3.5, 0.9, 2, DecisionConfig(confidence_threshold=0.5), "up", 5, True),
    (1.4, 0.9, 5, DecisionConfig(dead_band=0, confidence_threshold=0.5), "down", 2, True),
    (5.0, 0.3, 2, DecisionConfig(confidence_threshold=0.8), "none", 2, False),
    (2.1, 0.9, 2, DecisionConfig(dead_band=2, confidence_threshold=0.5), "none", 2, True),
    (0.1, 0.9, 5, DecisionConfig(min_replicas=3, dead_band=0, confidence_threshold=0.5), "down", 3, True),
    (100.0, 0.9, 5, DecisionConfig(max_replicas=10, dead_band=0, confidence_threshold=0.5), "up", 10, True),
    (9.0, 0.9, 4, DecisionConfig(target_utilization=0.0, confidence_threshold=0.5), "none", 4, True),
    (0.1, 0.9, 1, DecisionConfig(confidence_threshold=0.5), "none", 1, True),
]


@pytest.mark.parametrize("peak,conf,current,config,direction,target,approved", CASES)
def test_decide(spark, peak, conf, current, config, direction, target, approved):
    df = spark.createDataFrame([(peak, conf, current)], "predicted_peak double, confidence double, current_replicas int")
    row = decisions.decide(df, config).first()
    assert (row["direction"], row["target_replicas"], row["approved"]) == (direction, target, approved)


def test_reasons(spark):
    df = spark.createDataFrame(
        [(3.5, 0.9, 2), (3.5, 0.3, 2), (1.4, 0.9, 2)], "predicted_peak double, confidence double, current_replicas int"
    )
    got = [r["reason"] for r in decisions.decide(df).collect()]
    assert got == [
        "Predicted peak 3.50 requires 5 replicas (target util 70%), currently 2",
        "Prediction confidence (0.30) below threshold (0.7)",
        "Target (2) within dead-band of current (2)",
    ]


def test_what_if_matches_single_decisions(spark):
    df = spark.createDataFrame([(3.5, 0.6, 2), (9.0, 0.9, 2)], "predicted_peak double, confidence double, current_replicas int")
    configs = [("a", DecisionConfig()), ("b", DecisionConfig(confidence_threshold=0.5, max_replicas=6))]
    got = {(r["config"], r["predicted_peak"]): (r["direction"], r["target_replicas"]) for r in decisions.what_if(df, configs).collect()}
    for name, c in configs:
        for r in decisions.decide(df, c).collect():
            assert got[name, r["predicted_peak"]] == (r["direction"], r["target_replicas"])


def decision_rows(n=600, seed=5, seconds=45.0):
    rng = np.random.default_rng(seed)
    s = rng.choice(["hot", "b", "c"], n, p=[0.5, 0.25, 0.25])
    us = 1_770_000_000_000_000 + np.cumsum(rng.integers(1, int(2 * seconds), n)) * 1_000_000
    direction = rng.choice(["none", "up", "down"], n, p=[0.3, 0.4, 0.3])
    current = rng.integers(2, 30, n)
    step = rng.integers(1, 12, n)
    target = np.where(direction == "up", current + step, np.where(direction == "down", current - step, current))
    return pd.DataFrame(
        {
            "s": s,
            "ts": pd.to_datetime(us, unit="us"),
            "us": us,
            "predicted_peak": 1.0,
            "confidence": 0.9,
            "current_replicas": current.astype("int32"),
            "target_replicas": target.astype("int32"),
            "direction": direction,
            "reason": "r",
            "approved": True,
        }
    )


def brute_force(pdf, guard):
    out = {}
    for s, g in pdf.sort_values("us").groupby("s"):
        last = None
        for r in g.itertuples():
            target, ok, ran = r.target_replicas, r.approved, False
            if r.direction != "none":
                ok = last is None or r.us - last >= guard.cooldown_s * 1_000_000
                if ok:
                    diff = target - r.current_replicas
                    target = r.current_replicas + max(-guard.max_down, min(guard.max_up, diff))
                    ran, last = True, r.us
            out[s, r.us] = (target, ok, ran)
    return out


@pytest.mark.parametrize("slot_s", [120, 1800, 10 * 86400])
@pytest.mark.parametrize("cooldown", [0, 120, 900])
def test_guard_equals_one_pass(spark, slot_s, cooldown):
    pdf = decision_rows()
    guard = GuardConfig(cooldown_s=cooldown)
    got = decisions.guard_decisions(spark.createDataFrame(pdf), ["s"], "ts", guard, slot_s=slot_s).toPandas()
    want = brute_force(pdf, guard)
    assert len(got) == len(pdf)
    for r in got.itertuples():
        assert (r.target_replicas, r.approved, r.executed) == want[r.s, r.us]
    blocked = got[(got["direction"] != "none") & ~got["approved"]]
    assert blocked["reason"].str.contains("BLOCKED: cooldown").all()


def test_cooldown_over_long_stretches_without_a_pause(spark):
    """Chains of over a thousand actions, repeated instants and candidates at exactly one cooldown."""
    rng = np.random.default_rng(4)
    us = np.concatenate([rng.integers(0, 4_000, 6_000), np.arange(10_000, 11_500, 3), np.full(50, 20_000)]) * 1_000_000
    pdf = pd.DataFrame({"s": np.where(rng.random(len(us)) < 0.9, "a", "b"), "ts": pd.to_datetime(us, unit="us"), "us": us})
    got = decisions.executed_times(spark.createDataFrame(pdf[["s", "ts"]]), ["s"], "ts", 3, slot_s=3600).toPandas()
    want = []
    for s, g in pdf.groupby("s"):
        last = None
        for t in sorted(set(g["us"])):
            if last is None or t - last >= 3_000_000:
                want.append((s, pd.Timestamp(t, unit="us")))
                last = t
    assert len(want) > 2_000
    assert sorted(zip(got["s"], got["ts"])) == sorted(want)


def test_rate_limit_cases(spark):
    pdf = decision_rows(2).assign(s=["a", "b"], current_replicas=[2, 10], target_replicas=[10, 3], direction=["up", "down"])
    pdf = pdf.astype({"current_replicas": "int32", "target_replicas": "int32"})
    out = decisions.guard_decisions(spark.createDataFrame(pdf), ["s"], "ts", GuardConfig(max_up=3)).orderBy("s").collect()
    assert [r["target_replicas"] for r in out] == [5, 8]
    assert [r["target_replicas"] for r in decisions.rate_limit(spark.createDataFrame(pdf)).orderBy("s").collect()] == [7, 8]


def test_history_and_status(spark):
    guard = GuardConfig(cooldown_s=120)
    rows = decisions.guard_decisions(spark.createDataFrame(decision_rows()), ["s"], "ts", guard)
    history = decisions.event_history(rows, ["s"], "ts", limit=5).groupBy("s").count().collect()
    assert all(r["count"] == 5 for r in history)
    last = {r["s"]: r["t"] for r in rows.filter("executed").groupBy("s").agg(F.max("ts").alias("t")).collect()}
    at = max(last.values()) + timedelta(seconds=30)
    for r in decisions.guard_status(rows, ["s"], "ts", at, guard).collect():
        assert r["seconds_until_ready"] == pytest.approx(max(0.0, 120 - (at - last[r["s"]]).total_seconds()))
        assert r["total_events"] <= 100
    todo = decisions.actions(rows, ["s"], "ts")
    assert todo.filter("target_replicas = current_replicas").count() == 0

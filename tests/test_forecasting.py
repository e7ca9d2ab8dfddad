import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surgecast.operators import decisions, forecasting, sequences
from surgecast.operators.cleaning import OUTLIER_STD
from surgecast.plans import flows

STEP = 3600


def seasonal_frame(n=24 * 21):
    t = np.arange(n)
    out = []
    for s, level in (("a", 10.0), ("b", 40.0)):
        trend = level + 0.01 * t
        y = trend * (1 + 0.3 * np.sin(2 * np.pi * t / 24) + 0.1 * np.cos(2 * np.pi * t / 168))
        out.append(pd.DataFrame({"s": s, "ts": pd.date_range("2026-03-02", periods=n, freq="h"), "cpu_usage": y, "ready_replicas": 3.0}))
    return pd.concat(out)


@pytest.fixture(scope="module")
def history(spark):
    pdf = seasonal_frame()
    return pdf, spark.createDataFrame(pdf)


def test_seasonal_model_recovers_signal(history):
    pdf, df = history
    cut = pdf["ts"].min() + pd.Timedelta(hours=24 * 20)
    model = forecasting.fit_seasonal(df.filter(F.col("ts") < cut), ["s"], "ts", "cpu_usage", slot_s=5 * 86400)
    assert all(r["mae"] < 0.3 and r["n"] == 480 for r in model.collect())
    last = df.filter(F.col("ts") < cut).groupBy("s").agg(F.max("ts").alias("ts"))
    out = forecasting.forecast_seasonal(model, last, ["s"], "ts", step_s=STEP, horizon=10)
    joined = out.join(df, ["s", "ts"]).toPandas()
    assert len(joined) == 20
    assert (abs(joined["yhat"] - joined["cpu_usage"]) / joined["cpu_usage"]).max() < 0.05
    assert (joined["yhat_lower"] < joined["yhat"]).all() and (joined["yhat"] < joined["yhat_upper"]).all()


def test_slot_length_does_not_change_the_fit(history):
    _, df = history
    a = forecasting.fit_seasonal(df, ["s"], "ts", "cpu_usage", slot_s=86400).orderBy("s").collect()
    b = forecasting.fit_seasonal(df, ["s"], "ts", "cpu_usage", slot_s=400 * 86400).orderBy("s").collect()
    for x, y in zip(a, b):
        assert x["sigma"] == pytest.approx(y["sigma"], rel=1e-4)


@pytest.mark.parametrize("block_rows", [40, 4096])
def test_sequence_model_equals_direct_solve(history, block_rows):
    pdf, df = history
    L, H = 12, 4
    model = forecasting.fit_sequence(
        df, ["s"], "ts", ["cpu_usage"], "cpu_usage", lookback=L, horizon=H, penalty=1e-2, slot_s=86400, block_rows=block_rows
    ).collect()
    for row in model:
        v = pdf[pdf["s"] == row["s"]]["cpu_usage"].to_numpy()
        n = len(v) - L - H + 1
        x = np.stack([np.r_[1.0, v[i : i + L]] for i in range(n)])
        y = np.stack([v[i + L : i + L + H] for i in range(n)])
        k = int(0.8 * n)
        ridge = np.diag([1e-9] + [1e-2] * L)
        coef = np.linalg.lstsq(x[:k].T @ x[:k] + ridge, x[:k].T @ y[:k], rcond=None)[0]
        assert row["n"] == k
        np.testing.assert_allclose(x @ np.array(row["coef"]).reshape(L + 1, H), x @ coef, rtol=1e-5)
        assert row["val_mae"] == pytest.approx(np.abs(x[k:] @ coef - y[k:]).mean(), rel=1e-4)


def test_sequence_forecast_uses_latest_window(history):
    pdf, df = history
    model = forecasting.fit_sequence(df, ["s"], "ts", ["cpu_usage"], "cpu_usage", lookback=24, horizon=3)
    windows = sequences.inference_window(df, ["s"], "ts", ["cpu_usage"], lookback=24)
    got = forecasting.forecast_sequence(model, windows, ["s"], 3).orderBy("s", "h").toPandas()
    coefs = {r["s"]: np.array(r["coef"]).reshape(25, 3) for r in model.collect()}
    for s, g in got.groupby("s"):
        tail = pdf[pdf["s"] == s]["cpu_usage"].to_numpy("float32").astype(float)[-24:]
        np.testing.assert_allclose(g["yhat"], np.r_[1.0, tail] @ coefs[s], rtol=1e-6)


def test_short_series_gets_no_sequence_model(history):
    _, df = history
    gate = forecasting.long_enough(df.filter((F.col("s") == "a") | (F.col("ts") < "2026-03-04")), ["s"], "ts")
    assert {r["s"]: r["trains_sequence"] for r in gate.collect()} == {"a": True, "b": False}


def test_train_predict_decide(history):
    _, df = history
    models = flows.train(df, ["s"], "ts", lookback=24, horizon=10)
    assert all(r["is_active"] for r in models.registry.collect())
    assert all(r["sequence_trained"] and r["seasonal_trained"] for r in models.summary.collect())
    made = flows.predict(df, ["s"], "ts", models, step_s=STEP, lookback=24, horizon=10)
    replicas = df.groupBy("s").agg(F.max("ready_replicas").cast("int").alias("current_replicas"))
    rows = flows.decide(made, replicas, ["s"]).orderBy("s").collect()
    assert [len(r["predicted_values"]) for r in rows] == [10, 10]
    assert rows[0]["direction"] == "up" and rows[1]["recommended_replicas"] == 50


def test_stored_models_predict_the_same(history, tmp_path):
    _, df = history
    path = str(tmp_path / "models")
    first = flows.train(df, ["s"], "ts", lookback=24, horizon=10, base_path=path, store=True)
    again = flows.train(df, ["s"], "ts", lookback=24, horizon=10, base_path=path, store=True, registry=first.registry)
    loaded = flows.load(again.registry, ["s"], path, again.columns)
    assert loaded.seasonal.count() == 2
    a = flows.predict(df, ["s"], "ts", again, step_s=STEP, lookback=24, horizon=10).orderBy("s").collect()
    b = flows.predict(df, ["s"], "ts", loaded, step_s=STEP, lookback=24, horizon=10).orderBy("s").collect()
    assert [r["predicted_values"] for r in a] == [r["predicted_values"] for r in b]
    pd.testing.assert_frame_equal(*(m.limits.toPandas().sort_values(["s", "column"], ignore_index=True)[["s", "column", "lo", "hi"]] for m in (again, loaded)))


def test_forecasts_clip_to_the_limits_of_training(history, spark):
    """A last value far outside the recent rows is cut at the limit of the whole history, not at that of the recent rows."""
    pdf, df = history
    models = flows.train(df, ["s"], "ts", lookback=24, horizon=10)
    limits = {r["s"]: r["hi"] for r in models.limits.filter("column = 'cpu_usage'").collect()}
    for s, g in pdf.groupby("s"):
        assert limits[s] == pytest.approx(g["cpu_usage"].mean() + OUTLIER_STD * g["cpu_usage"].std())

    def ahead(last_value):
        rows = pdf.reset_index(drop=True)
        rows.loc[rows["ts"] == rows["ts"].max(), "cpu_usage"] = rows["s"].map(last_value)
        made = flows.predict(spark.createDataFrame(rows), ["s"], "ts", models, step_s=STEP, lookback=24, horizon=10)
        return [r["predicted_values"] for r in made.orderBy("s").collect()]

    at_limit, beyond = ahead(limits), ahead({s: 50 * hi for s, hi in limits.items()})
    np.testing.assert_allclose(beyond, at_limit, rtol=1e-6)


def test_tick_guards_and_acts(history, spark):
    pdf, df = history
    models = flows.train(df, ["s"], "ts", lookback=24, horizon=10)
    replicas = spark.createDataFrame([("a", 3), ("b", None)], "s string, current_replicas int")
    now = pdf["ts"].max()
    out = {}
    for name, ago in (("free", 3600), ("blocked", 10)):
        last = spark.createDataFrame([("a", (now - pd.Timedelta(seconds=ago)).to_pydatetime())], "s string, last_executed timestamp")
        made = flows.tick(df, ["s"], "ts", models, replicas, last_executed=last, step_s=STEP, lookback=24, horizon=10)
        out[name] = {r["s"]: r for r in made.collect()}
        out[name + " actions"] = decisions.actions(made, ["s"], "cycle").count()
    a, b = out["free"]["a"], out["blocked"]["a"]
    assert a["executed"] and a["target_replicas"] == 8 and "capped at +5" in a["reason"]
    assert not b["executed"] and not b["approved"] and "BLOCKED" in b["reason"]
    assert (out["free actions"], out["blocked actions"]) == (1, 0)
    assert out["free"]["b"]["direction"] == "none" and not out["free"]["b"]["approved"]


def test_lasso_meets_its_conditions():
    """At the minimum the gradient is zero for free coordinates, within the limit for zeros and at it for the others."""
    rng = np.random.default_rng(2)
    for trial in range(5):
        x = rng.normal(size=(80, 12)).cumsum(axis=1)
        a, c = x.T @ x, x.T @ (x[:, [3, 7]] @ [2.0, -1.0] + rng.normal(size=80))
        l1 = np.r_[0.0, 0.0, np.full(10, 10.0 * 3**trial)]
        b = forecasting.lasso(a, c, l1)
        slope = a @ b - c
        assert np.abs(slope[:2]).max() < 1e-6
        on = (b != 0) & (l1 > 0)
        assert np.abs(slope[on] + l1[on] * np.sign(b[on])).max(initial=0) < 1e-6
        assert (np.abs(slope[(b == 0)]) <= l1[b == 0] + 1e-6).all()
    assert not forecasting.lasso(a, c, np.r_[0.0, 0.0, np.full(10, 1e9)])[2:].any()


def test_a_trend_with_two_breaks_keeps_two_hinges(spark):
    n = 4_000
    tau = np.arange(n) / (n - 1)
    spots = [forecasting.CHANGEPOINT_SHARE * (j + 1) / (forecasting.CHANGEPOINTS + 1) for j in (7, 18)]
    y = 1 + 0.5 * tau + 6 * np.maximum(0, tau - spots[0]) - 9 * np.maximum(0, tau - spots[1])
    pdf = pd.DataFrame({"s": "a", "ts": pd.date_range("2026-01-01", periods=n, freq="h"), "v": y + np.random.default_rng(1).normal(0, 0.01, n)})
    df = spark.createDataFrame(pdf)
    hinges = {}
    for sparse in (True, False):
        model = forecasting.fit_seasonal(df, ["s"], "ts", "v", daily=0, weekly=0, sparse=sparse).first()
        hinges[sparse] = np.array(model["trend"][2:])
    # The prior draws a bend to its neighbours at most.
    big = np.flatnonzero(np.abs(hinges[True]) > 0.2)
    assert set(big) == {7, 18} and (hinges[True] == 0).sum() >= 18 and (hinges[False] == 0).sum() == 0

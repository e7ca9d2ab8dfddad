import numpy as np
import pytest
from conftest import service_minutes, skewed_series

from surgecast.operators import features


def pandas_features(g, cols):
    out = {}
    for c in cols:
        v = g[c]
        for n in (5, 15, 60):
            out[f"{c}_rolling_mean_{n}m"] = v.rolling(n, min_periods=1).mean()
            out[f"{c}_rolling_std_{n}m"] = v.rolling(n, min_periods=1).std().fillna(0)
        out[f"{c}_rate_of_change"] = v.diff().fillna(0)
        out[f"lag_{c}_15m"], out[f"lag_{c}_60m"] = v.shift(15), v.shift(60)
        out[f"{c}_ema_30"] = v.ewm(span=30, adjust=False).mean()
    return g.assign(**out)


@pytest.mark.parametrize("block_rows", [60, 100, 4096])
def test_row_features_equal_pandas(spark, block_rows):
    pdf = skewed_series(1200)
    out = features.row_features(
        spark.createDataFrame(pdf),
        ["s"],
        "ts",
        ["v"],
        rolling=(5, 15, 60),
        difference=True,
        lags=(15, 60),
        ema_span=30,
        slot_s=3 * 3600,
        block_rows=block_rows,
    ).toPandas()
    assert len(out) == len(pdf)
    for key, g in pdf.groupby("s"):
        want = pandas_features(g.sort_values("us"), ["v"])
        got = out[out["s"] == key].sort_values("us")
        for c in set(want.columns) - {"s", "ts"}:
            np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-8, atol=1e-9, equal_nan=True, err_msg=c)


def test_ema_long_series_many_blocks(spark):
    pdf = service_minutes(5000)
    out = features.row_features(
        spark.createDataFrame(pdf), ["s"], "ts", ["cpu_usage"], ema_span=30, slot_s=3600, block_rows=70
    ).orderBy("ts").toPandas()
    want = pdf["cpu_usage"].ewm(span=30, adjust=False).mean()
    np.testing.assert_allclose(out["cpu_usage_ema_30"], want, rtol=1e-10)


def test_ema_block_that_overflows_is_refused(spark):
    with pytest.raises(ValueError):
        features.row_features(spark.createDataFrame(service_minutes(3)), ["s"], "ts", ["cpu_usage"], ema_span=2, block_rows=4096)


def test_engineer(spark):
    pdf = service_minutes(200)
    out = features.engineer(spark.createDataFrame(pdf), ["s"], "ts")
    assert len(out.columns) == len(pdf.columns) + 55
    got = out.orderBy("ts").toPandas()
    assert len(got) == 140 and not got.isna().any().any()
    want = pandas_features(pdf, features.PRIMARY_METRICS).iloc[60:]
    for c in want.columns[2:]:
        np.testing.assert_allclose(got[c], want[c], rtol=1e-6, atol=1e-6, err_msg=c)
    hour = got["ts"].dt.hour + got["ts"].dt.minute / 60
    np.testing.assert_allclose(got["hour_sin"], np.sin(2 * np.pi * hour / 24), atol=1e-12)
    assert (got["is_weekend"] == (got["ts"].dt.dayofweek >= 5).astype(int)).all()


def test_rolling_time_equals_pandas(spark):
    pdf = skewed_series(500)
    out = features.rolling_time(spark.createDataFrame(pdf), ["s"], "ts", ["v"], (30, 120), block_s=2 * 3600).toPandas()
    for key, g in pdf.groupby("s"):
        s = g.sort_values("us").set_index("ts")["v"]
        got = out[out["s"] == key].sort_values("us")
        for n in (30, 120):
            np.testing.assert_allclose(got[f"v_mean_last_{n}min"], s.rolling(f"{n}min").mean(), rtol=1e-9)
            np.testing.assert_allclose(got[f"v_std_last_{n}min"], s.rolling(f"{n}min").std().fillna(0), rtol=1e-6, atol=1e-7)

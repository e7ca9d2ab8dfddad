import numpy as np
import pandas as pd
import pytest
from conftest import service_minutes

from surgecast.operators import normalize, sequences

COLS = ["cpu_usage", "memory_usage", "ready_replicas"]


@pytest.fixture(scope="module")
def frame(spark):
    a = service_minutes(120)
    b = service_minutes(75, seed=3).assign(s="b")
    pdf = pd.concat([a, b])
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("keys", [["s"], []])
def test_minmax(frame, keys):
    _, df = frame
    scaled, params = normalize.fit_transform(df, keys, COLS)
    got = scaled.toPandas()
    assert got[COLS].min().min() >= -1e-12 and got[COLS].max().max() <= 1 + 1e-12
    assert (got["ready_replicas"] == 0).all()
    back = normalize.inverse_transform(scaled, params, keys, COLS).orderBy("s", "ts").toPandas()
    np.testing.assert_allclose(back[COLS], df.orderBy("s", "ts").toPandas()[COLS], rtol=1e-9)


def test_standard(frame):
    pdf, df = frame
    scaled, params = normalize.fit_transform(df, ["s"], COLS, "standard")
    for _, g in scaled.toPandas().groupby("s"):
        assert abs(g["cpu_usage"].mean()) < 1e-9
        assert g["cpu_usage"].std(ddof=0) == pytest.approx(1)
        assert (g["ready_replicas"] == 0).all()
    row = params.filter("s = 'b' and feature = 'cpu_usage'").first()
    assert row["var"] == pytest.approx(pdf[pdf["s"] == "b"]["cpu_usage"].var(ddof=0))


def test_errors(frame):
    _, df = frame
    with pytest.raises(ValueError):
        normalize.fit(df, ["s"], COLS, "robust")
    with pytest.raises(RuntimeError):
        normalize.transform(df, None, ["s"], COLS)
    params = normalize.fit(df, ["s"], COLS)
    with pytest.raises(ValueError):
        normalize.inverse_transform_array(df, params, ["s"], "x", "nope")


@pytest.mark.parametrize("block_rows", [30, 4096])
def test_training_windows(frame, block_rows):
    pdf, df = frame
    out = sequences.training_windows(
        df, ["s"], "ts", COLS, "cpu_usage", lookback=30, horizon=5, slot_s=1800, block_rows=block_rows
    ).toPandas()
    for key, g in pdf.groupby("s"):
        got = out[out["s"] == key].sort_values("sample_id").reset_index(drop=True)
        assert len(got) == len(g) - 30 - 5 + 1
        values, target = g[COLS].to_numpy("float32"), g["cpu_usage"].to_numpy("float32")
        for i in (0, 1, 17, len(got) - 1):
            np.testing.assert_array_equal(np.stack(got["x"][i]), values[i : i + 30])
            np.testing.assert_array_equal(got["y"][i], target[i + 30 : i + 35])


def test_series_too_short_gives_no_windows(spark):
    df = spark.createDataFrame(service_minutes(34))
    assert sequences.training_windows(df, ["s"], "ts", COLS, "cpu_usage", lookback=30, horizon=5).count() == 0
    df = spark.createDataFrame(service_minutes(35))
    assert sequences.training_windows(df, ["s"], "ts", COLS, "missing", lookback=30, horizon=5).count() == 1


def test_inference_window_pads_left(frame):
    pdf, df = frame
    out = {r["s"]: np.array(r["x"]) for r in sequences.inference_window(df, ["s"], "ts", ["cpu_usage"], lookback=100).collect()}
    assert out["a"].shape == out["b"].shape == (100, 1)
    assert (out["b"][:25] == 0).all()
    np.testing.assert_array_equal(out["b"][25:, 0].astype("float32"), pdf[pdf["s"] == "b"]["cpu_usage"].to_numpy("float32"))


def test_chronological_split(frame):
    _, df = frame
    got = sequences.chronological_split(df, ["s"], "ts", slot_s=900).toPandas()
    for key, n in (("a", 120), ("b", 75)):
        g = got[got["s"] == key].sort_values("ts")
        assert g["is_train"].sum() == int(0.8 * n)
        assert g["is_train"].iloc[: int(0.8 * n)].all()

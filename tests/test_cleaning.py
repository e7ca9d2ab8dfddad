import numpy as np
import pandas as pd
import pytest
from conftest import service_minutes, skewed_series
from pyspark.sql import functions as F

from surgecast.operators import cleaning

COLS = ["cpu_usage", "memory_usage"]


def nulls(spark, pdf):
    """pandas marks missing numbers as NaN; the engine's missing value is NULL."""
    df = spark.createDataFrame(pdf)
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def test_interpolation_vector(spark):
    pdf = pd.DataFrame(
        {"s": "a", "ts": pd.to_datetime("2026-01-01") + pd.to_timedelta([0, 1, 2, 5, 7, 9], "min"), "v": [None, 1, None, None, 4, None]}
    )
    out = cleaning.interpolate(nulls(spark, pdf), ["s"], "ts", ["v"], slot_s=120).orderBy("ts").toPandas()
    assert out["v"].tolist() == [1, 1, 1.5, 3, 4, 4]
    gap = cleaning.interpolate(nulls(spark, pdf), ["s"], "ts", ["v"], slot_s=120, max_gap_s=120).orderBy("ts").toPandas()
    assert gap["v"].fillna(-1).tolist() == [1, 1, -1, -1, 4, 4]


def test_interpolation_equals_pandas(spark):
    pdf = skewed_series(400)
    want = {
        k: g.set_index("ts")["gappy"].interpolate(method="time", limit_direction="both").to_numpy() for k, g in pdf.groupby("s")
    }
    out = cleaning.interpolate(nulls(spark, pdf), ["s"], "ts", ["gappy"], slot_s=7200).orderBy("ts").toPandas()
    for k, g in out.groupby("s"):
        np.testing.assert_allclose(g["gappy"].to_numpy(), want[k], rtol=1e-9)


def test_clean_removes_nulls_and_clips(spark):
    pdf = service_minutes(200)
    pdf.loc[3, "cpu_usage"] = None
    pdf.loc[7, "memory_usage"] = None
    pdf.loc[50, "request_rate"] = 1e6
    pdf["sparse"] = [1.0] * 20 + [None] * 180
    pdf["half"] = [1.0, None] * 100
    out = cleaning.clean(nulls(spark, pdf), ["s"], "ts", slot_s=3600)
    assert "sparse" not in out.columns and "half" in out.columns
    got = out.orderBy("ts").toPandas()
    assert len(got) == 200 and not got.isna().any().any()
    v = pdf["request_rate"]
    assert got["request_rate"].max() == pytest.approx(v.mean() + 4 * v.std())
    assert (got["ready_replicas"] == 7).all()


def test_empty_frame(spark):
    df = nulls(spark, service_minutes(5)).filter("cpu_usage > 99")
    out = cleaning.clean(df, ["s"], "ts", COLS)
    assert out.count() == 0


def test_all_null_series_stays_null(spark):
    pdf = service_minutes(10)
    other = pdf.assign(s="b", cpu_usage=None)
    df = nulls(spark, pd.concat([pdf, other.astype({"cpu_usage": float})]))
    out = cleaning.fill_remaining(df, ["s"], "ts", ["cpu_usage"])
    assert out.filter("s = 'b' and cpu_usage is not null").count() == 0
    assert out.filter("s = 'a' and cpu_usage is null").count() == 0


def test_quality_report(spark):
    pdf = service_minutes(8)[["s", "ts", "cpu_usage"]]
    pdf.loc[0, "cpu_usage"] = None
    pdf["note"] = "x"
    rep = {r["column"]: r for r in cleaning.quality_report(nulls(spark, pdf), ["s"], exclude=["ts"]).collect()}
    cpu = rep["cpu_usage"]
    assert (cpu["count"], cpu["nulls"], cpu["null_pct"]) == (7, 1, 12.5)
    assert cpu["mean"] == pytest.approx(round(pdf["cpu_usage"].mean(), 4))
    assert cpu["std"] == pytest.approx(round(pdf["cpu_usage"].std(), 4))
    assert rep["note"]["mean"] is None and rep["note"]["count"] == 8


def test_clip_counts(spark):
    pdf = service_minutes(200)
    pdf.loc[0, "cpu_usage"] = 1e6
    got = {r["column"]: r["clipped"] for r in cleaning.clip_counts(nulls(spark, pdf), ["s"], COLS).collect()}
    assert got == {"cpu_usage": 1, "memory_usage": 0}

import glob

import pandas as pd
import pytest
from conftest import skewed_series
from pyspark.sql import functions as F
from test_ensemble_decisions import brute_force, decision_rows

from surgecast.operators import decisions
from surgecast.operators.decisions import GuardConfig
from surgecast.streaming import control, ingest


@pytest.fixture()
def parts(spark, tmp_path):
    """Rows written as several files in time order, read one file per micro-batch."""

    def write(pdf, n):
        path = str(tmp_path / "in")
        size = -(-len(pdf) // n)
        df = spark.createDataFrame(pdf)
        for i in range(n):
            spark.createDataFrame(pdf.iloc[i * size : (i + 1) * size]).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), df

    return write


def closed(df, delay, end):
    limit = df.agg((F.max("ts") - F.expr(f"interval {delay}")).alias("t")).first()["t"]
    return F.col(end) <= F.lit(limit)


def test_bins_over_many_batches_equal_batch(parts):
    stream, df = parts(skewed_series(600), 6)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")]
    bins = ingest.tumbling_bins(stream.withWatermark("ts", "10 minutes"), ["s"], aggs, "1 hour")
    got = ingest.run_to_table(bins, "t-bins").toPandas().sort_values(["s", "ts"]).reset_index(drop=True)
    want = df.groupBy("s", F.window("ts", "1 hour").alias("w")).agg(*aggs)
    want = want.filter(closed(df, "10 minutes", "w.end")).select("s", F.col("w.start").alias("ts"), "n", "total")
    want = want.toPandas().sort_values(["s", "ts"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)


def test_dedup_keeps_last_arrival_and_drops_late_rows(parts):
    t = pd.Timestamp("2026-01-01")
    m = lambda k: t + pd.Timedelta(minutes=k)
    # A batch drops rows by the watermark the batch before it ran with.
    rows = [(0, 1.0), (1, 2.0), (0, 9.0), (60, 4.0), (61, 5.0), (0, 77.0), (120, 6.0)]
    pdf = pd.DataFrame([("a", m(k), i, v) for i, (k, v) in enumerate(rows)], columns=["s", "ts", "seq", "v"])
    stream, _ = parts(pdf, 7)
    out = ingest.dedup_last(stream.withWatermark("ts", "10 minutes"), ["s"], "seq")
    got = {(r["ts"].hour, r["ts"].minute): r["v"] for r in ingest.run_to_table(out, "t-dedup").collect()}
    assert got == {(0, 0): 9.0, (0, 1): 2.0, (1, 0): 4.0, (1, 1): 5.0}


def test_guard_state_survives_batches(parts):
    pdf = decision_rows(200)
    guard = GuardConfig(cooldown_s=300)
    stream, _ = parts(pdf, 4)
    got = ingest.run_to_table(control.guard_stream(stream, ["s"], guard), "t-guard").toPandas()
    want = brute_force(pdf, guard)
    assert len(got) == len(pdf)
    for r in got.itertuples():
        key = r.s, int(r.ts.value // 1000 if r.ts.unit == "ns" else r.ts.value)
        assert (r.target_replicas, r.approved, r.executed) == want[key]


def test_tick_loop_uses_history_and_reruns_safely(spark, tmp_path):
    pdf = skewed_series(300)
    pdf["ts"] = pdf["ts"].dt.floor("s")
    score = lambda h: h.select("s", "ts", F.col("v").alias("predicted_peak"), F.lit(0.9).alias("confidence"), F.lit(3).alias("current_replicas"))
    loop = control.TickLoop(spark, ["s"], score, decisions.decide, history_s=86400 * 365, folder=str(tmp_path / "ticks"))
    for i in (0, 1, 1):
        loop(spark.createDataFrame(pdf.iloc[i * 150 : (i + 1) * 150][["s", "ts", "v"]]), i)
    out = loop.decisions(spark)
    assert out.count() == 300 and out.select("s", "ts").distinct().count() == 300
    assert len(glob.glob(str(tmp_path / "ticks/decisions/batch=*"))) == 2

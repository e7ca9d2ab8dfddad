"""Cleaning reads its frame once and fills holes across slots without sorting it twice."""

from pyspark.sql import functions as F

from surgecast.operators import cleaning


def test_frame_is_made_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        read.add(1)
        return v

    rows = spark.createDataFrame([("a", i * 60, None if i % 3 else float(i)) for i in range(30)], "s string, at long, v double")
    df = rows.select("s", F.timestamp_seconds("at").alias("ts"), counted("v").alias("v"))
    got, kept = cleaning.without_gaps(df, ["s"], "ts", ["v"], min_ratio=0.1, slot_s=240)
    assert kept == ["v"] and got.count() == 30
    assert read.value == 30


def test_holes_over_many_slots(spark):
    known = {0: 0.0, 50: 100.0, 51: float("nan")}
    rows = [("a", i * 60, known.get(i), i) for i in range(60)] + [("b", i * 60, None, None) for i in range(5)]
    df = spark.createDataFrame(rows, "s string, at long, v double, w int").withColumn("ts", F.timestamp_seconds("at"))
    out = cleaning.interpolate(df, ["s"], "ts", ["v", "w"], slot_s=240)
    assert out.columns == df.columns and out.count() == 65
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    got = {(r["s"], r["at"] // 60): (r["v"], r["w"]) for r in out.collect()}
    assert all(abs(got["a", i][0] - 2 * i) < 1e-9 for i in range(51))
    assert all(got["a", i][0] != got["a", i][0] for i in range(51, 60))
    assert [got["a", i][1] for i in range(60)] == [float(i) for i in range(60)]
    assert all(got["b", i] == (None, None) for i in range(5))
    near = cleaning.interpolate(df, ["s"], "ts", ["v"], slot_s=240, max_gap_s=600).filter("s = 'a' and v is null")
    assert near.count() == 49

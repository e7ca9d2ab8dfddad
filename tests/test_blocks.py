"""Block operators must equal one pass over each whole series."""

import numpy as np
import pandas as pd
import pytest
from conftest import skewed_series
from pyspark.sql import functions as F

from surgecast.operators import features
from surgecast.plans import blocks

HOUR = 3600


@pytest.fixture(scope="module")
def rows(spark):
    pdf = skewed_series()
    return pdf, spark.createDataFrame(pdf)


def by_series(pdf, fn):
    return pd.concat([fn(g.sort_values("us").copy()) for _, g in pdf.groupby("s")]).sort_values("seq")


def same(got, want, cols):
    got = got.toPandas().sort_values("seq").reset_index(drop=True)
    want = want.reset_index(drop=True)
    assert len(got) == len(want)
    for c in cols:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("slot", [HOUR, 6 * HOUR, 400 * 24 * HOUR])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("backward", [False, True])
def test_carry(rows, slot, strict, backward):
    pdf, df = rows

    def want(g):
        filled = g["gappy"].bfill() if backward else g["gappy"].ffill()
        g["near"] = filled.shift(-1 if backward else 1) if strict else filled
        return g

    got = blocks.carry(df, ["s"], "ts", {"near": F.expr("nullif(gappy, double('NaN'))")}, slot_s=slot, strict=strict, backward=backward)
    same(got, by_series(pdf, want), ["near"])


def test_neighbours(rows):
    pdf, df = rows

    def want(g):
        return g.assign(x_prev=g["gappy"].ffill(), x_next=g["gappy"].bfill())

    got = blocks.neighbours(df, ["s"], "ts", {"x": F.expr("nullif(gappy, double('NaN'))")}, slot_s=2 * HOUR)
    same(got, by_series(pdf, want), ["x_prev", "x_next"])


@pytest.mark.parametrize("slot", [HOUR, 400 * 24 * HOUR])
def test_running_sum_and_positions(rows, slot):
    pdf, df = rows

    def want(g):
        return g.assign(total=g["v"].cumsum(), pos=np.arange(1, len(g) + 1), n=len(g))

    summed = blocks.running_sum(df, ["s"], "ts", {"total": F.col("v")}, slot_s=slot)
    placed = blocks.with_positions(summed, ["s"], "ts", slot_s=slot, pos="pos", total="n")
    same(placed, by_series(pdf, want), ["total", "pos", "n"])


@pytest.mark.parametrize("size", [20, 64, 5000])
def test_row_blocks_complete_frames(rows, size):
    pdf, df = rows

    def want(g):
        return g.assign(
            back=g["v"].rolling(20, min_periods=1).sum(), ahead=g["v"][::-1].shift(1).rolling(5, min_periods=1).sum()[::-1]
        )

    placed = blocks.row_blocks(blocks.with_positions(df, ["s"], "ts", slot_s=6 * HOUR), size=size, back=19, ahead=5)
    w = blocks.block_window(["s"], [blocks.POS])
    out = placed.withColumns({"back": F.sum("v").over(w.rowsBetween(-19, 0)), "ahead": F.sum("v").over(w.rowsBetween(1, 5))})
    same(blocks.own_rows(out), by_series(pdf, want), ["back", "ahead"])


def test_time_blocks_complete_frames(rows):
    pdf, df = rows

    def want(g):
        s = g.set_index("ts")["v"]
        return g.assign(back=s.rolling("45min", closed="right").sum().to_numpy())

    placed = blocks.time_blocks(df, "ts", width_s=HOUR, back_s=45 * 60)
    w = blocks.block_window(["s"], ["us"]).rangeBetween(-(45 * 60_000_000 - 1), 0)
    same(blocks.own_rows(placed.withColumn("back", F.sum("v").over(w))), by_series(pdf, want), ["back"])


@pytest.mark.parametrize("width_s", [60, 45 * 60, HOUR])
def test_trailing_panes_equal_a_sliding_frame(rows, width_s):
    """Panes that do not line up with the blocks, a frame of one whole pane, sums and extremes alike."""
    _, df = rows
    placed = blocks.time_blocks(df, "ts", width_s=HOUR, back_s=width_s)
    parts = {"n": (F.count, F.col("v")), "lo": (F.min, F.col("v")), "hi": (F.max, F.col("v"))}
    w = blocks.block_window(["s"], ["us"]).rangeBetween(-(width_s * 1_000_000 - 1), 0)
    wanted = placed.withColumns({n: f(c).over(w) for n, (f, c) in parts.items()})
    merged = blocks.trailing(placed, ["s"], "us", width_s, parts).withColumns(
        {"n": blocks.sum_of("n_tail", "n_head"), "lo": F.least("lo_tail", "lo_head"), "hi": F.greatest("hi_tail", "hi_head")}
    )
    columns = ["s", "us", "n", "lo", "hi"]
    got, want = (blocks.own_rows(x).select(columns).toPandas().sort_values(["s", "us"], ignore_index=True) for x in (merged, wanted))
    pd.testing.assert_frame_equal(got, want)


def test_trailing_panes_of_a_dense_minute(spark):
    """10^5 rows in one minute, all in one frame: a sliding frame would add 5 * 10^9 times."""
    rows = spark.range(100_000).select(F.lit("a").alias("s"), F.timestamp_micros(F.col("id") * 600).alias("ts"), F.lit(1.0).alias("v"))
    placed = blocks.time_blocks(rows, "ts", width_s=HOUR, back_s=600).withColumn("us", blocks.micros("ts"))
    out = blocks.own_rows(blocks.trailing(placed, ["s"], "us", 600, {"n": (F.sum, F.col("v"))}))
    total = blocks.sum_of("n_tail", "n_head")
    assert out.agg(F.sum(total), F.max(total)).first()[:] == (100_000 * 100_001 / 2, 100_000.0)


def test_halo_longer_than_block_is_refused(rows):
    _, df = rows
    with pytest.raises(ValueError):
        blocks.row_blocks(df.withColumn(blocks.POS, F.lit(1)), size=10, back=11)
    with pytest.raises(ValueError):
        blocks.time_blocks(df, "ts", width_s=10, ahead_s=11)


def test_windows_never_partition_rows_by_series_alone(rows):
    """The hot series is spread: row-level windows partition by (series, block)."""
    _, df = rows
    placed = blocks.row_blocks(blocks.with_positions(df, ["s"], "ts", slot_s=HOUR), size=64, back=5)
    sizes = placed.groupBy("s", blocks.BLOCK).count().agg(F.max("count")).first()[0]
    assert sizes <= 64 + 5


def test_slot_for_bounds_the_busiest_slot(rows):
    pdf, df = rows
    for limit in (5, 40, 10_000):
        slot = blocks.slot_for(df, ["s"], "ts", max_rows=limit)
        counts = {n: pdf.groupby(["s", pdf["us"] // (n * 1_000_000)]).size().max() for n in blocks.SLOT_LENGTHS}
        assert slot == max([n for n, c in counts.items() if c <= limit], default=60)


def test_short_series_need_no_count_by_slot(spark, monkeypatch):
    """Where no series is too long, rows are counted by series alone, not by minute."""
    df = spark.createDataFrame([(s, i) for s in ("a", None) for i in range(5)], "s string, i long").selectExpr("s", "timestamp_seconds(i * 60) as ts")
    monkeypatch.setattr(blocks, "floor_to", None)
    assert blocks.slot_for(df, ["s"], "ts", max_rows=5) == max(blocks.SLOT_LENGTHS)
    monkeypatch.undo()
    assert blocks.slot_for(df, ["s"], "ts", max_rows=4, lengths=(600, 120, 60)) == 120
    assert blocks.slot_for(df, ["s"], "ts", max_rows=0, lengths=(600, 60)) == 60
    assert blocks.slot_for(df.limit(0), ["s"], "ts") == min(blocks.SLOT_LENGTHS)


def test_parts_grow_with_the_rows(spark):
    """More rows are dealt to more tasks, and the features stay the same."""
    df = spark.createDataFrame([(f"s{i % 3}", i, float(i % 7)) for i in range(60)], "s string, i long, v double").selectExpr("s", "timestamp_seconds(i * 60) as ts", "v")
    assert blocks.parts_for(df) is None and blocks.parts_for(df, 6) == 10
    made = [sorted(map(tuple, features.row_features(df, ["s"], "ts", ["v"], rolling=[3], lags=[2], parts=n).collect()), key=str) for n in (None, 10)]
    assert made[0] == made[1]

"""What a training writes, and what is left of it."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surgecast import session
from surgecast.checks import load
from surgecast.operators import forecasting

FEATURES = ["a", "b", "c", "d"]


def folder(df):
    return df._scratch.removeprefix("file:")


def size(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(path) for f in names)


def several_series(spark, count=12, n=150):
    """Series of unlike lengths; one has unknown values, one a constant target and one nothing but unknown targets."""
    rng = np.random.default_rng(5)
    out = []
    for s in range(count):
        rows = n + 7 * s
        pdf = pd.DataFrame(rng.normal(5, 1, (rows, len(FEATURES))).cumsum(axis=0) / 30, columns=FEATURES)
        out.append(pdf.assign(s=f"s{s}", ts=pd.date_range("2026-03-02", periods=rows, freq="2h")))
    out[3].loc[40:43, "a"] = None
    out[4]["a"] = 2.5
    out[5]["a"] = None
    return spark.createDataFrame(pd.concat(out).replace({np.nan: None}), "a double, b double, c double, d double, s string, ts timestamp")


@pytest.fixture
def written(monkeypatch):
    """Bytes of each table that the forecasters write."""
    sizes, real = {}, forecasting.materialise

    def spy(df, purpose):
        made = real(df, purpose)
        sizes[purpose] = sizes.get(purpose, 0) + size(folder(made))
        return made

    monkeypatch.setattr(forecasting, "materialise", spy)
    return sizes


def test_sums_of_short_series_are_written_nowhere(spark, written):
    """A series' sums, of 97 x 97 terms here, are far larger than its rows; only its coefficients are written."""
    df = several_series(spark)
    plan = forecasting.fit_sequence(df, ["s"], "ts", FEATURES, "a", lookback=24, horizon=4)
    assert plan.count() == 11
    coefficients = 11 * 8 * (1 + 24 * len(FEATURES)) * 4
    assert sum(written.values()) < 2.5 * coefficients + 100_000 < 12 * 8 * 97 * 97
    assert "sums" not in written
    forecasting.fit_seasonal(df, ["s"], "ts", "a").collect()
    assert "sums" not in written


def by_series(df):
    return {r["s"]: r.asDict() for r in df.collect()}


def test_whole_series_and_blocks_give_one_sequence_model(spark):
    df = several_series(spark)
    fit = {rows: by_series(forecasting.fit_sequence(df, ["s"], "ts", FEATURES, "a", lookback=5, horizon=3, block_rows=rows)) for rows in (20, 200, 4096)}
    assert set(fit[4096]) == {f"s{i}" for i in range(12)} - {"s5"}
    for rows in (20, 200):
        assert set(fit[rows]) == set(fit[4096])
        for s, want in fit[4096].items():
            assert fit[rows][s]["n"] == want["n"]
            np.testing.assert_allclose(fit[rows][s]["coef"], want["coef"], rtol=1e-6, atol=1e-8)
            assert fit[rows][s]["val_mae"] == pytest.approx(want["val_mae"], rel=1e-6)


@pytest.mark.parametrize("options", [{}, {"sparse": True}, {"changepoints": 0, "daily": 0, "weekly": 0}, {"changepoints": 1, "daily": 0, "weekly": 2}])
def test_whole_series_and_slots_give_one_seasonal_model(spark, options):
    df = several_series(spark, 7)
    # A series with values that are no numbers, and one with a value without bound.
    df = df.withColumn("a", F.when((F.col("s") == "s1") & (F.hour("ts") == 4), float("nan")).when((F.col("s") == "s2") & (F.hour("ts") == 6), float("inf")).otherwise(F.col("a")))
    kinds = {rows: forecasting.fit_seasonal(df, ["s"], "ts", "a", slot_s=5 * 86400, whole_rows=rows, **options) for rows in (0, 170, 4096)}
    schema = [(f.name, f.dataType) for f in kinds[0].schema]
    assert all([(f.name, f.dataType) for f in k.schema] == schema for k in kinds.values())
    fit = {rows: by_series(k) for rows, k in kinds.items()}
    assert set(fit[0]) == {"s0", "s1", "s2", "s3", "s4", "s6"}
    for rows in (170, 4096):
        assert set(fit[rows]) == set(fit[0])
        for s, want in fit[0].items():
            got = fit[rows][s]
            assert [got[c] for c in ("t0", "t1", "n", "daily", "weekly")] == [want[c] for c in ("t0", "t1", "n", "daily", "weekly")], s
            np.testing.assert_equal(got["scale"], want["scale"])
            for c in ("trend", "season", "sigma", "mae"):
                assert (got[c] is None) == (want[c] is None), (s, c)
                if want[c] is not None:
                    np.testing.assert_allclose(got[c], want[c], rtol=1e-5, atol=1e-7, err_msg=f"{s} {c}")


def test_shuffle_files_go_with_their_job(spark):
    session.configure(spark)
    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    before = files()
    made = session.materialise(spark.range(50_000).repartition(4, "id"), "dealt")
    assert not files() - before
    assert made.count() == 50_000


def test_released_tables_are_gone_and_others_stay(spark):
    gone, stays = (session.materialise(spark.range(3), "some") for _ in range(2))
    session.release(gone, stays.filter("id > 0"), gone)
    assert not os.path.exists(folder(gone)) and stays.count() == 3


@pytest.mark.parametrize("name", ["training_run", "control_tick", "streaming_model_tick"])
def test_large_tables_of_a_training_go_before_its_end(spark, sf_dir, name):
    """Rows that were cleaned, scaled or decided on are not on disk when the result is read; stored models once."""
    had = set(session._created)
    rows = load()["QUERIES"][name](spark, sf_dir)
    left = {os.path.basename(p).rsplit("-", 1)[0] for p in set(session._created) - had}
    passing = {"frame", "cleaned", "sequence-rows", "scaled-rows", "sequence-blocks", "rolled", "forecast-pairs", "decisions", "guarded", "cycle"}
    assert not left & passing
    assert ("sequence-whole" in left) == (name == "training_run")
    assert rows.count() > 0

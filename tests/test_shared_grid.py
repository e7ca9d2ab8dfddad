"""Queries that read the metric grid several times make it once."""

import datetime

import pytest

from surgecast import checks
from surgecast.operators import cleaning
from surgecast.sources import tables


@pytest.mark.parametrize("name", ["status_rollup", "exported_gauges"])
def test_grid_is_binned_and_cleaned_once(spark, tmp_path, monkeypatch, name):
    start = datetime.datetime(2025, 3, 1)
    rows = [(i, start + datetime.timedelta(hours=2 * (i // 2)), 10 * (i % 2), "view", 5.0 + i % 7, '{"k": 1}') for i in range(120)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    calls = []
    for module, step in ((tables, "bin_samples"), (cleaning, "clean")):
        monkeypatch.setattr(module, step, lambda *a, f=getattr(module, step), n=step, **k: calls.append(n) or f(*a, **k))
    made = checks.load()["QUERIES"][name](spark, str(tmp_path))
    assert sorted(calls) == ["bin_samples", "clean"]
    assert {r["deployment"] for r in made.select("deployment").distinct().collect()} == {"app-0", "app-1"}

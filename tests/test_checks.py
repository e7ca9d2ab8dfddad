"""Registered queries against their SQL twins, on the smallest tables.

``ALL_CHECKS=1`` runs every query; by default a sample of each area runs.
"""

import os

import pytest

import __spark_entry__ as contract
from surgecast import checks
from surgecast.checks.compare import compare, duck

REG = checks.load()
SAMPLE = [
    "scan_metrics_csv", "fetch_latest", "snapshot", "range_fetch", "backfill", "dedup_last", "latest_rows", "counter_rate",
    "latency_p99", "traffic_rates", "interpolate", "supplier_features", "scale_minmax", "training_windows", "seasonal_naive",
    "prediction_results", "adaptive_weights", "decide", "guard_decisions", "prune_versions", "frequent_events_alert",
    "replica_alignment", "streaming_bins",
]
NAMES = list(REG["SQL"]) if os.environ.get("ALL_CHECKS") else SAMPLE


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, sf_dir, con, name):
    assert compare(REG["QUERIES"][name](spark, sf_dir), con, REG["SQL"][name]) == []


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    df = contract.entry(spark)
    assert df.count() > 0 and "replicas" in df.columns

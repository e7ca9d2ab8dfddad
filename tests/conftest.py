import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from surgecast import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    spark = session.build("local[4]", shuffle_partitions=4, memory="4g")
    yield spark
    session.clear_scratch(spark)
    spark.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


def service_minutes(n, seed=11, start="2025-11-03 06:00"):
    """Minutes of one service: a load with a slow wave and a sawtooth, and metrics that follow it."""
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    load = 0.55 + 0.2 * np.cos(t / 37) + 0.1 * ((t % 23) / 23) + rng.uniform(-0.04, 0.04, n)
    return pd.DataFrame(
        {
            "s": "a",
            "ts": pd.date_range(start, periods=n, freq="min"),
            "cpu_usage": load,
            "memory_usage": 2.2e8 * (1 + load) + rng.uniform(-1e6, 1e6, n),
            "request_rate": np.round(340 * load + rng.normal(0, 9, n), 2),
            "response_latency_p99": 0.02 + 0.06 * load**2 + rng.gamma(2.0, 0.004, n),
            "error_rate": rng.binomial(4, 0.15, n) / 2.0,
            "ready_replicas": 7.0,
        }
    )


def skewed_series(n=900, seed=7, gap=400.0):
    """Irregular rows of four series, one of which holds a third of them."""
    rng = np.random.default_rng(seed)
    keys = rng.choice(["hot", "b", "c", "d"], n, p=[0.34, 0.22, 0.22, 0.22])
    us = 1_770_000_000_000_000 + np.cumsum(rng.exponential(gap, n) * 1e6).astype("int64")
    pdf = pd.DataFrame({"s": keys, "ts": pd.to_datetime(us, unit="us"), "us": us, "seq": np.arange(n)})
    pdf["v"] = np.round(rng.normal(10, 3, n), 3)
    pdf["gappy"] = pdf["v"].where(rng.random(n) > 0.4)
    return pdf

"""Plans: filters and columns reach the scan, nothing is paired or windowed as a whole."""

import re

import pytest
from pyspark.sql import functions as F

from surgecast import checks
from surgecast.operators import features, fetch, rates
from surgecast.sources import tables

REG = checks.load()


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_scan_is_pruned_and_filtered(spark, sf_dir):
    rows = tables.read_table(spark, sf_dir, "lineitem").filter(F.col("l_suppkey") == 3).select("l_suppkey", "l_quantity")
    text = plan(rates.gauge_on_grid(rows.withColumn("ts", F.lit("2026-01-01").cast("timestamp")), ["l_suppkey"], ["l_suppkey"], "ts", "l_quantity"))
    assert "EqualTo(l_suppkey,3)" in text
    assert re.search(r"ReadSchema: struct<l_suppkey:bigint,l_quantity:double>", text)


def test_literal_prefix_is_a_pushed_filter(spark, sf_dir):
    rows = tables.read_table(spark, sf_dir, "lineitem").filter(fetch.label_matches("l_returnflag", "A.*"))
    assert "StringStartsWith(l_returnflag,A)" in plan(rows)
    assert "RLIKE" in plan(tables.read_table(spark, sf_dir, "lineitem").filter(fetch.label_matches("l_returnflag", "[AN].*")))


CHEAP = ["replicas_needed", "counter_rate", "range_fetch", "supplier_features", "interpolate", "prediction_history", "as_of", "latency_p99", "latest_rows"]


@pytest.mark.parametrize("name", [n for n in CHEAP if n in REG["QUERIES"] and n != "prediction_history"])
def test_no_cartesian_and_no_global_window(spark, sf_dir, name):
    text = plan(REG["QUERIES"][name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for args in re.findall(r"\) Window\nInput.*\nArguments: (.*)", text):
        assert not re.search(r"\], \[\],|^\[\], ", args), args


def test_row_features_share_one_sort(spark, sf_dir):
    rows = tables.read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    out = features.row_features(
        rows, ["l_suppkey"], "l_shipdate", ["l_quantity"], order=["l_shipdate", "l_orderkey", "l_linenumber"], rolling=(5, 15, 60), lags=(15, 60), difference=True
    )
    text = plan(out)
    by_block = [a for a in re.findall(r"\) Sort\nInput.*\nArguments: (.*)", text) if "_block" in a]
    assert len(by_block) == 1

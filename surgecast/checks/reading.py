"""Scans, fetches, label filters and buffer operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import buffer, cleaning, fetch
from ..session import scratch_dir
from ..sources import catalog, files
from ..sources.tables import METRICS, SERIES, read_table, samples
from .base import BINNED, FRAME, KEYS, SAMPLES, STEP_S, ceil_ts, floor_ts, frame, query, r, rounded, rs

AT = "2024-01-15 12:00:00"

# Long samples: three metrics taken from the events, and their SQL.
LONG = f"""{SAMPLES},
long AS (
  SELECT {KEYS}, 'cpu_usage' AS metric, ts, seq, value FROM samples
  UNION ALL SELECT {KEYS}, 'memory_usage', ts, seq, value * 10 FROM samples WHERE status_code = '200'
  UNION ALL SELECT {KEYS}, 'error_rate', ts, seq, 1.0 FROM samples WHERE status_code = '503')"""
LONG_METRICS = ["cpu_usage", "memory_usage", "error_rate"]


def long_samples(spark, sf_dir):
    """One row per (sample, metric): a single scan, exploded."""
    rows = samples(spark, sf_dir)
    entry = lambda name, value, when: F.when(when, F.struct(F.lit(name).alias("metric"), value.alias("value")))
    entries = F.array_compact(
        F.array(
            entry("cpu_usage", F.col("value"), F.lit(True)),
            entry("memory_usage", F.col("value") * 10, F.col("status_code") == "200"),
            entry("error_rate", F.lit(1.0), F.col("status_code") == "503"),
        )
    )
    return rows.select(*SERIES, "ts", "seq", F.explode(entries).alias("e")).select(*SERIES, "e.metric", "ts", "seq", "e.value")


@query(
    "scan_metrics_csv",
    "A1 A2",
    f"WITH {BINNED} SELECT {KEYS}, ts AS timestamp, {rs(METRICS)} FROM binned",
)
def scan_metrics_csv(spark, sf_dir):
    from ..sources.tables import bin_samples

    path = scratch_dir(spark, "metrics-csv")
    files.write_metrics_csv(bin_samples(samples(spark, sf_dir), STEP_S).withColumnRenamed("ts", "timestamp"), path)
    return rounded(files.read_metrics_csv(spark, path, files.metrics_schema(SERIES, METRICS)))


@query(
    "scan_metrics_parquet",
    "A1 A2 B3",
    f"WITH {BINNED} SELECT {KEYS}, ts, {r('cpu_usage')} FROM binned WHERE namespace = 'prod' AND ts >= TIMESTAMP '{AT}'",
)
def scan_metrics_parquet(spark, sf_dir):
    from ..sources.tables import bin_samples

    path = scratch_dir(spark, "metrics-parquet")
    files.write_metrics_parquet(bin_samples(samples(spark, sf_dir), STEP_S), path, ["namespace"])
    rows = fetch.label_equals(spark.read.parquet(path), namespace="prod").filter(F.col("ts") >= F.lit(AT).cast("timestamp"))
    return rounded(rows.select(*SERIES, "ts", "cpu_usage"))


@query(
    "fetch_latest",
    "A3",
    f"""WITH {SAMPLES} SELECT {KEYS}, pod, max(ts) AS ts,
    TRY_CAST(arg_max(CASE WHEN status_code = '503' THEN 'n/a' ELSE raw END, (ts, seq)) AS DOUBLE) AS value
    FROM samples GROUP BY ALL""",
)
def fetch_latest(spark, sf_dir):
    """Latest value per pod; error samples carry text that is no number."""
    rows = samples(spark, sf_dir).withColumn("raw", F.when(F.col("status_code") == "503", "n/a").otherwise(F.col("raw")))
    return fetch.fetch_latest(rows, [*SERIES, "pod"], "ts", "raw", order=["ts", "seq"])


@query(
    "snapshot",
    "A4",
    f"""WITH {LONG} SELECT {KEYS}, {', '.join(f"arg_max(value, (ts, seq)) FILTER (metric = '{m}') AS {m}" for m in LONG_METRICS)}
    FROM long WHERE ts <= TIMESTAMP '{AT}' GROUP BY ALL""",
)
def snapshot(spark, sf_dir):
    return fetch.snapshot(long_samples(spark, sf_dir), SERIES, LONG_METRICS, AT, order=["ts", "seq"])


GRID_1H = f"""bounds AS (
  SELECT {KEYS}, metric, {ceil_ts(3600, 'min(ts)')} AS lo, max(ts) AS hi FROM long GROUP BY ALL),
points AS (SELECT {KEYS}, metric, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM bounds),
ends AS (
  SELECT {KEYS}, metric, ts, value FROM long
  QUALIFY row_number() OVER (PARTITION BY {KEYS}, metric, ts ORDER BY seq DESC) = 1),
stepped AS (
  SELECT p.namespace, p.deployment, p.metric, p.ts, e.value FROM points p
  ASOF LEFT JOIN ends e ON p.namespace = e.namespace AND p.deployment = e.deployment AND p.metric = e.metric AND p.ts >= e.ts)"""

GRID_72H = GRID_1H.replace(f"{ceil_ts(3600, 'min(ts)')} AS lo, max(ts) AS hi", f"TIMESTAMP '{AT}' - INTERVAL 72 HOURS AS lo, TIMESTAMP '{AT}' AS hi")


@query("range_fetch", "A5", f"WITH {LONG}, {GRID_1H} SELECT {KEYS}, metric, ts, value FROM stepped")
def range_fetch(spark, sf_dir):
    return fetch.range_fetch(long_samples(spark, sf_dir), [*SERIES, "metric"], "ts", "value", step_s=3600, order=["seq"])


@query(
    "long_to_wide",
    "A6",
    f"""WITH {SAMPLES} SELECT {KEYS}, {floor_ts(3600)} AS ts,
    {', '.join(r(f"sum(value) FILTER (status_code = '{s}')", f"s{s}") for s in ('200', '201', '503'))}
    FROM samples GROUP BY ALL""",
)
def long_to_wide(spark, sf_dir):
    from ..plans.blocks import floor_to, micros

    rows = samples(spark, sf_dir).withColumn("ts", F.timestamp_micros(floor_to(micros("ts"), 3600)))
    rows = rows.withColumn("series", F.concat(F.lit("s"), F.col("status_code")))
    return rounded(fetch.long_to_wide(rows, "ts", "series", "value", ["s200", "s201", "s503"], SERIES, "sum"))


@query(
    "backfill",
    "A7",
    f"""WITH {LONG.replace('long AS', 'every_sample AS')},
    long AS (SELECT * FROM every_sample WHERE ts >= TIMESTAMP '{AT}' - INTERVAL 96 HOURS AND ts <= TIMESTAMP '{AT}'), {GRID_72H}
    SELECT {KEYS}, ts, {', '.join(f"max(value) FILTER (metric = '{m}') AS {m}" for m in LONG_METRICS)}
    FROM stepped WHERE value IS NOT NULL GROUP BY ALL""",
)
def backfill(spark, sf_dir):
    return fetch.backfill(
        long_samples(spark, sf_dir), SERIES, LONG_METRICS, as_of_time=AT, hours=72, step_s=3600, order=["seq"]
    )


@query(
    "source_health",
    "A8",
    f"WITH {SAMPLES} SELECT {KEYS}, count(*) > 0 AS healthy, max(ts) AS newest FROM samples GROUP BY ALL",
)
def source_health(spark, sf_dir):
    return fetch.source_health(samples(spark, sf_dir), "ts", SERIES)


CATALOG_SQL = "catalog(metric, category, unit, critical) AS (VALUES " + ", ".join(
    f"('{n}', '{c}', '{u}', {str(k).lower()})" for n, c, u, k in catalog.DEFAULT_METRICS
) + ")"


@query(
    "tag_samples",
    "A9",
    f"""WITH {LONG}, {CATALOG_SQL} SELECT metric, category, unit, critical, count(*) AS n, {r('sum(value)', 'total', 4)}
    FROM long JOIN catalog USING (metric) WHERE critical GROUP BY ALL""",
)
def tag_samples(spark, sf_dir):
    tagged = catalog.tag(long_samples(spark, sf_dir), catalog.metric_catalog(spark), critical_only=True)
    grouped = tagged.groupBy("metric", "category", "unit", "critical")
    return rounded(grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4)


@query(
    "catalog_upsert",
    "A9",
    f"""WITH {LONG} SELECT metric, CASE metric WHEN 'error_rate' THEN 'errors' ELSE 'share' END AS unit,
    count(*) AS n FROM long WHERE metric IN ('error_rate', 'cpu_usage') GROUP BY ALL""",
)
def catalog_upsert(spark, sf_dir):
    """Redefine two metrics, then count their samples under the new definition."""
    base = catalog.metric_catalog(spark)
    new = catalog.register(base, [("error_rate", "health", "x", True), ("cpu_usage", "resource", "share", True), ("error_rate", "health", "errors", True)])
    tagged = catalog.tag(long_samples(spark, sf_dir), new.filter(F.col("unit").isin("share", "errors")))
    return tagged.groupBy("metric", "unit").agg(F.count(F.lit(1)).alias("n"))


@query(
    "select_targets",
    "A10 B1",
    f"""WITH {SAMPLES}, targets AS (SELECT DISTINCT {KEYS} FROM samples WHERE value > 400)
    SELECT {KEYS}, count(*) AS n, {r('sum(value)', 'total', 4)} FROM samples SEMI JOIN targets USING ({KEYS}) GROUP BY ALL""",
)
def select_targets(spark, sf_dir):
    """Samples of the deployments that ever exceeded 400."""
    rows = samples(spark, sf_dir)
    chosen = fetch.select_targets(rows, rows.filter(F.col("value") > 400), SERIES)
    return rounded(chosen.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4)


@query(
    "label_equality",
    "B1",
    f"WITH {SAMPLES} SELECT pod, ts, status_code, value FROM samples WHERE namespace = 'prod' AND deployment = 'app-4'",
)
def label_equality(spark, sf_dir):
    rows = fetch.label_equals(samples(spark, sf_dir), namespace="prod", deployment="app-4")
    return rows.select("pod", "ts", "status_code", "value")


@query(
    "label_regex",
    "B2",
    f"""WITH {SAMPLES} SELECT pod, status_code, count(*) AS n FROM samples
    WHERE regexp_full_match(pod, 'app-1.*') AND regexp_full_match(status_code, '5..|201') GROUP BY ALL""",
)
def label_regex(spark, sf_dir):
    rows = samples(spark, sf_dir).filter(fetch.label_matches("pod", "app-1.*") & fetch.label_matches("status_code", "5..|201"))
    return rows.groupBy("pod", "status_code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pods_of_deployment",
    "B2",
    f"WITH {SAMPLES} SELECT deployment, count(DISTINCT pod) AS pods FROM samples WHERE starts_with(pod, deployment) GROUP BY ALL",
)
def pods_of_deployment(spark, sf_dir):
    """The prefix pattern with the prefix taken from a column."""
    rows = samples(spark, sf_dir).filter(fetch.label_starts_with("pod", F.col("deployment")))
    pods = rows.groupBy("deployment", "pod").agg(F.count(F.lit(1)))
    return pods.groupBy("deployment").agg(F.count(F.lit(1)).alias("pods"))


@query(
    "retention_filter",
    "B3 D4",
    f"""WITH {SAMPLES} SELECT {KEYS}, count(*) AS n, min(ts) AS oldest FROM samples
    WHERE ts >= (SELECT max(ts) FROM samples) - INTERVAL 168 HOURS GROUP BY ALL""",
)
def retention_filter(spark, sf_dir):
    rows = samples(spark, sf_dir)
    kept = buffer.retain(rows, "ts", buffer.latest_time(rows, "ts"))
    return kept.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("oldest"))


@query(
    "drop_sparse_columns",
    "B4 B6",
    f"WITH {FRAME} SELECT {KEYS}, ts, {rs(METRICS)} FROM frame",
)
def drop_sparse_columns(spark, sf_dir):
    """Two columns that are mostly NULL are added and must be dropped again."""
    wide = frame(spark, sf_dir)
    wide = wide.withColumns(
        {
            "rare": F.when(F.col("error_rate") > 0.0004, F.col("error_rate")),
            "never": F.lit(None).cast("double"),
        }
    )
    numeric = cleaning.numeric_columns(wide)
    return rounded(cleaning.drop_sparse_columns(wide, numeric))


@query(
    "drop_null_rows",
    "B5",
    f"WITH {FRAME} SELECT {KEYS}, ts, {rs(METRICS)} FROM frame WHERE cpu_usage IS NOT NULL",
)
def drop_null_rows(spark, sf_dir):
    return rounded(cleaning.drop_null_rows(frame(spark, sf_dir)))


@query(
    "numeric_columns",
    "B6",
    f"SELECT sum(o_orderkey)::BIGINT AS o_orderkey, sum(o_custkey)::BIGINT AS o_custkey, {r('sum(o_totalprice)', 'o_totalprice', 2)} FROM orders",
)
def numeric_columns(spark, sf_dir):
    """Totals of the numeric columns, found from the schema."""
    orders = read_table(spark, sf_dir, "orders")
    return rounded(orders.agg(*[F.sum(c).alias(c) for c in cleaning.numeric_columns(orders)]), 2)


@query(
    "validate_index",
    "B7 D3",
    f"WITH {SAMPLES} SELECT {KEYS}, date_trunc('second', ts) AS ts, seq FROM samples",
)
def validate_index(spark, sf_dir):
    """Timestamps that arrive as text become TIMESTAMP, rows sorted by time."""
    text = samples(spark, sf_dir).select(*SERIES, F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "seq")
    return buffer.sort_by_time(cleaning.validate_index(text, "ts"), SERIES, "ts")


@query(
    "append_rows",
    "D1",
    f"""WITH {SAMPLES} SELECT {KEYS}, ts, value, NULL AS raw FROM samples WHERE namespace = 'prod'
    UNION ALL SELECT {KEYS}, ts, NULL, raw FROM samples WHERE namespace = 'staging'""",
)
def append_rows(spark, sf_dir):
    rows = samples(spark, sf_dir)
    first = rows.filter("namespace = 'prod'").select(*SERIES, "ts", "value")
    second = rows.filter("namespace = 'staging'").select("raw", "ts", *SERIES)
    return buffer.append(first, second)


@query(
    "dedup_last",
    "D2",
    f"""WITH {SAMPLES}, twice AS (
      SELECT {KEYS}, {floor_ts(3600)} AS ts, seq, value FROM samples
      UNION ALL SELECT {KEYS}, {floor_ts(3600)}, seq + 1000000000, value + 1 FROM samples WHERE status_code = '503')
    SELECT {KEYS}, ts, seq, value FROM twice QUALIFY row_number() OVER (PARTITION BY {KEYS}, ts ORDER BY seq DESC) = 1""",
)
def dedup_last(spark, sf_dir):
    from ..plans.blocks import floor_to, micros

    rows = samples(spark, sf_dir).select(*SERIES, F.timestamp_micros(floor_to(micros("ts"), 3600)).alias("ts"), "seq", "value", "status_code")
    again = rows.filter("status_code = '503'").withColumns({"seq": F.col("seq") + 1_000_000_000, "value": F.col("value") + 1})
    return buffer.dedup_last(buffer.append(rows, again).drop("status_code"), SERIES, "ts", "seq")


@query(
    "latest_rows",
    "D5",
    f"""WITH {SAMPLES} SELECT {KEYS}, ts, seq, value FROM samples
    QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY ts DESC, seq DESC) <= 60""",
)
def latest_rows(spark, sf_dir):
    rows = samples(spark, sf_dir).select(*SERIES, "ts", "seq", "value")
    return buffer.latest_rows(rows, SERIES, "ts", order=["ts", "seq"])


@query(
    "latest_rows_overall",
    "D5 D3",
    f"WITH {SAMPLES} SELECT {KEYS}, ts, seq, value FROM samples ORDER BY ts DESC, seq DESC LIMIT 60",
)
def latest_rows_overall(spark, sf_dir):
    return buffer.latest_rows_overall(samples(spark, sf_dir).select(*SERIES, "ts", "seq", "value"), ["ts", "seq"])


@query(
    "buffer_status",
    "D7",
    f"WITH {FRAME} SELECT {KEYS}, count(*) AS rows, 11 AS columns, min(ts) AS oldest, max(ts) AS newest FROM frame GROUP BY ALL",
)
def buffer_status(spark, sf_dir):
    return buffer.status(frame(spark, sf_dir), "ts", SERIES)

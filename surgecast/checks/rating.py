"""Counter rates, gauge roll-ups and histogram quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quantile
from ..operators import rates
from ..plans.blocks import slot_for
from ..session import materialise
from ..sources.tables import LATENCY_BOUNDS, SERIES, bucket_counter, samples, value_counter
from .base import KEYS, SAMPLES, ceil_ts, query, quantile_case, r, rounded

POD = [*SERIES, "pod", "status_code"]

COUNTER = f"""{SAMPLES},
counter AS (
  SELECT {KEYS}, pod, status_code, ts, seq,
         round(sum(value) OVER (PARTITION BY pod, status_code, ts::DATE ORDER BY ts, seq), 2) AS value
  FROM samples),
increases AS (
  SELECT *, CASE WHEN value < lag(value) OVER s THEN value ELSE value - lag(value) OVER s END AS inc
  FROM counter WINDOW s AS (PARTITION BY pod, status_code ORDER BY ts, seq))"""


def increases(spark, sf_dir):
    return rates.counter_increase(value_counter(spark, sf_dir), POD, "ts", "value", order=["ts", "seq"])


def grid_sql(table: str, by: str, sums: str, names: list[str], window_s: int, step_s: int, where: str = "TRUE", places: int = 6) -> str:
    """Rates at every grid point with a sample in its window, in SQL."""
    reach = window_s // step_s
    group = f"{by}, " if by else ""
    return f"""stepped AS (SELECT {group}{ceil_ts(step_s)} AS ts, {sums} FROM {table} WHERE {where} GROUP BY ALL),
spread AS (SELECT {group}ts + k * INTERVAL {step_s} SECONDS AS ts, {', '.join(names)} FROM stepped, range({reach}) AS t(k))
SELECT {group}ts, {', '.join(r(f'sum({n}) / {window_s}', n, places) for n in names)} FROM spread GROUP BY ALL"""


@query(
    "counter_increase",
    "C1",
    f"WITH {COUNTER} SELECT pod, status_code, ts, seq, {r('inc', 'increase')} FROM increases",
)
def counter_increase(spark, sf_dir):
    return rounded(increases(spark, sf_dir).select("pod", "status_code", "ts", "seq", "increase"))


@query(
    "counter_rate",
    "C1",
    f"""WITH {COUNTER} SELECT pod, status_code, ts, seq, {r('''sum(inc) OVER (PARTITION BY pod, status_code ORDER BY epoch_us(ts)
    RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) / 300''', 'rate')} FROM increases""",
)
def counter_rate(spark, sf_dir):
    """The five-minute rate at every sample of a counter that restarts daily."""
    rows = value_counter(spark, sf_dir)
    slot = slot_for(samples(spark, sf_dir), POD, "ts")
    out = rates.counter_rate(rows, POD, "ts", "value", order=["ts", "seq"], slot_s=slot)
    return rounded(out.select("pod", "status_code", "ts", "seq", "rate"))


@query("cpu_usage_by_pod", "C2", f"WITH {COUNTER}, {grid_sql('increases', f'{KEYS}, pod', 'sum(inc) AS cpu_usage', ['cpu_usage'], 300, 60)}")
def cpu_usage_by_pod(spark, sf_dir):
    return rounded(rates.rate_on_grid(increases(spark, sf_dir), [*SERIES, "pod"], "ts", {"cpu_usage": F.col("increase")}))


@query(
    "memory_usage_by_pod",
    "C3",
    f"""WITH {SAMPLES}, last AS (
      SELECT {KEYS}, pod, status_code, {ceil_ts(3600)} AS step, arg_max(value, (ts, seq)) AS v FROM samples GROUP BY ALL)
    SELECT {KEYS}, pod, step AS ts, {r('sum(v)', 'memory_usage')} FROM last GROUP BY ALL""",
)
def memory_usage_by_pod(spark, sf_dir):
    rows = samples(spark, sf_dir)
    return rounded(
        rates.gauge_on_grid(rows, POD, [*SERIES, "pod"], "ts", "value", step_s=3600, order=["ts", "seq"], name="memory_usage")
    )


@query("request_rate", "C4", f"WITH {COUNTER}, {grid_sql('increases', '', 'sum(inc) AS request_rate', ['request_rate'], 300, 60)}")
def request_rate(spark, sf_dir):
    return rounded(rates.rate_on_grid(increases(spark, sf_dir), [], "ts", {"request_rate": F.col("increase")}))


@query(
    "request_rate_by_status",
    "C5",
    f"WITH {COUNTER}, {grid_sql('increases', 'status_code', 'sum(inc) AS request_rate', ['request_rate'], 300, 60)}",
)
def request_rate_by_status(spark, sf_dir):
    return rounded(rates.rate_on_grid(increases(spark, sf_dir), ["status_code"], "ts", {"request_rate": F.col("increase")}))


@query(
    "error_rate",
    "C8 B2",
    f"WITH {COUNTER}, {grid_sql('increases', KEYS, 'sum(inc) AS error_rate', ['error_rate'], 300, 60, where='''status_code LIKE '5__' ''')}",
)
def error_rate(spark, sf_dir):
    errors = increases(spark, sf_dir).filter(rates.is_server_error("status_code"))
    return rounded(rates.rate_on_grid(errors, SERIES, "ts", {"error_rate": F.col("increase")}))


TRAFFIC = "sum(inc) AS request_rate, coalesce(sum(inc) FILTER (status_code LIKE '5__'), 0) AS error_rate"


@query("traffic_rates", "C4 C8", f"WITH {COUNTER}, {grid_sql('increases', KEYS, TRAFFIC, ['request_rate', 'error_rate'], 3600, 600)}")
def traffic_rates(spark, sf_dir):
    """Request and error rate from one scan of the counter."""
    inc = F.col("increase")
    sums = {"request_rate": inc, "error_rate": F.coalesce(F.when(rates.is_server_error("status_code"), inc), F.lit(0.0))}
    rows = increases(spark, sf_dir)
    return rounded(rates.rate_on_grid(rows, SERIES, "ts", sums, window_s=3600, step_s=600))


@query(
    "network_receive",
    "C9",
    f"WITH {COUNTER}, {grid_sql('increases', KEYS, 'sum(inc * 1000) AS network_receive', ['network_receive'], 300, 300)}",
)
def network_receive(spark, sf_dir):
    sums = {"network_receive": F.col("increase") * 1000}
    return rounded(rates.rate_on_grid(increases(spark, sf_dir), SERIES, "ts", sums, window_s=300, step_s=300))


@query(
    "pod_rollup",
    "C11",
    f"""WITH {COUNTER}, by_pod AS (
      SELECT {KEYS}, pod, {ceil_ts(3600)} AS ts, sum(inc) / 3600 AS cpu_usage FROM increases GROUP BY ALL)
    SELECT {KEYS}, ts, {r('sum(cpu_usage)', 'cpu_usage')}, count(*) AS pods FROM by_pod GROUP BY ALL""",
)
def pod_rollup(spark, sf_dir):
    """Per-pod rates summed to one column per deployment."""
    by_pod = rates.rate_on_grid(
        increases(spark, sf_dir), [*SERIES, "pod"], "ts", {"cpu_usage": F.col("increase")}, window_s=3600, step_s=3600
    )
    total = by_pod.groupBy(*SERIES, "ts").agg(F.sum("cpu_usage").alias("cpu_usage"), F.count(F.lit(1)).alias("pods"))
    return rounded(total)


@query(
    "replica_gauges",
    "C10",
    f"""WITH {SAMPLES}, steps AS (
      SELECT {KEYS}, {ceil_ts(3600)} AS ts, arg_max(user_id % 10 + 1, (ts, seq)) AS ready,
             max(user_id % 10 + 1) AS desired FROM samples GROUP BY ALL)
    SELECT {KEYS}, ts, ready::DOUBLE AS ready_replicas, desired::DOUBLE AS desired_replicas FROM steps""",
)
def replica_gauges(spark, sf_dir):
    """Gauge look-ups: last ready value and largest desired value per step."""
    rows = samples(spark, sf_dir).withColumn("g", (F.substring_index("pod", "-", -1).cast("int") % 10 + 1).cast("double"))
    ready = rates.gauge_on_grid(rows, SERIES, SERIES, "ts", "g", step_s=3600, order=["ts", "seq"], name="ready_replicas")
    desired = rates.gauge_on_grid(rows, SERIES, SERIES, "ts", "g", step_s=3600, order=["g", "ts"], name="desired_replicas")
    return ready.join(desired, [*SERIES, "ts"])


BUCKETS = f"""{SAMPLES},
numbered AS (
  SELECT {KEYS}, ts, seq, b.le AS le,
         sum(CASE WHEN b.le IS NULL OR value <= b.le THEN 1 ELSE 0 END) OVER (PARTITION BY {KEYS}, b.le ORDER BY ts, seq) AS value
  FROM samples, (VALUES {', '.join(f'({b}::DOUBLE)' for b in LATENCY_BOUNDS)}, (NULL)) AS b(le)),
increases AS (
  SELECT {KEYS}, le, ts, value - lag(value) OVER (PARTITION BY {KEYS}, le ORDER BY ts, seq) AS inc FROM numbered),
hourly AS (SELECT {KEYS}, le, {ceil_ts(3600)} AS ts, sum(inc) / 3600 AS rate FROM increases GROUP BY ALL),
wide AS (
  SELECT {KEYS}, ts, {', '.join(f'max(rate) FILTER (le = {b}) AS c{i}' for i, b in enumerate(LATENCY_BOUNDS))},
         max(rate) FILTER (le IS NULL) AS n
  FROM hourly GROUP BY ALL)"""
_C = [f"c{i}" for i in range(len(LATENCY_BOUNDS))]


@query("bucket_increase", "C6", f"WITH {BUCKETS} SELECT {KEYS}, coalesce(le, -1) AS le, ts, {r('rate')} FROM hourly")
def bucket_increase(spark, sf_dir):
    """Bucket rates per hour, the input of the latency quantiles."""
    return rounded(bucket_rates(spark, sf_dir).withColumn("le", F.coalesce("le", F.lit(-1.0))))


def bucket_rates(spark, sf_dir):
    """The overflow bound is NULL, so it is replaced while it serves as a series key."""
    counters = bucket_counter(spark, sf_dir).withColumn("le", F.coalesce("le", F.lit(-1.0)))
    inc = rates.counter_increase(counters, [*SERIES, "le"], "ts", "value", order=["ts", "seq"])
    hourly = rates.rate_on_grid(inc, [*SERIES, "le"], "ts", {"rate": F.col("increase")}, window_s=3600, step_s=3600)
    return hourly.withColumn("le", F.when(F.col("le") >= 0, F.col("le")))


@query("latency_p99", "C6", f"WITH {BUCKETS} SELECT {KEYS}, ts, {r(quantile_case(0.99, _C, 'n'), 'response_latency_p99')} FROM wide")
def latency_p99(spark, sf_dir):
    q = rates.quantile_by_bucket(bucket_rates(spark, sf_dir), [*SERIES, "ts"], {"response_latency_p99": 0.99}, value="rate")
    return rounded(q)


@query("latency_p50", "C7", f"WITH {BUCKETS} SELECT {KEYS}, ts, {r(quantile_case(0.5, _C, 'n'), 'response_latency_p50')} FROM wide")
def latency_p50(spark, sf_dir):
    q = rates.quantile_by_bucket(bucket_rates(spark, sf_dir), [*SERIES, "ts"], {"response_latency_p50": 0.5}, value="rate")
    return rounded(q)


@query(
    "raw_quantiles",
    "C7",
    f"""WITH {SAMPLES} SELECT {KEYS}, date_trunc('day', ts)::TIMESTAMP AS ts, count(value) AS n, quantile_disc(value, 0.99) AS p99, TRUE AS within_bound
    FROM samples GROUP BY ALL""",
)
def raw_quantiles(spark, sf_dir):
    """The 99th percentile of raw observations per day, exact, and whether that from merged hourly sketches is within its rank error."""
    rows = samples(spark, sf_dir).select(*SERIES, "ts", F.col("value").cast("double").alias("value"))
    hours = rows.groupBy(*SERIES, F.date_trunc("hour", "ts").alias("hour")).agg(quantile.quantile_sketch(F.col("value")).alias("sketch"))
    days = materialise(hours, "sketches").groupBy(*SERIES, F.date_trunc("day", "hour").alias("day")).agg(quantile.merged_sketch(F.col("sketch")).alias("sketch"))
    told = days.select(*SERIES, F.col("day").alias("ts"), quantile.sketched_quantile(F.col("sketch"), 0.99).alias("told"))
    placed = rows.withColumn("ts", F.date_trunc("day", "ts")).join(told, [*SERIES, "ts"])
    below, upto = (F.avg(F.when(c, 1.0).otherwise(0.0)) for c in (F.col("value") < F.col("told"), F.col("value") <= F.col("told")))
    # A value holds all ranks between the share below it and the share up to it.
    within = (below - quantile.RANK_ERROR <= 0.99) & (upto + quantile.RANK_ERROR >= 0.99)
    exact = F.expr("percentile_disc(0.99) within group (order by value)")
    return placed.groupBy(*SERIES, "ts").agg(F.count("value").alias("n"), exact.alias("p99"), within.alias("within_bound"))

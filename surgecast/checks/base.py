"""Registration of queries with their SQL twins, and shared SQL fragments.

The fragments state the same mappings as ``sources.tables`` in plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure
from ..sources.tables import LATENCY_BOUNDS, METRICS, SERIES, metrics_from_events

STEP_S = 7200
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query under ``name`` for the inventory entries in ``covers``."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        COVERS[name] = covers.split()
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def places_for(name: str, places: int) -> int:
    """Small per-second rates keep three more places."""
    return places + 3 if "request_rate" in name or "error_rate" in name else places


def off_tie(places: int) -> float:
    return 3.1 * 10.0 ** -(places + 2)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every DOUBLE column, so that summation order does not show.

    Values are moved by a fixed small amount first, because half-way cases such as 0.0625
    would round by the last bit of a sum.
    """
    return df.select(
        *[
            F.round(F.col(f.name) + off_tie(places_for(f.name, places)), places_for(f.name, places)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_from_events(spark, sf_dir, STEP_S)


def r(expr: str, name: str | None = None, places: int = 6) -> str:
    """The SQL side of :func:`rounded`."""
    name = name or expr
    digits = places_for(name, places)
    return f"round(CAST({expr} AS DOUBLE) + {off_tie(digits)!r}::DOUBLE, {digits}) AS {name}"


def rs(names, places: int = 6) -> str:
    return ", ".join(r(n, places=places) for n in names)


KEYS = ", ".join(SERIES)
BY = f"PARTITION BY {KEYS} ORDER BY ts"


def floor_ts(step_s: int, ts: str = "ts") -> str:
    return f"make_timestamp(epoch_us({ts}) - epoch_us({ts}) % {step_s * 1_000_000})"


def ceil_ts(step_s: int, ts: str = "ts") -> str:
    w = step_s * 1_000_000
    return f"make_timestamp(epoch_us({ts}) + ({w} - epoch_us({ts}) % {w}) % {w})"


def quantile_case(q: float, counts: list[str], total: str) -> str:
    rank = f"({q} * {total})"
    arms, lower, below = [], 0.0, "0"
    for bound, c in zip(LATENCY_BOUNDS, counts):
        arms.append(f"WHEN {rank} <= {c} THEN {lower} + ({bound} - {lower}) * ({rank} - {below}) / nullif({c} - {below}, 0)")
        lower, below = bound, c
    return f"CASE WHEN {total} IS NULL OR {total} = 0 THEN NULL {' '.join(arms)} ELSE {lower} END"


SAMPLES = """samples AS (
  SELECT event_id AS seq, ts,
         CASE WHEN (user_id // 10) % 2 = 0 THEN 'prod' ELSE 'staging' END AS namespace,
         'app-' || (user_id // 10) AS deployment,
         'app-' || (user_id // 10) || '-pod-' || user_id AS pod,
         CASE event_type WHEN 'error' THEN '503' WHEN 'signup' THEN '201' ELSE '200' END AS status_code,
         value, json_extract_string(props, '$.k') AS raw, user_id, event_type
  FROM events)"""

COUNTS = [f"c{i}" for i in range(len(LATENCY_BOUNDS))]

BINNED = f"""{SAMPLES},
sums AS (
  SELECT {KEYS}, {floor_ts(STEP_S)} AS ts, CAST(count(*) AS DOUBLE) AS n, sum(value) AS s,
         count(*) FILTER (status_code LIKE '5%') AS err, max(user_id % 10) AS top,
         {', '.join(f'CAST(count(*) FILTER (value <= {b}) AS DOUBLE) AS {c}' for b, c in zip(LATENCY_BOUNDS, COUNTS))}
  FROM samples GROUP BY ALL),
binned AS (
  SELECT {KEYS}, ts, s / 10 AS cpu_usage, s / n * 10 AS memory_usage, n / {STEP_S} AS request_rate,
         {quantile_case(0.99, COUNTS, 'n')} AS response_latency_p99,
         {quantile_case(0.5, COUNTS, 'n')} AS response_latency_p50,
         err / {STEP_S} AS error_rate, s * 1000 / {STEP_S} AS network_receive,
         CAST(top + 1 AS DOUBLE) AS ready_replicas
  FROM sums)"""

FRAME = f"""{BINNED},
spans AS (SELECT {KEYS}, min(ts) AS lo, max(ts) AS hi FROM binned GROUP BY ALL),
grid AS (SELECT {KEYS}, unnest(generate_series(lo, hi, INTERVAL {STEP_S} SECONDS)) AS ts FROM spans),
frame AS (SELECT {KEYS}, ts, {', '.join(METRICS)} FROM grid LEFT JOIN binned USING ({KEYS}, ts))"""

PRIMARY = ["cpu_usage", "memory_usage", "request_rate", "response_latency_p99", "error_rate"]


def _interpolated(cols) -> str:
    known = ", ".join(
        f"last_value(CASE WHEN {c} IS NOT NULL THEN {{'t': epoch_us(ts), 'v': {c}}} END IGNORE NULLS) OVER p AS p_{c}, "
        f"first_value(CASE WHEN {c} IS NOT NULL THEN {{'t': epoch_us(ts), 'v': {c}}} END IGNORE NULLS) OVER n AS n_{c}"
        for c in cols
    )
    value = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN p_{c} IS NULL THEN n_{c}.v WHEN n_{c} IS NULL THEN p_{c}.v "
        f"ELSE p_{c}.v + (n_{c}.v - p_{c}.v) * (epoch_us(ts) - p_{c}.t) / (n_{c}.t - p_{c}.t) END AS {c}"
        for c in cols
    )
    return f"""known AS (
  SELECT *, {known} FROM frame
  WINDOW p AS ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         n AS ({BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
interpolated AS (SELECT {KEYS}, ts, {value} FROM known)"""


def _clipped(cols) -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in cols)
    value = ", ".join(
        f"CASE WHEN s_{c} > 0 AND {c} < m_{c} - 4 * s_{c} THEN m_{c} - 4 * s_{c} "
        f"WHEN s_{c} > 0 AND {c} > m_{c} + 4 * s_{c} THEN m_{c} + 4 * s_{c} ELSE {c} END AS {c}"
        for c in cols
    )
    return f"""stats AS (SELECT {KEYS}, {stats} FROM interpolated GROUP BY ALL),
cleaned AS (SELECT i.namespace, i.deployment, ts, {value} FROM interpolated i JOIN stats s USING ({KEYS}))"""


INTERPOLATED = f"{FRAME},\n{_interpolated(METRICS)}"
CLEANED = f"{INTERPOLATED},\n{_clipped(METRICS)}"

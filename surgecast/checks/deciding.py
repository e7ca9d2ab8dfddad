"""Scaling decisions and safety rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions, ensemble, features
from ..operators.decisions import DecisionConfig, GuardConfig
from ..plans.blocks import OWN, POS, block_window, own_rows, row_blocks, with_positions
from ..session import materialise, release
from ..sources.tables import SERIES, read_table
from .base import BY, CLEANED, FRAME, KEYS, frame, query, rounded, rs
from .preparing import cleaned

# Decision inputs of every step: the peak is the mean of the last twelve rows plus half
# their deviation, the confidence falls with the deviation, and the current replicas are
# what the step before needed.
INPUTS = f"""{CLEANED},
needs AS (SELECT *, CASE WHEN cpu_usage IS NOT NULL AND NOT isnan(cpu_usage) THEN greatest(2, least(50, ceil(cpu_usage::FLOAT::DOUBLE / 0.7::DOUBLE)))::INT END AS need FROM cleaned),
spread AS (
  SELECT {KEYS}, ts, avg(cpu_usage) OVER w AS m, coalesce(stddev_samp(cpu_usage) OVER w, 0) AS s,
         coalesce(lag(need) OVER ({BY}), 2)::INT AS current_replicas
  FROM needs WINDOW w AS ({BY} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
inputs AS (
  SELECT {KEYS}, ts, (m + 0.5 * s)::FLOAT::DOUBLE AS predicted_peak, exp(-0.3 * s / (m + 1e-8)) AS confidence, current_replicas
  FROM spread)"""


def decision_inputs(spark, sf_dir, clean=None):
    rows = (cleaned(spark, sf_dir) if clean is None else clean).select(*SERIES, "ts", "cpu_usage")
    rows = rows.withColumn("need", ensemble.replicas_for(F.col("cpu_usage").cast("float").cast("double")))
    out = features.row_features(rows, SERIES, "ts", ["cpu_usage", "need"], rolling=[12], lags=[1], slot_s=30 * 86400)
    mean, std = F.col("cpu_usage_rolling_mean_12m"), F.col("cpu_usage_rolling_std_12m")
    return out.select(
        *SERIES,
        "ts",
        (mean + 0.5 * std).cast("float").cast("double").alias("predicted_peak"),
        F.exp(-0.3 * std / (mean + 1e-8)).alias("confidence"),
        F.coalesce("lag_need_1m", F.lit(2)).cast("int").alias("current_replicas"),
    )


def decide_sql(source: str, util="0.7::DOUBLE", lo="2", hi="50", threshold="0.7", band="1", threshold_text="'0.7'") -> str:
    lost = "predicted_peak IS NULL OR isnan(predicted_peak)"
    blind = "confidence IS NULL OR isnan(confidence)"
    hold = f"{blind} OR confidence < {threshold} OR {lost} OR current_replicas IS NULL OR abs(need - current_replicas) <= {band}"
    need = f"CASE WHEN {lost} THEN NULL WHEN {util} > 0 THEN greatest({lo}, least({hi}, ceil(predicted_peak / {util})))::INT ELSE greatest({lo}, least({hi}, current_replicas))::INT END"
    return f"""(SELECT *,
      CASE WHEN {hold} THEN current_replicas ELSE need END AS target_replicas,
      CASE WHEN {hold} THEN 'none' WHEN need > current_replicas THEN 'up' ELSE 'down' END AS direction,
      CASE WHEN {blind} THEN 'Prediction confidence is unknown'
           WHEN confidence < {threshold} THEN printf('Prediction confidence (%.2f) below threshold (%s)', confidence, {threshold_text})
           WHEN {lost} THEN 'Predicted peak is unknown'
           WHEN current_replicas IS NULL THEN 'Current replicas are unknown'
           WHEN abs(need - current_replicas) <= {band} THEN printf('Target (%d) within dead-band of current (%d)', need, current_replicas)
           ELSE printf('Predicted peak %.2f requires %d replicas (target util %.0f%%), currently %d', predicted_peak, need, {util} * 100, current_replicas) END AS reason,
      NOT ({blind} OR confidence < {threshold} OR {lost} OR current_replicas IS NULL) AS approved
    FROM (SELECT *, {need} AS need FROM {source}))"""


DECISIONS = f"{INPUTS},\ndecisions AS {decide_sql('inputs')}"
D_COLS = f"{KEYS}, ts, current_replicas, target_replicas, direction, approved"


def decided(spark, sf_dir, clean=None):
    return decisions.decide(materialise(decision_inputs(spark, sf_dir, clean), "decision-inputs"))


@query(
    "decision_inputs",
    "J6",
    f"WITH {INPUTS} SELECT {KEYS}, ts, {rs(['predicted_peak'], 5)}, {rs(['confidence'])}, current_replicas FROM inputs",
)
def inputs(spark, sf_dir):
    out = decision_inputs(spark, sf_dir)
    return rounded(out.drop("predicted_peak")).join(rounded(out.select(*SERIES, "ts", "predicted_peak"), 5), [*SERIES, "ts"])


@query("decide", "K1 K2 K3 K4", f"WITH {DECISIONS} SELECT {D_COLS}, reason FROM decisions")
def decide(spark, sf_dir):
    return decided(spark, sf_dir).select(*SERIES, "ts", "current_replicas", "target_replicas", "direction", "approved", "reason")


@query(
    "replicas_needed",
    "K2 J6 C4",
    f"""WITH {FRAME}, peaks AS (SELECT {KEYS}, ts, max(cpu_usage) OVER ({BY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)::FLOAT::DOUBLE AS predicted_peak,
      request_rate FROM frame)
    SELECT {KEYS}, ts, {rs(['predicted_peak'], 5)}, {rs(['request_rate'])},
      CASE WHEN predicted_peak IS NULL THEN 2 ELSE greatest(2, least(50, ceil(predicted_peak / 0.7::DOUBLE)))::INT END AS replicas FROM peaks""",
)
def replicas_needed(spark, sf_dir):
    """Flagship: replicas each deployment needs for the peak of its last five steps."""
    rows = frame(spark, sf_dir).select(*SERIES, "ts", "cpu_usage", "request_rate")
    blocks = row_blocks(with_positions(rows, SERIES, "ts", slot_s=30 * 86400), size=4096, back=4)
    peak = F.max("cpu_usage").over(block_window(SERIES, [POS]).rowsBetween(-4, 0)).cast("float").cast("double")
    out = own_rows(blocks.select(*SERIES, "ts", "request_rate", "_block", OWN, peak.alias("predicted_peak")))
    # A step without a known peak in reach keeps the minimum.
    need = F.coalesce(ensemble.replicas_for(F.col("predicted_peak")), F.lit(ensemble.MIN_REPLICAS))
    out = out.withColumn("replicas", need)
    return out.select(
        *SERIES,
        "ts",
        F.round(F.col("predicted_peak") + 3.1e-7, 5).alias("predicted_peak"),
        F.round(F.col("request_rate") + 3.1e-11, 9).alias("request_rate"),
        "replicas",
    )


CONFIGS = [
    ("default", DecisionConfig()),
    ("eager", DecisionConfig(target_utilization=0.5, confidence_threshold=0.5, dead_band=0)),
    ("capped", DecisionConfig(max_replicas=10, min_replicas=3, confidence_threshold=0.5)),
]


@query(
    "what_if",
    "K9",
    f"WITH {INPUTS} "
    + " UNION ALL ".join(
        f"SELECT {D_COLS}, '{n}' AS config FROM "
        + decide_sql("inputs", f"{c.target_utilization}::DOUBLE", c.min_replicas, c.max_replicas, c.confidence_threshold, c.dead_band)
        for n, c in CONFIGS
    ),
)
def what_if(spark, sf_dir):
    out = decisions.what_if(decision_inputs(spark, sf_dir), CONFIGS)
    return out.select(*SERIES, "ts", "current_replicas", "target_replicas", "direction", "approved", "config")


@query(
    "orders_what_if",
    "K9",
    "WITH inputs AS (SELECT o_orderkey, (o_totalprice / 10000)::FLOAT::DOUBLE AS predicted_peak, 0.2 + (o_custkey % 9) / 10.0::DOUBLE AS confidence, "
    "(2 + o_orderkey % 30)::INT AS current_replicas FROM orders) "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS config, direction, count(*) AS cases, sum(target_replicas)::BIGINT AS replicas FROM "
        + decide_sql("inputs", f"{c.target_utilization}::DOUBLE", c.min_replicas, c.max_replicas, c.confidence_threshold, c.dead_band)
        + " GROUP BY ALL"
        for n, c in CONFIGS
    ),
)
def orders_what_if(spark, sf_dir):
    """Volume run: every order as a scaling case under three configurations."""
    cases = read_table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_totalprice") / 10000).cast("float").cast("double").alias("predicted_peak"),
        (0.2 + (F.col("o_custkey") % 9) / 10.0).alias("confidence"),
        (2 + F.col("o_orderkey") % 30).cast("int").alias("current_replicas"),
    )
    out = decisions.what_if(cases, CONFIGS)
    return out.groupBy("config", "direction").agg(F.count(F.lit(1)).alias("cases"), F.sum("target_replicas").alias("replicas"))


# Every third order lacks a peak, every fifth a confidence and every seventh a replica count; some are NaN.
_ODD = """SELECT o_orderkey,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'nan'::DOUBLE ELSE (o_totalprice / 10000)::FLOAT::DOUBLE END AS predicted_peak,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'nan'::DOUBLE ELSE 0.2 + (o_custkey % 9) / 10.0::DOUBLE END AS confidence,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (2 + o_orderkey % 30)::INT END AS current_replicas FROM orders"""


@query("unknown_inputs_hold", "K1 K2 K3 K4 J6", f"WITH inputs AS ({_ODD}) SELECT o_orderkey, target_replicas, direction, approved, reason FROM {decide_sql('inputs')}")
def unknown_inputs_hold(spark, sf_dir):
    """Orders as scaling cases of which many lack an input: those hold and are not approved."""
    key, nan = F.col("o_orderkey"), F.lit(float("nan"))
    cases = read_table(spark, sf_dir, "orders").select(
        key,
        F.when(key % 3 == 0, None).when(key % 11 == 0, nan).otherwise((F.col("o_totalprice") / 10000).cast("float").cast("double")).alias("predicted_peak"),
        F.when(key % 5 == 0, None).when(key % 13 == 0, nan).otherwise(0.2 + (F.col("o_custkey") % 9) / 10.0).alias("confidence"),
        F.when(key % 7 == 0, None).otherwise((2 + key % 30).cast("int")).alias("current_replicas"),
    )
    return decisions.decide(cases).select("o_orderkey", "target_replicas", "direction", "approved", "reason")


@query(
    "rate_limit",
    "K6",
    f"""WITH {DECISIONS} SELECT {KEYS}, ts, least(greatest(target_replicas, current_replicas - 2), current_replicas + 5) AS target_replicas, direction FROM decisions""",
)
def rate_limit(spark, sf_dir):
    return decisions.rate_limit(decided(spark, sf_dir)).select(*SERIES, "ts", "target_replicas", "direction")


GUARD = GuardConfig(cooldown_s=5 * 3600)
_CD = GUARD.cooldown_s * 1_000_000
_RUNS = f"n.direction <> 'none' AND (g.last IS NULL OR epoch_us(n.ts) - epoch_us(g.last) >= {_CD})"

# The cooldown followed row by row.
GUARDED = f"""{DECISIONS},
ranked AS (SELECT *, row_number() OVER ({BY}) AS rn FROM decisions),
chain AS (
  SELECT {KEYS}, rn, CASE WHEN direction <> 'none' THEN ts END AS last, NULL::TIMESTAMP AS before, direction <> 'none' AS executed FROM ranked WHERE rn = 1
  UNION ALL
  SELECT n.namespace, n.deployment, n.rn, CASE WHEN {_RUNS} THEN n.ts ELSE g.last END, g.last, {_RUNS}
  FROM chain g JOIN ranked n ON n.namespace = g.namespace AND n.deployment = g.deployment AND n.rn = g.rn + 1),
guarded AS (
  SELECT r.namespace, r.deployment, r.ts, predicted_peak, confidence, current_replicas, direction, executed,
    CASE WHEN executed THEN least(greatest(target_replicas, current_replicas - 2), current_replicas + 5) ELSE target_replicas END AS target_replicas,
    CASE WHEN direction = 'none' THEN approved ELSE executed END AS approved,
    CASE WHEN direction = 'none' THEN reason
         WHEN NOT executed THEN reason || printf(' | BLOCKED: cooldown (%.1fs remaining)', {GUARD.cooldown_s} - (epoch_us(ts) - epoch_us(before)) / 1000000)
         WHEN target_replicas - current_replicas > 5 THEN reason || ' | Rate-limited: capped at +5'
         WHEN current_replicas - target_replicas > 2 THEN reason || ' | Rate-limited: capped at -2' ELSE reason END AS reason
  FROM ranked r JOIN chain USING ({KEYS}, rn))"""


def guarded(spark, sf_dir, clean=None):
    inputs = materialise(decision_inputs(spark, sf_dir, clean), "decision-inputs")
    made = materialise(decisions.decide(inputs), "decisions")
    release(inputs)
    out = materialise(decisions.guard_decisions(made, SERIES, "ts", GUARD), "guarded")
    release(made)
    return out


@query("guard_decisions", "K5 K6", f"WITH RECURSIVE {GUARDED} SELECT {D_COLS}, executed, reason FROM guarded")
def guard_decisions(spark, sf_dir):
    """Cooldown and rate limit over all decisions, in time order per series."""
    rows = guarded(spark, sf_dir)
    return rows.select(*SERIES, "ts", "current_replicas", "target_replicas", "direction", "approved", "executed", "reason")


@query(
    "raw_cooldown",
    "K5",
    """WITH RECURSIVE chain AS (SELECT event_type, min(ts) AS ts FROM events GROUP BY ALL
      UNION ALL
      SELECT c.event_type, (SELECT min(e.ts) FROM events e WHERE e.event_type = c.event_type AND e.ts >= c.ts + INTERVAL 2 HOURS)
      FROM chain c WHERE c.ts IS NOT NULL)
    SELECT event_type, ts FROM chain WHERE ts IS NOT NULL""",
)
def raw_cooldown(spark, sf_dir):
    """Which raw events would run with a two-hour cooldown per event type."""
    rows = read_table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return decisions.executed_times(rows, ["event_type"], "ts", 7200).drop("_executed")


@query(
    "actions",
    "K10",
    f"WITH RECURSIVE {GUARDED} SELECT {KEYS}, ts, current_replicas, target_replicas, direction, reason, {rs(['confidence'])}, {rs(['predicted_peak'], 4)} "
    "FROM guarded WHERE approved AND target_replicas <> current_replicas",
)
def actions(spark, sf_dir):
    out = decisions.actions(guarded(spark, sf_dir), SERIES, "ts")
    return out.withColumns(
        {"confidence": F.round(F.col("confidence") + 3.1e-8, 6), "predicted_peak": F.round(F.col("predicted_peak") + 3.1e-6, 4)}
    )


@query(
    "event_history",
    "K7",
    f"""WITH RECURSIVE {GUARDED} SELECT {KEYS}, ts, direction, target_replicas FROM guarded WHERE executed
    QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY ts DESC) <= 20""",
)
def event_history(spark, sf_dir):
    return decisions.event_history(guarded(spark, sf_dir), SERIES, "ts").select(*SERIES, "ts", "direction", "target_replicas")


AS_OF = "2024-01-31 00:00:00"


@query(
    "guard_status",
    "K8",
    f"""WITH RECURSIVE {GUARDED} SELECT {KEYS}, {GUARD.cooldown_s} AS cooldown_seconds, 5 AS max_scale_up_step, 2 AS max_scale_down_step,
    greatest(0.0::DOUBLE, coalesce({GUARD.cooldown_s} - (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts) FILTER (executed))) / 1000000, 0)) AS seconds_until_ready,
    least(count(*) FILTER (executed), 100) AS total_events FROM guarded GROUP BY ALL""",
)
def guard_status(spark, sf_dir):
    return decisions.guard_status(guarded(spark, sf_dir), SERIES, "ts", AS_OF, GUARD)

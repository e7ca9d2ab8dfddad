"""Scaling decisions and the safety rules applied to them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.blocks import DAY, carry, join_series, micros
from ..session import materialise, release
from .ensemble import replicas_for, unknown


@dataclass(frozen=True)
class DecisionConfig:
    """Fixed default values; each may also be a Column of the decided rows."""

    target_utilization: float | Column = 0.7
    min_replicas: int | Column = 2
    max_replicas: int | Column = 50
    confidence_threshold: float | Column = 0.7
    dead_band: int | Column = 1


@dataclass(frozen=True)
class GuardConfig:
    """Fixed default values of the safety rules."""

    cooldown_s: int = 120
    max_up: int = 5
    max_down: int = 2
    history: int = 100


# Reason formats.
REASON_CONFIDENCE = "Prediction confidence (%.2f) below threshold (%s)"
REASON_DEAD_BAND = "Target (%d) within dead-band of current (%d)"
REASON_NO_CONFIDENCE = "Prediction confidence is unknown"
REASON_NO_PEAK = "Predicted peak is unknown"
REASON_NO_REPLICAS = "Current replicas are unknown"
REASON_SCALE = "Predicted peak %.2f requires %d replicas (target util %.0f%%), currently %d"
SUFFIX_COOLDOWN = " | BLOCKED: cooldown (%.1fs remaining)"
SUFFIX_UP = " | Rate-limited: capped at +%d"
SUFFIX_DOWN = " | Rate-limited: capped at -%d"


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def decide(df: DataFrame, config: DecisionConfig = DecisionConfig()) -> DataFrame:
    """Add ``target_replicas``, ``direction``, ``reason`` and ``approved`` to rows with
    ``predicted_peak``, ``confidence`` and ``current_replicas``.

    Low confidence holds and is not approved; a need within the dead band holds and is. An
    unknown (NULL or NaN) confidence, peak or replica count holds and is not approved.
    """
    peak, conf, current = F.col("predicted_peak"), F.col("confidence"), F.col("current_replicas").cast("int")
    threshold, util = _col(config.confidence_threshold), _col(config.target_utilization)
    need = replicas_for(peak, util, config.min_replicas, config.max_replicas, idle=current)
    blind = unknown(conf)
    low = ~blind & (conf < threshold)
    lost = blind | unknown(peak) | current.isNull()
    near = F.abs(F.col("_need") - current) <= _col(config.dead_band)
    hold = low | lost | near
    return (
        df.withColumn("_need", need)
        .withColumns(
            {
                "target_replicas": F.when(hold, current).otherwise(F.col("_need")),
                "direction": F.when(hold, "none").when(F.col("_need") > current, "up").otherwise("down"),
                "reason": F.when(blind, REASON_NO_CONFIDENCE)
                .when(low, F.format_string(REASON_CONFIDENCE, conf, threshold.cast("string")))
                .when(unknown(peak), REASON_NO_PEAK)
                .when(current.isNull(), REASON_NO_REPLICAS)
                .when(near, F.format_string(REASON_DEAD_BAND, F.col("_need"), current))
                .otherwise(F.format_string(REASON_SCALE, peak, F.col("_need"), util * 100, current)),
                "approved": ~(low | lost),
            }
        )
        .drop("_need")
    )


def what_if(cases: DataFrame, configs: Sequence[tuple[str, DecisionConfig]]) -> DataFrame:
    """Decide every case under every named configuration, changing nothing."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("config"),
                F.lit(float(c.target_utilization)).alias("util"),
                F.lit(c.min_replicas).alias("lo"),
                F.lit(c.max_replicas).alias("hi"),
                F.lit(float(c.confidence_threshold)).alias("threshold"),
                F.lit(c.dead_band).alias("dead_band"),
            )
            for name, c in configs
        ]
    )
    wide = cases.select("*", F.explode(rows).alias("_c"))
    used = DecisionConfig(*[F.col(f"_c.{n}") for n in ("util", "lo", "hi", "threshold", "dead_band")])
    return decide(wide, used).withColumn("config", F.col("_c.config")).drop("_c")


def limited_target(guard: GuardConfig) -> Column:
    """The target moved at most ``max_up`` up or ``max_down`` down from the current count."""
    target, current = F.col("target_replicas"), F.col("current_replicas").cast("int")
    return F.least(F.greatest(target, current - F.lit(guard.max_down)), current + F.lit(guard.max_up))


def rate_limit(df: DataFrame, guard: GuardConfig = GuardConfig()) -> DataFrame:
    moved = limited_target(guard)
    suffix = (
        F.when(moved < F.col("target_replicas"), SUFFIX_UP % guard.max_up)
        .when(moved > F.col("target_replicas"), SUFFIX_DOWN % guard.max_down)
        .otherwise("")
    )
    return df.withColumns({"reason": F.concat("reason", suffix), "target_replicas": moved})


# -- cooldown ---------------------------------------------------------------------------


def executed_times(
    candidates: DataFrame, keys: Sequence[str], ts: str, cooldown_s: int, *, slot_s: float = DAY
) -> DataFrame:
    """The candidate actions that run when each one that runs starts a cooldown.

    A candidate with none in the cooldown before it runs in any case. Each candidate points
    to its successor, the first one at least a cooldown later, and the others that run are
    those that pointers reach from the sure ones. Pointers double their reach in each round
    and end at sure candidates, so the rounds are the logarithm of the longest stretch
    without a pause of one cooldown. Candidates whose pointers meet in one row lie within
    one cooldown of each other, in any round, which bounds the rows of a join key.
    """
    keys, cooldown = list(keys), max(int(cooldown_s * 1_000_000), 1)
    times = candidates.select(*keys, micros(ts).alias("_us")).distinct().withColumn("_at", F.timestamp_micros("_us"))
    times = carry(times, keys, "_at", {"_prior": F.col("_us")}, slot_s=slot_s, strict=True)
    sure = F.coalesce(F.col("_us") - F.col("_prior") >= cooldown, F.lit(True))
    # Read for the candidates and for the ends of their cooldowns.
    times = materialise(times.select(*keys, "_us", sure.alias("_runs")), "candidate-times")

    # On one time line, the end of a cooldown looks ahead to the next candidate; itself if at the same time.
    nobody, no = F.lit(None).cast("long"), F.lit(None).cast("boolean")
    ends = times.select(*keys, (F.col("_us") + cooldown).alias("_line"), F.lit(0).alias("_kind"), "_us", "_runs", nobody.alias("_found"), no.alias("_sure"))
    line = ends.unionByName(times.select(*keys, F.col("_us").alias("_line"), F.lit(1).alias("_kind"), nobody.alias("_us"), no.alias("_runs"), F.col("_us").alias("_found"), F.col("_runs").alias("_sure")))
    ahead = F.when(F.col("_kind") == 1, F.struct(F.col("_found").alias("us"), F.col("_sure").alias("sure")))
    line = carry(line.withColumn("_at", F.timestamp_micros("_line")), keys, "_at", {"_next": ahead}, order=["_line", "_kind"], slot_s=slot_s, backward=True)
    to = F.when(~F.col("_next.sure"), F.col("_next.us"))
    links = materialise(line.filter("_kind = 0").select(*keys, "_us", "_runs", to.alias("_to")), "candidate-links")
    release(times)

    while not links.filter("_to IS NOT NULL").isEmpty():
        # Two doublings a round halve the tables written.
        before, links = links, materialise(_double(_double(links, keys), keys), "candidate-links")
        release(before)
    return links.filter("_runs").select(*keys, F.timestamp_micros("_us").alias(ts), F.lit(True).alias("_executed"))


def _double(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates that those that run point to run too; then each pointer takes the pointer of its end."""
    reached = links.filter("_runs AND _to IS NOT NULL").select(*keys, F.col("_to").alias("_us"), F.lit(True).alias("_hit")).distinct()
    further = links.filter("_to IS NOT NULL").select(*keys, F.col("_us").alias("_end"), F.col("_to").alias("_then"))
    marked = links.join(reached, [*keys, "_us"], "left").withColumn("_runs", F.col("_runs") | F.col("_hit").isNotNull()).drop("_hit")
    # A candidate without a pointer asks at its own place, where there is none, instead of under one shared NULL.
    marked = marked.withColumn("_end", F.coalesce("_to", "_us"))
    return marked.join(further, [*keys, "_end"], "left").select(*keys, "_us", "_runs", F.col("_then").alias("_to"))


def guard_decisions(
    df: DataFrame, keys: Sequence[str], ts: str, guard: GuardConfig = GuardConfig(), *, slot_s: float = DAY
) -> DataFrame:
    """Apply cooldown and rate limit to decisions, one per series and instant.

    Adds ``executed``. Holds pass unchanged; an action inside the cooldown of the last
    executed one is not approved and keeps its unlimited target.
    """
    keys = list(keys)
    acts = F.col("direction") != "none"
    moves = limited_target(guard) != F.col("current_replicas").cast("int")
    taken = executed_times(df.filter(acts & moves), keys, ts, guard.cooldown_s, slot_s=slot_s)
    rows = df.join(taken, [*keys, ts], "left").withColumn("executed", F.coalesce("_executed", F.lit(False))).drop("_executed")
    rows = carry(rows, keys, ts, {"_last": F.when(F.col("executed"), micros(ts))}, slot_s=slot_s, strict=True)
    return rows.select(*[c.alias(n) for n, c in _guarded_columns(df.columns, ts, guard).items()], "executed")


def _guarded_columns(columns: Sequence[str], ts: str, guard: GuardConfig) -> dict[str, Column]:
    """Decision columns after cooldown and rate limit, given the last execution before each row in ``_last``."""
    acts, blocked = F.col("direction") != "none", _blocked(ts, guard)
    left = F.lit(guard.cooldown_s) - (micros(ts) - F.col("_last")) / 1_000_000
    limited = limited_target(guard)
    reason = (
        F.when(~acts, F.col("reason"))
        .when(blocked, F.concat("reason", F.format_string(SUFFIX_COOLDOWN, F.round(left, 1))))
        .when(limited < F.col("target_replicas"), F.concat("reason", F.lit(SUFFIX_UP % guard.max_up)))
        .when(limited > F.col("target_replicas"), F.concat("reason", F.lit(SUFFIX_DOWN % guard.max_down)))
        .otherwise(F.col("reason"))
    )
    target = F.when(acts & ~blocked, limited).otherwise(F.col("target_replicas"))
    approved = F.when(acts, ~blocked).otherwise(F.col("approved"))
    new = {"target_replicas": target, "reason": reason, "approved": approved}
    return {c: new.get(c, F.col(c)) for c in columns}


def _blocked(ts: str, guard: GuardConfig) -> Column:
    left = F.lit(guard.cooldown_s) - (micros(ts) - F.col("_last")) / 1_000_000
    return (F.col("direction") != "none") & F.coalesce(left > 0, F.lit(False))


def guard_now(df: DataFrame, last: DataFrame | None, keys: Sequence[str], ts: str, guard: GuardConfig = GuardConfig()) -> DataFrame:
    """Guard one decision per series, given ``last(series…, last_executed)``; a series without one is free to act.

    What a control tick does: the history of a series is one time, and ``executed`` rows are
    its next one.
    """
    if last is None:
        rows = df.withColumn("_last", F.lit(None).cast("long"))
    else:
        rows = join_series(df, last.select(*keys, micros("last_executed").alias("_last")), keys)
    moves = limited_target(guard) != F.col("current_replicas").cast("int")
    executed = (F.col("direction") != "none") & ~_blocked(ts, guard) & moves
    return rows.select(*[c.alias(n) for n, c in _guarded_columns(df.columns, ts, guard).items()], F.coalesce(executed, F.lit(False)).alias("executed"))


def actions(guarded: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """The replica changes to carry out: approved and different from the current count."""
    todo = guarded.filter(F.col("approved") & (F.col("target_replicas") != F.col("current_replicas")))
    return todo.select(*keys, ts, "current_replicas", "target_replicas", "direction", "reason", "confidence", "predicted_peak")


def event_history(guarded: DataFrame, keys: Sequence[str], ts: str, limit: int = 20, kept: int = 100) -> DataFrame:
    """The newest executed events of each series."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    rows = guarded.filter("executed").withColumn("_rn", F.row_number().over(w))
    return rows.filter(F.col("_rn") <= min(limit, kept)).drop("_rn")


def guard_status(guarded: DataFrame, keys: Sequence[str], ts: str, as_of, guard: GuardConfig = GuardConfig()) -> DataFrame:
    """Events on record and seconds until the next action may run, per series."""
    last = F.max(F.when(F.col("executed"), micros(ts)))
    gone = (micros(F.lit(as_of).cast("timestamp")) - last) / 1_000_000
    ready = F.greatest(F.lit(0.0), F.coalesce(F.lit(float(guard.cooldown_s)) - gone, F.lit(0.0)))
    events = F.sum(F.col("executed").cast("int"))
    return guarded.groupBy(*keys).agg(
        F.lit(guard.cooldown_s).alias("cooldown_seconds"),
        F.lit(guard.max_up).alias("max_scale_up_step"),
        F.lit(guard.max_down).alias("max_scale_down_step"),
        ready.alias("seconds_until_ready"),
        F.least(events, F.lit(guard.history)).cast("long").alias("total_events"),
    )

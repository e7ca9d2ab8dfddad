"""The model registry as a table, one registry per series.

Columns: ``(series…, n, version, path, created_at, metrics MAP<STRING,STRING>, is_active)``;
``n`` is the order of creation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Retraining limits and versions kept.
MAE_LIMIT, MAX_AGE_HOURS, KEEP_VERSIONS = 0.2, 48, 5


def create_versions(registry: DataFrame | None, runs: DataFrame, keys: Sequence[str], base_path: str) -> DataFrame:
    """Append a version per training run ``(series…, created_at, metrics)``, numbered on
    from the highest number a series has; ``prune`` keeps that one."""
    w = Window.partitionBy(*keys).orderBy("created_at")
    rows = runs.withColumn("n", F.row_number().over(w).cast("long"))
    if registry is not None:
        have = registry.groupBy(*keys).agg(F.max("n").alias("_have"))
        rows = rows.join(have, list(keys), "left").withColumn("n", F.col("n") + F.coalesce("_have", F.lit(0)))
    version = F.concat(F.lit("v"), F.col("n"), F.lit("_"), F.date_format("created_at", "yyyyMMdd_HHmmss"))
    new = rows.select(
        *keys,
        "n",
        version.alias("version"),
        F.concat_ws("/", F.lit(base_path), *keys, version).alias("path"),
        "created_at",
        "metrics",
        F.lit(False).alias("is_active"),
    )
    return new if registry is None else registry.unionByName(new)


def promote(registry: DataFrame, choice: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Make the version named in ``choice(series…, version)`` the only active one of its series.

    Series without a choice keep theirs. A version the registry lacks is an error.
    """
    on = [*keys, "version"]
    missing = choice.join(registry, on, "left_anti")
    if not missing.isEmpty():
        raise KeyError(f"unknown version: {missing.first().asDict()}")
    picked = choice.select(*keys, F.col("version").alias("_picked"))
    joined = registry.join(picked, list(keys), "left")
    active = F.when(F.col("_picked").isNull(), F.col("is_active")).otherwise(F.col("version") == F.col("_picked"))
    return joined.select(*[active.alias(c) if c == "is_active" else F.col(c) for c in registry.columns])


def latest_choice(registry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return registry.groupBy(*keys).agg(F.max_by("version", F.struct("n", "created_at")).alias("version"))


def active_versions(registry: DataFrame) -> DataFrame:
    return registry.filter("is_active")


def list_versions(registry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return registry.orderBy(*keys, "n")


def retrain_check(
    registry: DataFrame,
    current: DataFrame,
    keys: Sequence[str],
    as_of,
    *,
    mae_limit: float = MAE_LIMIT,
    max_age_hours: float = MAX_AGE_HOURS,
) -> DataFrame:
    """Per series of ``current(series…, mae)``: whether to retrain, and why.

    ``created_at`` may be a string; one that is no timestamp asks for retraining.
    """
    active = active_versions(registry).select(*keys, "version", F.col("created_at").try_cast("timestamp").alias("_at"))
    rows = current.join(active, list(keys), "left")
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("_at")) / 3_600_000_000
    reason = (
        F.when(F.col("version").isNull(), "no active model")
        .when(F.col("mae") > mae_limit, "high error")
        .when(F.col("_at").isNull(), "bad timestamp")
        .when(age > max_age_hours, "stale model")
        .otherwise("none")
    )
    return rows.select(*keys, "version", "mae", (reason != "none").alias("retrain"), reason.alias("why"))


def prune(registry: DataFrame, keys: Sequence[str], keep: int = KEEP_VERSIONS) -> DataFrame:
    """Series with at most ``keep`` versions stay; others keep the active one and the newest
    ``keep - 1`` of the rest.

    The highest number always stays, so numbers are never given twice; with ``keep`` = 1
    that may be a second row beside the active one.
    """
    w = Window.partitionBy(*keys)
    newest_first = Window.partitionBy(*keys, "is_active").orderBy(F.col("n").desc(), F.col("created_at").desc())
    rows = registry.withColumns({"_all": F.count(F.lit(1)).over(w), "_top": F.max("n").over(w), "_rank": F.row_number().over(newest_first)})
    stays = (F.col("_all") <= keep) | F.col("is_active") | (F.col("_rank") <= keep - 1) | (F.col("n") == F.col("_top"))
    return rows.filter(stays).drop("_all", "_top", "_rank")

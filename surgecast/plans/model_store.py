"""Fitted models on shared storage, published so that a retry never doubles or mixes them.

A run writes its tables into folders of its own and, last, one commit row. Readers follow
commits only: a run that broke off is invisible, and of a version that was published twice
the later run counts. Versions and series are columns, so folders grow with runs only.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import join_series

_COMMIT = "run string, published_at timestamp"


def publish(parts: dict[str, DataFrame], versions: DataFrame, keys: Sequence[str], base_path: str) -> str:
    """Store each part's rows under their series' version and commit; returns the run.

    ``versions`` is (series…, version), one row for each series that the run trained.
    """
    spark = versions.sparkSession
    run = f"r{uuid.uuid4().hex}"
    versions = versions.select(*keys, "version")
    for name, rows in parts.items():
        join_series(rows, versions, keys, "inner").write.parquet(f"{base_path}/{name}/run={run}")
    versions.write.parquet(f"{base_path}/manifest/run={run}")
    now = datetime.now(timezone.utc)
    spark.createDataFrame([(run, now)], _COMMIT).coalesce(1).write.parquet(f"{base_path}/commits/{run}")
    return run


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    at, files = _folder(spark, path)
    return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, files = _folder(spark, path)
    files.delete(at, True)


def manifest(spark: SparkSession, keys: Sequence[str], base_path: str) -> DataFrame:
    """(series…, version, run): where each published version lies."""
    if not children(spark, f"{base_path}/commits"):
        raise FileNotFoundError(f"no models have been published under {base_path}")
    commits = spark.read.schema(_COMMIT).parquet(f"{base_path}/commits/*")
    rows = spark.read.parquet(f"{base_path}/manifest").join(commits, "run")
    return rows.groupBy(*keys, "version").agg(F.max_by("run", F.struct("published_at", "run")).alias("run"))


def stored(spark: SparkSession, name: str, wanted: DataFrame, keys: Sequence[str], base_path: str) -> DataFrame:
    """Rows of one part for the versions ``wanted`` (series…, version, run)."""
    rows = spark.read.parquet(f"{base_path}/{name}")
    return join_series(rows, wanted, [*keys, "version", "run"], "inner").drop("version", "run")


def vacuum(registry: DataFrame, keys: Sequence[str], base_path: str) -> list[str]:
    """Delete the folders of runs that broke off or whose versions the registry holds no more; returns them.

    Call it while nothing is being published. The driver sees run names, one for each training.
    """
    spark = registry.sparkSession
    used = join_series(manifest(spark, keys, base_path), registry.select(*keys, "version"), [*keys, "version"], "inner")
    kept = {r["run"] for r in used.select("run").distinct().collect()}
    gone = set()
    # Commits go last, so that a run without one is found again.
    for name in sorted(children(spark, base_path), key=lambda n: n == "commits"):
        for child in children(spark, f"{base_path}/{name}"):
            run = child.removeprefix("run=")
            if run.startswith("r") and run not in kept:
                remove(spark, f"{base_path}/{name}/{child}")
                gone.add(run)
    return sorted(gone)

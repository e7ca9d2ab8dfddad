"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    # Timestamps in metric tables are UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Shuffle files go when the job that wrote them ends, not when the driver happens to collect its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine find this package when it is not installed.

    On a cluster it comes with ``--py-files`` or the image, as any package does.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on to an existing session."""
    importable(spark)
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("surgecast")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # One partition per local core; merging small ones would leave cores idle.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_created: list[str] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch folders this process made; call it when no result of them is needed."""
    while _created:
        _delete(spark, _created.pop())


def release(*made) -> None:
    """Delete the folders of frames that ``materialise`` returned; call it when nothing will read them again.

    Other frames, which read what is not theirs, are passed over.
    """
    for df in made:
        path = getattr(df, "_scratch", None)
        if path in _created:
            _created.remove(path)
            _delete(df.sparkSession, path)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared checkpoint folder the cluster names.

    Where the setting is missing, as in tests, the warehouse folder holds it, which all
    executors share too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _created.append(path)
    return path


def materialise(df, purpose: str):
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts lineage with a written table, so a lost executor re-reads files instead of
    recomputing, and several consumers do not repeat the work.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._scratch = path
    return made

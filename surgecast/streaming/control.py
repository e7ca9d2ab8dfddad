"""The control loop on streams: micro-batch ticks and stateful cooldown."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.decisions import DecisionConfig, GuardConfig
from ..plans import flows
from ..plans.model_store import children, remove
from ..session import materialise, release, scratch_dir
from ..sources.tables import fill_grid

#: How long metric history is kept, in seconds.
RETENTION_S = 168 * 3600


class TickLoop:
    """One control tick per micro-batch of closed metric bins.

    A tick appends the bins to a history table, reads back the stretch of history the
    features need, scores and decides, and writes the decisions. Every write goes to a
    folder named after the batch, so a batch that is run again replaces its own output.
    """

    def __init__(
        self,
        spark,
        keys: Sequence[str],
        score: Callable[[DataFrame], DataFrame],
        decide: Callable[[DataFrame], DataFrame],
        *,
        history_s: int,
        folder: str | None = None,
    ):
        self.folder = folder or scratch_dir(spark, "ticks")
        self.keys, self.score, self.decide, self.history_s = list(keys), score, decide, history_s

    def _bins(self, batch_id: int) -> str:
        return f"{self.folder}/bins/batch={batch_id}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(self._bins(batch_id))
        fresh = spark.read.schema(batch.schema).parquet(self._bins(batch_id))
        span = fresh.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
        if span.lo is None:
            return
        history = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())]))
        recent = (
            history.parquet(f"{self.folder}/bins")
            .filter(F.col("batch") <= batch_id)
            .filter(F.col("ts") >= F.lit(span.lo) - F.make_interval(secs=F.lit(self.history_s).cast("decimal(18,6)")))
        )
        scored = self.score(recent.drop("batch")).filter(F.col("ts") >= F.lit(span.lo))
        new = scored.join(fresh.select(*self.keys, "ts"), [*self.keys, "ts"], "left_semi")
        self.decide(new).write.mode("overwrite").parquet(f"{self.folder}/decisions/batch={batch_id}")

    def run(self, bins: DataFrame, *, trigger: dict | None = None):
        return (
            bins.writeStream.outputMode("append")
            .option("checkpointLocation", f"{self.folder}/progress")
            .foreachBatch(self)
            .trigger(**(trigger or {"processingTime": "60 seconds"}))
            .start()
        )

    def decisions(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/decisions").drop("batch")


class History:
    """Closed bins on shared storage, kept for ``keep_s`` seconds before the newest.

    A batch's rows lie in folders by event day and batch, so a batch that is run again
    replaces its own rows. Days past the limit are deleted whole, and a day with ``fan``
    batches is packed into one folder that names the last batch it holds: folders of batches
    up to that one count no more, whether they are deleted yet or not.
    """

    def __init__(self, folder: str, schema: T.StructType, keep_s: float = RETENTION_S, fan: int = 64):
        self.folder, self.schema, self.keep_s, self.fan = folder, schema, keep_s, fan

    def _packed(self, spark) -> dict[str, int]:
        """The last batch packed, by day; a folder without its success mark broke off."""
        found: dict[str, int] = {}
        for day in children(spark, f"{self.folder}/packed"):
            for upto in children(spark, f"{self.folder}/packed/{day}"):
                if "_SUCCESS" in children(spark, f"{self.folder}/packed/{day}/{upto}"):
                    found[day] = max(found.get(day, -1), int(upto.split("=")[1]))
        return found

    def _folders(self, spark) -> dict[str, list[str]]:
        """The folders that count, by day: of days kept and batches since the last packing, so bounded by both."""
        packed = self._packed(spark)
        found = {day: [f"packed/{day}/upto={upto}"] for day, upto in packed.items()}
        for day in children(spark, f"{self.folder}/bins"):
            if day.startswith("day="):
                for batch in children(spark, f"{self.folder}/bins/{day}"):
                    if int(batch.split("=")[1]) > packed.get(day, -1):
                        found.setdefault(day, []).append(f"bins/{day}/{batch}")
        return found

    def _read(self, spark, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[f"{self.folder}/{f}" for f in sorted(folders)])

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Store one batch of bins (…, ts, …), then let go of what is too old and pack full days."""
        spark = batch.sparkSession
        rows = batch.select(*self.schema.names, F.to_date("ts").alias("day"), F.lit(batch_id).alias("batch"))
        # A few days at most: one file for each, not one for each task and day.
        rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{self.folder}/bins")
        self.expire(spark)
        for day, folders in self._folders(spark).items():
            raw = [f for f in folders if f.startswith("bins/")]
            if len(raw) >= self.fan:
                upto = max(int(f.rsplit("=", 1)[1]) for f in raw)
                self._read(spark, folders).coalesce(1 + len(raw) // self.fan).write.mode("overwrite").parquet(f"{self.folder}/packed/{day}/upto={upto}")
                for f in folders:
                    remove(spark, f"{self.folder}/{f}")

    def expire(self, spark) -> None:
        """Delete whole days before the limit."""
        days = sorted(self._folders(spark))
        if days:
            newest = self._read(spark, self._folders(spark)[days[-1]]).agg(F.max("ts").alias("t")).first()["t"]
            if newest is not None:
                limit = f"day={(newest - pd.Timedelta(seconds=self.keep_s)).date().isoformat()}"
                for tree in ("bins", "packed"):
                    for day in children(spark, f"{self.folder}/{tree}"):
                        if day.startswith("day=") and day < limit:
                            remove(spark, f"{self.folder}/{tree}/{day}")

    def rows(self, spark) -> DataFrame:
        """All bins within the limit of the newest."""
        kept = self._read(spark, [f for fs in self._folders(spark).values() for f in fs])
        newest = kept.agg(F.max("ts").alias("t")).first()["t"]
        if newest is None:
            return kept
        return kept.filter(F.col("ts") >= F.lit(newest) - F.make_interval(secs=F.lit(self.keep_s).cast("decimal(18,6)")))


class ControlLoop:
    """A control cycle with stored models for each micro-batch of closed bins.

    A cycle adds the bins to the history, takes one snapshot of the models' active versions
    (``models(spark)``, see ``flows.load``; a version published meanwhile counts from the
    next batch on), and forecasts with both, blends, decides and guards (``flows.tick``) for
    the series that have new bins. The last executed action of each series is kept by batch,
    so a batch that is run again sees what it saw the first time.
    """

    def __init__(
        self,
        spark,
        keys: Sequence[str],
        models: Callable[..., flows.Trained],
        schema: T.StructType,
        *,
        step_s: int,
        gauge: str = "ready_replicas",
        weights: Callable[..., DataFrame] | None = None,
        keep_s: float = RETENTION_S,
        folder: str | None = None,
        config: DecisionConfig = DecisionConfig(),
        guard: GuardConfig = GuardConfig(),
        **predicting,
    ):
        self.folder = folder or scratch_dir(spark, "control")
        self.history = History(f"{self.folder}/history", schema, keep_s)
        self.keys, self.models, self.step_s, self.gauge, self.weights = list(keys), models, step_s, gauge, weights
        self.config, self.guard, self.predicting = config, guard, predicting

    def _last(self, spark, batch_id: int) -> DataFrame | None:
        """The last executed action of each series before a batch."""
        before = [int(n.split("=")[1]) for n in children(spark, f"{self.folder}/executed") if n.startswith("batch=")]
        before = [n for n in before if n < batch_id]
        return spark.read.parquet(f"{self.folder}/executed/batch={max(before)}") if before else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        self.history.add(batch, batch_id)
        fresh = batch.select(*self.keys).distinct()
        if fresh.isEmpty():
            return
        bins = self.history.rows(spark).join(fresh, self.keys, "left_semi")
        frame = materialise(fill_grid(bins, self.keys, "ts", self.step_s), "cycle")
        last = self._last(spark, batch_id)
        known = F.col(self.gauge).isNotNull()
        replicas = frame.groupBy(*self.keys).agg(F.max_by(self.gauge, F.when(known, F.col("ts"))).cast("int").alias("current_replicas"))
        weights = self.weights(spark) if self.weights else None
        made = flows.tick(
            frame, self.keys, "ts", self.models(spark), replicas, last_executed=last, weights=weights,
            config=self.config, guard=self.guard, step_s=self.step_s, **self.predicting,
        )
        path = f"{self.folder}/decisions/batch={batch_id}"
        made.write.mode("overwrite").parquet(path)
        release(frame)
        now = spark.read.schema(made.schema).parquet(path).filter("executed").select(*self.keys, F.col("cycle").alias("last_executed"))
        both = now if last is None else last.unionByName(now)
        both.groupBy(*self.keys).agg(F.max("last_executed").alias("last_executed")).write.mode("overwrite").parquet(f"{self.folder}/executed/batch={batch_id}")
        for name in children(spark, f"{self.folder}/executed"):
            if name.startswith("batch=") and int(name.split("=")[1]) < batch_id - 2:
                remove(spark, f"{self.folder}/executed/{name}")

    run = TickLoop.run
    decisions = TickLoop.decisions


class Cooldown(StatefulProcessor):
    """Approve actions of a series unless its last executed one is too recent (event time).

    State is one timestamp per series. Rows of a micro-batch are taken in time order.
    """

    def __init__(self, out_fields: Sequence[str], guard: GuardConfig = GuardConfig()):
        self.out_fields, self.guard = list(out_fields), guard

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_executed", T.StructType([T.StructField("us", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("ts")
        last = self.last.get()[0] if self.last.exists() else None
        cooldown, up, down = self.guard.cooldown_s * 1_000_000, self.guard.max_up, self.guard.max_down
        targets, approved, executed = [], [], []
        for us, way, ok, now, goal in zip(
            batch["us"], batch["direction"], batch["approved"], batch["current_replicas"], batch["target_replicas"]
        ):
            if way == "none":
                run, ok = False, bool(ok)
            else:
                ok = last is None or us - last >= cooldown
                goal = max(min(goal, now + up), now - down) if ok else goal
                run = ok and goal != now
                last = us if run else last
            targets.append(goal), approved.append(ok), executed.append(run)
        if last is not None:
            self.last.update((int(last),))
        batch["target_replicas"], batch["approved"], batch["executed"] = targets, approved, executed
        yield batch[self.out_fields]

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def guard_stream(decisions: DataFrame, keys: Sequence[str], guard: GuardConfig = GuardConfig()) -> DataFrame:
    """The safety rules on a stream of decisions ``(series…, ts, direction, approved, …)``."""
    decisions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    names = [*keys, "ts", "current_replicas", "target_replicas", "direction", "approved"]
    fields = [decisions.schema[c] for c in names]
    out = T.StructType([*fields, T.StructField("executed", T.BooleanType())])
    rows = decisions.select(*names, F.unix_micros("ts").alias("us"))
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Cooldown([f.name for f in out.fields], guard), outputStructType=out, outputMode="Append", timeMode="None"
    )

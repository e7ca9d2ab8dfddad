"""Alerts that fire while their condition still holds, by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .control import ROCKSDB


def timestamps(us: Sequence[int]) -> pd.Series:
    return pd.to_datetime(pd.Series(list(us), dtype="int64"), unit="us")


def timer_ms(us: int) -> int:
    """The first millisecond at which an event at ``us`` is in the past of the watermark."""
    return -(-us // 1000)


class Firing(StatefulProcessor):
    """Fire once for each run of true rows that lasts, at the moment it has lasted long enough.

    State of a series is the start of its current run and whether that has fired, and the
    rows that the watermark has not passed, so rows may arrive in any order within the
    lateness. A timer stands at the earliest of those rows, and one at the time the run
    would fire; a false row before it ends the run.
    """

    def __init__(self, keys: Sequence[str], for_us: int):
        self.keys, self.for_us = list(keys), for_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "since long, fired boolean")
        self.waiting = handle.getListState("waiting", "us long, is_on boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        first = None
        for part in rows:
            part = part[part["us"] > passed]
            if len(part):
                self.waiting.appendList([(int(us), bool(on)) for us, on in zip(part["us"], part["is_on"])])
                first = min(int(part["us"].min()), first or int(part["us"].min()))
        if first is not None:
            self.handle.registerTimer(timer_ms(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get())
        due, later = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        since, fired = self.run.get() if self.run.exists() else (None, False)
        out = []
        for us, on in due:
            if since is not None and not fired and (since + self.for_us < us or on and since + self.for_us == us):
                out.append(since)
                fired = True
            if not on:
                since, fired = None, False
            elif since is None:
                since, fired = us, False
        if since is not None and not fired:
            if since + self.for_us <= passed:
                out.append(since)
                fired = True
            else:
                self.handle.registerTimer(timer_ms(since + self.for_us))
        if since is None:
            self.run.clear()
        else:
            self.run.update((since, fired))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(timer_ms(later[0][0]))
        else:
            self.waiting.clear()
        if out:
            cols = {k: [v] * len(out) for k, v in zip(self.keys, key)}
            yield pd.DataFrame({**cols, "active_since": timestamps(out), "fired_at": timestamps(s + self.for_us for s in out)})

    def close(self) -> None:
        pass


def firing_alerts(stream: DataFrame, keys: Sequence[str], condition: Column, for_s: float) -> DataFrame:
    """(series…, active_since, fired_at) for every run of true rows that lasts ``for_s`` seconds.

    ``stream`` has one row for each series and ``ts``, with a watermark on ``ts``; an
    unknown condition is false. A run fires when the watermark passes its start plus
    ``for_s`` and no false row lies before or at that time, whether it ever ends or not.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.select(*keys, "ts", F.unix_micros("ts").alias("us"), F.coalesce(condition, F.lit(False)).alias("is_on"))
    times = [T.StructField(c, T.TimestampType()) for c in ("active_since", "fired_at")]
    out = T.StructType([*[stream.schema[k] for k in keys], *times])
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Firing(keys, int(for_s * 1_000_000)), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )

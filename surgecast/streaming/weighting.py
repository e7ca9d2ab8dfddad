"""Blending weights that adapt on a stream of forecasts and actual values."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ensemble import EPS, ERROR_WINDOW, SEASONAL_WEIGHT, SEQ_WEIGHT
from .control import ROCKSDB
from .firing import timer_ms, timestamps

MODELS = ("seq", "seasonal")


class Weights(StatefulProcessor):
    """Close each forecast cycle when the watermark passes its last step, and weigh the models by their recent errors.

    State of a series: forecasts of open cycles, actual values that open cycles may need,
    and a ring of the last errors of each model. What a closed cycle leaves is dropped.
    Values of a batch are stored in one call, and one timer waits for the earliest open cycle.
    """

    def __init__(self, keys: Sequence[str], horizon_us: int, window: int):
        self.keys, self.horizon, self.window = list(keys), horizon_us, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.forecasts = handle.getListState("forecasts", "cycle long, us long, seq double, seasonal double")
        self.actuals = handle.getListState("actuals", "us long, value double")
        self.rings = {m: handle.getListState(f"{m}_errors", "mae double") for m in MODELS}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for part in rows:
            made = part[part["cycle"].notna()]
            if len(made):
                known = lambda v: None if pd.isna(v) else float(v)
                self.forecasts.appendList([(int(c), int(us), known(a), known(b)) for c, us, a, b in zip(made["cycle"], made["us"], made["seq_pred"], made["seasonal_pred"])])
                self._wait_for(int(made["cycle"].min()), passed)
            seen = part[part["cycle"].isna() & part["value"].notna()]
            if len(seen):
                self.actuals.appendList([(int(us), float(value)) for us, value in zip(seen["us"], seen["value"])])
        return iter(())

    def _wait_for(self, cycle: int, passed: int) -> None:
        self.handle.registerTimer(max(timer_ms(cycle + self.horizon), passed // 1000 + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = defaultdict(list), []
        for row in self.forecasts.get():
            if row[0] + self.horizon <= passed:
                due[row[0]].append(row)
            else:
                later.append(tuple(row))
        if later:
            self._wait_for(min(row[0] for row in later), passed)
        if not due:
            return
        # The last value of an instant counts.
        actual = {us: value for us, value in self.actuals.get()}
        rings = {m: [r[0] for r in self.rings[m].get()] for m in MODELS}
        out = []
        for cycle in sorted(due):
            scored = False
            for at, m in ((2, "seq"), (3, "seasonal")):
                errors = [abs(actual[r[1]] - r[at]) for r in due[cycle] if r[at] is not None and r[1] in actual]
                if errors:
                    rings[m] = [*rings[m], sum(errors) / len(errors)][-self.window :]
                    scored = True
            if scored:
                a, b = (sum(rings[m]) / len(rings[m]) if rings[m] else None for m in MODELS)
                both = a is not None and b is not None
                wa, wb = (1 / (a + EPS), 1 / (b + EPS)) if both else (SEQ_WEIGHT, SEASONAL_WEIGHT)
                out.append((cycle, a, b, wa / (wa + wb) if both else wa, wb / (wa + wb) if both else wb))
        for m in MODELS:
            if rings[m]:
                self.rings[m].put([(e,) for e in rings[m]])
        if later:
            self.forecasts.put(later)
        else:
            self.forecasts.clear()
        # A cycle that is still to come starts after the watermark, and so do its steps.
        oldest = min([passed, *(r[1] for r in later)])
        kept = [(us, value) for us, value in actual.items() if us >= oldest]
        if kept:
            self.actuals.put(kept)
        else:
            self.actuals.clear()
        if out:
            cols = list(zip(*out))
            names = ("avg_seq_mae", "avg_seasonal_mae", "seq_weight", "seasonal_weight")
            heads = {k: [v] * len(out) for k, v in zip(self.keys, key)}
            yield pd.DataFrame({**heads, "cycle": timestamps(cols[0]), **{n: pd.Series(c, dtype="float64") for n, c in zip(names, cols[1:])}})

    def close(self) -> None:
        pass


def weights_stream(
    forecasts: DataFrame, actuals: DataFrame, keys: Sequence[str], *, horizon_s: float, window: int = ERROR_WINDOW, lateness: str = "10 minutes"
) -> DataFrame:
    """What ``ensemble.adaptive_weights`` gives after each cycle, from two streams.

    ``forecasts(series…, cycle, ts, seq_pred, seasonal_pred)`` are events of their cycle
    time, with ``ts`` the time that they are for, at most ``horizon_s`` later;
    ``actuals(series…, ts, value)`` are events of their own time. A cycle's row comes out
    when the watermark of both passes its horizon; one without any error has none.
    """
    spark = forecasts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    none = F.lit(None)
    a = forecasts.select(
        *keys, F.col("cycle").alias("at"), F.unix_micros("cycle").alias("cycle"), F.unix_micros("ts").alias("us"),
        F.col("seq_pred").cast("double").alias("seq_pred"), F.col("seasonal_pred").cast("double").alias("seasonal_pred"), none.cast("double").alias("value"),
    )
    b = actuals.select(
        *keys, F.col("ts").alias("at"), none.cast("long").alias("cycle"), F.unix_micros("ts").alias("us"),
        none.cast("double").alias("seq_pred"), none.cast("double").alias("seasonal_pred"), F.col("value").cast("double").alias("value"),
    )
    rows = a.withWatermark("at", lateness).unionAll(b.withWatermark("at", lateness))
    doubles = [T.StructField(n, T.DoubleType()) for n in ("avg_seq_mae", "avg_seasonal_mae", "seq_weight", "seasonal_weight")]
    out = T.StructType([*[forecasts.schema[k] for k in keys], T.StructField("cycle", T.TimestampType()), *doubles])
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Weights(keys, int(horizon_s * 1_000_000), window), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )

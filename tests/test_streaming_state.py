"""Alerts by timers, weights as state, history with retention, and the control loop with stored models."""

import glob

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surgecast.operators import buffer, decisions, ensemble
from surgecast.plans import flows, model_store
from surgecast.sources.tables import fill_grid
from surgecast.streaming import control, firing, ingest, weighting

T0 = pd.Timestamp("2026-01-05")


def minute(k):
    return T0 + pd.Timedelta(minutes=int(k))


@pytest.fixture()
def files(spark, tmp_path):
    """A stream that reads one written part per micro-batch."""

    def write(name, parts, schema):
        path = str(tmp_path / name)
        for rows in parts:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)

    return write


def plain_firing(rows, for_min, passed):
    """(series, start minute) of runs that fire, row by row."""
    out = []
    for s in sorted({r[0] for r in rows}):
        mine = sorted((m, on) for t, m, on in rows if t == s and m <= passed)
        since, fired = None, False
        for m, on in [*mine, (passed, None)]:
            if since is not None and not fired and (since + for_min < m or (on or on is None) and since + for_min == m):
                out.append((s, since))
                fired = True
            if on is False:
                since, fired = None, False
            elif on and since is None:
                since, fired = m, False
    return sorted(out)


def test_alerts_fire_at_the_moment_whether_the_run_ends_or_not(spark, files):
    """Rows in several batches, out of order within the lateness; one run never ends."""
    rng = np.random.default_rng(5)
    rows = [(s, m, bool(rng.random() < 0.85)) for s in ("a", "b", "c") for m in range(0, 240, 3)]
    rows += [("open", m, True) for m in range(0, 240, 3)] + [("exact", m, m != 15) for m in range(0, 240, 3)]
    order = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 9))
    parts = [[(s, minute(m).to_pydatetime(), on if on else None) for s, m, on in order[i : i + 60]] for i in range(0, len(order), 60)]
    stream = files("in", parts, "s string, ts timestamp, on boolean").withWatermark("ts", "10 minutes")
    got = ingest.run_to_table(firing.firing_alerts(stream, ["s"], F.col("on"), 900), "t-firing").collect()
    found = sorted((r["s"], int((pd.Timestamp(r["active_since"]) - T0).total_seconds() // 60)) for r in got)
    want = plain_firing(rows, 15, 237 - 10)
    assert found == want and ("open", 0) in want and ("exact", 0) not in want and len(want) > 8
    assert {(r["fired_at"] - r["active_since"]).total_seconds() for r in got} == {900}


def test_streamed_weights_equal_batch(spark, files):
    """Forecasts and actual values in many batches; some steps and some models have neither."""
    rng = np.random.default_rng(3)
    made, seen = [], []
    for s in ("a", "b"):
        for c in range(14):
            for h in range(1, 5):
                seq = None if s == "b" and c < 3 else float(rng.normal())
                made.append((s, minute(20 * c).to_pydatetime(), minute(20 * c + 4 * h).to_pydatetime(), seq, float(rng.normal())))
                if rng.random() < 0.8 and c != 5:
                    seen.append((s, minute(20 * c + 4 * h).to_pydatetime(), float(rng.normal())))
    seen += [("a", minute(2_000).to_pydatetime(), 0.0)]
    made.sort(key=lambda r: r[1])
    seen.sort(key=lambda r: r[1])
    f_schema, a_schema = "s string, cycle timestamp, ts timestamp, seq_pred double, seasonal_pred double", "s string, ts timestamp, value double"
    # A last, far forecast lets the watermark pass all cycles.
    far = [("a", minute(3_000).to_pydatetime(), minute(3_004).to_pydatetime(), 1.0, 1.0)]
    f = files("f", [made[:40], made[40:], far], f_schema)
    a = files("a", [seen[:10], seen[10:60], seen[60:]], a_schema)
    out = weighting.weights_stream(f, a, ["s"], horizon_s=16 * 60, window=4)
    got = ingest.run_to_table(out, "t-weights").toPandas().sort_values(["s", "cycle"]).reset_index(drop=True)

    pairs = spark.createDataFrame(made, f_schema).join(spark.createDataFrame(seen, a_schema).withColumnRenamed("value", "actual"), ["s", "ts"])
    errors = ensemble.cycle_errors(pairs, ["s", "cycle"])
    want = ensemble.adaptive_weights(errors, ["s"], "cycle", window=4).toPandas().sort_values(["s", "cycle"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want[got.columns.tolist()], check_dtype=False)
    assert len(got) == 26


def history_batches():
    rng = np.random.default_rng(9)
    hours = [(s, T0 + pd.Timedelta(hours=h), float(rng.normal())) for h in range(24 * 12) for s in ("a", "b")]
    return [pd.DataFrame(hours[i : i + 30], columns=["s", "ts", "v"]) for i in range(0, len(hours), 30)]


def test_history_keeps_a_week_and_packs_days(spark, tmp_path):
    batches = history_batches()
    schema = spark.createDataFrame(batches[0]).schema
    kept = control.History(str(tmp_path / "h"), schema, fan=2)
    for i, rows in enumerate(batches[:16]):
        kept.add(spark.createDataFrame(rows), i)
        if i in (3, 9, 15):
            kept.add(spark.createDataFrame(rows), i)  # run again
    whole = spark.createDataFrame(pd.concat(batches[:16]))
    newest = whole.agg(F.max("ts")).first()[0]
    want = sorted(map(tuple, buffer.retain(whole, "ts", newest, hours=168).collect()))
    assert sorted(map(tuple, kept.rows(spark).collect())) == want
    days = {p.split("day=")[1][:10] for p in glob.glob(str(tmp_path / "h/*/day=*"))}
    assert min(days) >= (newest - pd.Timedelta(hours=168)).date().isoformat() and len(days) <= 9
    assert glob.glob(str(tmp_path / "h/packed/day=*/upto=*"))


def test_history_survives_a_packing_that_breaks_off(spark, tmp_path, monkeypatch):
    batches = history_batches()[:6]
    schema = spark.createDataFrame(batches[0]).schema
    kept = control.History(str(tmp_path / "h"), schema, fan=2)
    removed = []
    monkeypatch.setattr(control, "remove", lambda s, path: removed.append(path))  # nothing is deleted
    for i, rows in enumerate(batches):
        kept.add(spark.createDataFrame(rows), i)
    want = sorted((r.s, r.ts.to_pydatetime(), r.v) for r in pd.concat(batches).itertuples())
    assert removed and sorted(map(tuple, kept.rows(spark).collect())) == want
    # A packed folder without its success mark does not count.
    spark.createDataFrame(batches[0]).write.parquet(str(tmp_path / "h/packed/day=2026-01-05/upto=99"))
    (tmp_path / "h/packed/day=2026-01-05/upto=99/_SUCCESS").unlink()
    assert sorted(map(tuple, kept.rows(spark).collect())) == want


def line_models(spark, frame, path):
    fitted = flows.train(frame, ["s"], "ts", lookback=6, horizon=4, min_hours=1, base_path=path, store=True)
    return fitted, lambda s: flows.load(fitted.registry, ["s"], path, fitted.columns)


def test_control_loop_equals_a_tick_on_the_same_rows(spark, tmp_path):
    from conftest import service_minutes

    pdf = pd.concat([service_minutes(400), service_minutes(400, seed=4).assign(s="b")]).sort_values("ts")
    frame = spark.createDataFrame(pdf)
    fitted, models = line_models(spark, frame, str(tmp_path / "models"))
    config = decisions.DecisionConfig(confidence_threshold=0.0)
    loop = control.ControlLoop(spark, ["s"], models, frame.schema, step_s=60, folder=str(tmp_path / "loop"), config=config, lookback=6, horizon=4)
    for i, (a, b) in enumerate([(0, 500), (500, 700), (700, 799), (700, 799)]):
        loop(spark.createDataFrame(pdf.iloc[a:b]), min(i, 2))
    out = spark.read.parquet(str(tmp_path / "loop/decisions/batch=2")).orderBy("s").collect()
    seen = spark.createDataFrame(pdf.iloc[:799])
    replicas = seen.groupBy("s").agg(F.max_by("ready_replicas", "ts").cast("int").alias("current_replicas"))
    early = spark.read.parquet(*glob.glob(str(tmp_path / "loop/decisions/batch=[01]")))
    last = early.filter("executed").groupBy("s").agg(F.max("cycle").alias("last_executed"))
    want = flows.tick(fill_grid(seen, ["s"], "ts", 60), ["s"], "ts", models(spark), replicas, last_executed=last, config=config, step_s=60, lookback=6, horizon=4)
    names = ["s", "cycle", "predicted_values", "target_replicas", "direction", "approved", "executed", "reason"]
    assert [tuple(r[n] for n in names) for r in out] == [tuple(r[n] for n in names) for r in want.orderBy("s").collect()]
    assert len(out) == 2 and {r["cycle"] for r in loop.decisions(spark).collect()} >= {r["cycle"] for r in out}


def test_published_models_are_whole_or_invisible(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        model_store.manifest(spark, ["s"], path)
    versions = spark.createDataFrame([("a", "v1"), ("b", "v1")], "s string, version string")
    first = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "s string, coef double")
    runs = [model_store.publish({"line": first}, versions, ["s"], path) for _ in range(2)]
    # A third run breaks off before its commit, a fourth trains one series anew.
    first.withColumn("coef", F.lit(9.0)).join(versions, "s").write.parquet(f"{path}/line/run=rbroken")
    newer = spark.createDataFrame([("b", "v2")], "s string, version string")
    runs.append(model_store.publish({"line": first.withColumn("coef", F.col("coef") * 10)}, newer, ["s"], path))

    def load(wanted):
        found = model_store.manifest(spark, ["s"], path).join(wanted, ["s", "version"])
        return sorted(map(tuple, model_store.stored(spark, "line", found, ["s"], path).collect()))

    assert load(versions) == [("a", 1.0), ("b", 2.0)]
    assert load(spark.createDataFrame([("a", "v1"), ("b", "v2")], versions.schema)) == [("a", 1.0), ("b", 20.0)]
    # Only what the registry names stays: the later of the two equal runs, and the newest.
    registry = spark.createDataFrame([("a", "v1"), ("b", "v2")], versions.schema)
    assert model_store.vacuum(registry, ["s"], path) == sorted([runs[0], "rbroken"])
    assert load(registry) == [("a", 1.0), ("b", 20.0)]


class Calls:
    """A state handle that counts the calls made to it, each of which is a trip to the JVM."""

    def __init__(self):
        self.made, self.lists, self.timers = 0, {}, set()

    def getListState(self, name, schema):
        return CountedList(self, self.lists.setdefault(name, []))

    def registerTimer(self, ms):
        self.made += 1
        self.timers.add(ms)


class CountedList:
    def __init__(self, calls, rows):
        self.calls, self.rows = calls, rows

    def get(self):
        self.calls.made += 1
        return iter(list(self.rows))

    def appendList(self, rows):
        self.calls.made += 1
        self.rows.extend(rows)

    def put(self, rows):
        self.calls.made += 1
        self.rows[:] = rows

    def clear(self):
        self.calls.made += 1
        self.rows.clear()


class Passed:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_weights_call_their_state_a_few_times():
    """The trips to the state do not grow with the values of a batch or its cycles; every cycle still closes in time."""
    calls, day = Calls(), 86_400_000_000
    weights = weighting.Weights(["s"], day, 3)
    weights.init(calls)
    steps = [(c * day, c * day + h * day // 12) for c in range(6) for h in range(12)]
    made = pd.DataFrame({"cycle": [float(c) for c, _ in steps], "us": [u for _, u in steps], "seq_pred": 1.0, "seasonal_pred": 2.0, "value": np.nan})
    seen = pd.DataFrame({"cycle": np.nan, "us": [u for _, u in steps], "seq_pred": np.nan, "seasonal_pred": np.nan, "value": 1.5})
    list(weights.handleInputRows(("a",), iter([made, seen]), Passed(0)))
    assert calls.made <= 4
    out = []
    for ms in (2 * day // 1000, 6 * day // 1000):
        assert min(calls.timers) <= ms
        calls.timers = {t for t in calls.timers if t > ms}
        out += [part for part in weights.handleExpiredTimer(("a",), Passed(ms), None)]
    assert [len(part) for part in out] == [2, 4]
    assert calls.made <= 24 and not calls.lists["forecasts"]

import numpy as np
import pandas as pd
import pytest

from surgecast.operators import boosting, forecasting


def plain_boost(x, y, edges, rounds, depth, rate, l2, min_rows):
    """Boosted trees of one series, row by row, as nested dictionaries."""

    def place(v, cut):
        return 0 if v is None or np.isnan(v) else 1 + sum(e < v for e in cut)

    bins = [[place(v, c) for v, c in zip(row, edges)] for row in x]
    base = sum(y) / len(y)
    score = [base] * len(y)

    def grow(members, level, value):
        best = None
        if level < depth:
            g = {i: y[i] - score[i] for i in members}
            total = sum(g.values())
            for f in range(len(edges)):
                for b in sorted({bins[i][f] for i in members}):
                    left = [i for i in members if bins[i][f] <= b]
                    right = [i for i in members if bins[i][f] > b]
                    if len(left) < min_rows or len(right) < min_rows:
                        continue
                    gl, gr = sum(g[i] for i in left), sum(g[i] for i in right)
                    gain = gl**2 / (len(left) + l2) + gr**2 / (len(right) + l2) - total**2 / (len(members) + l2)
                    key = (round(gain, 9), -f, -b)
                    if key[0] > 1e-9 and (best is None or key > best[0]):
                        best = (key, left, right, gl, gr)
        if best is None:
            return {i: value for i in members}
        _, left, right, gl, gr = best
        return {**grow(left, level + 1, rate * gl / (len(left) + l2)), **grow(right, level + 1, rate * gr / (len(right) + l2))}

    for _ in range(rounds):
        for i, v in grow(range(len(y)), 0, 0.0).items():
            score[i] += v
    return score


@pytest.mark.parametrize("live", [16, 2])
def test_trees_equal_a_plain_loop(spark, monkeypatch, live):
    monkeypatch.setattr(boosting, "LIVE_TREES", live)
    rng = np.random.default_rng(5)
    out = []
    for s, n in (("hot", 160), (None, 60), ("flat", 12)):
        for i in range(n):
            x = [round(float(v), 2) for v in rng.normal(0, 1, 3)]
            y = 0.0 if s == "flat" else (3.0 if x[0] > 0.3 and x[1] < 0.5 else -1.0) + 0.2 * x[2] + float(rng.normal(0, 0.1))
            # An input that is sometimes unknown, and one that never changes.
            out.append((s, i, [x[0], None if i % 7 == 0 else x[1], x[2], 1.0], y))
    df = spark.createDataFrame(out, "s string, i long, x array<double>, y double")
    fit = dict(rounds=3, depth=2, bins=8, rate=0.4, l2=1.0, min_rows=4)
    model = boosting.fit_boosted(df, ["s"], "x", "y", **fit)
    edges = {r["s"]: r["edges"] for r in model.collect()}
    scored = boosting.score_boosted(df, model, ["s"], "x", depth=2).toPandas()
    assert len(scored) == len(out)
    for s in ("hot", None, "flat"):
        rows = [r for r in out if r[0] == s]
        want = plain_boost([r[2] for r in rows], [r[3] for r in rows], edges[s], 3, 2, 0.4, 1.0, 4)
        got = scored[scored["s"].isna() if s is None else scored["s"] == s].sort_values("i")["yhat"]
        np.testing.assert_allclose(got, want, atol=1e-8)


def test_unknown_targets_and_strangers(spark):
    df = spark.createDataFrame(
        [("a", [1.0], 2.0), ("a", [2.0], None), ("a", [3.0], float("nan")), ("a", None, 4.0), ("b", [1.0], None)],
        "s string, x array<double>, y double",
    )
    model = boosting.fit_boosted(df, ["s"], "x", "y", rounds=1, depth=1)
    assert [(r["s"], r["n"], r["base"]) for r in model.collect()] == [("a", 1, 2.0)]
    scored = boosting.score_boosted(df.filter("s = 'b'"), model, ["s"], "x", depth=1).collect()
    assert [r["yhat"] for r in scored] == [None]
    assert boosting.fit_boosted(df.filter("s = 'c'"), ["s"], "x", "y", rounds=1, depth=1).count() == 0


def test_trees_beat_lines_on_a_threshold(spark):
    """The next load jumps once two queues are both long, which no line can follow."""
    rng = np.random.default_rng(3)
    n = 600
    a, b = rng.uniform(0, 1, n), rng.uniform(0, 1, n)
    load = np.zeros(n)
    load[1:] = np.where((a[:-1] > 0.6) & (b[:-1] > 0.4), 8.0, 1.0) + rng.normal(0, 0.1, n - 1)
    pdf = pd.DataFrame({"s": "x", "ts": pd.date_range("2026-01-05", periods=n, freq="min"), "a": a, "b": b, "load": load})
    df = spark.createDataFrame(pdf)
    args = (df, ["s"], "ts", ["load", "a", "b"], "load")
    line = forecasting.fit_sequence(*args, lookback=1, horizon=1).first()["val_mae"]
    tree = boosting.fit_boosted_sequence(*args, lookback=1, horizon=1, rounds=6, depth=2, bins=16, rate=0.6).first()["val_mae"]
    assert tree < 0.5 * line


def test_short_series_are_read_once_and_get_the_same_trees(spark, monkeypatch):
    """Series that lie in one task are not read level by level, and their trees are the same."""
    rng = np.random.default_rng(9)
    out = [(s, [None if rng.random() < 0.1 else float(v) for v in rng.normal(0, 1, 3)], float(rng.normal(0, 1))) for s, n in (("a", 90), (None, 40), ("b", 3)) for _ in range(n)]
    df = spark.createDataFrame(out, "s string, x array<double>, y double")
    made = {}
    for rows in (0, 60, 4096):
        monkeypatch.setattr(boosting, "WHOLE_ROWS", rows)
        levels = []
        monkeypatch.setattr(boosting, "_best_splits", lambda *a, f=best_splits, **k: levels.append(1) or f(*a, **k))
        model = boosting.fit_boosted(df, ["s"], "x", "y", rounds=2, depth=2, bins=16, rate=0.4, min_rows=3).collect()
        assert len(levels) == (0 if rows == 4096 else 4)
        made[rows] = {r["s"]: (r["n"], r["edges"], [(t["f"], t["b"]) for t in r["trees"]], np.round([[r["base"], *t["v"]] for t in r["trees"]], 9).tolist()) for r in model}
    assert made[0] == made[60] == made[4096]


best_splits = boosting._best_splits

"""Per-series boosted trees grown from histograms, the non-linear sequence model.

Every input is cut into a few bins per series. A level of the trees of all series is one
``groupBy`` over (series, node, input, bin): tasks add up residuals and counts before the
shuffle, so what moves is bounded by series x nodes x inputs x bins whatever the rows are, and
a series that holds most rows is spread over all tasks. The rows are written once; between
levels only the trees change, and those stay in Spark as one row per series. Series of at most
``WHOLE_ROWS`` rows, whose histograms would outweigh them, are read once: a task adds up the
histograms of all their levels in turn.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.blocks import DAY, join_series
from ..session import materialise
from .forecasting import _batch, _doubles, _together, _whole_groups
from .sequences import training_windows

_TREE = "struct<f: array<int>, b: array<int>, v: array<double>>"
_NO_TREES = f"cast(array() as array<{_TREE}>)"

#: Trees that are looked up again for each row before their sum is written beside the rows.
LIVE_TREES = 16

#: Rows of a series that may lie in one task.
WHOLE_ROWS = 4096


def _known(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def _bins(x: Column, edges: Column) -> Column:
    """Bin 0 for an unknown input, else one more than the edges below the value."""

    def one(v: Column, i: Column) -> Column:
        below = F.size(F.filter(F.get(edges, i), lambda e: e < v)) + 1
        return F.when(_known(v), below).otherwise(0).cast("short")

    return F.transform(F.transform(x, lambda v: v.cast("double")), one)


def _leaf(tree: Column, bins: Column, depth: int) -> Column:
    """The node a row ends in: node n has the children 2n (bin at most its own) and 2n + 1."""

    def step(node: Column, _: Column) -> Column:
        f = F.get(tree["f"], node)
        right = F.get(bins, f).cast("int") > F.get(tree["b"], node)
        return F.when(f >= 0, node * 2 + F.when(right, 1).otherwise(0)).otherwise(node)

    return F.aggregate(F.array(*[F.lit(i) for i in range(depth)]), F.lit(1), step)


def _sum_of(trees: Column, bins: Column, depth: int) -> Column:
    return F.aggregate(trees, F.lit(0.0), lambda s, t: s + F.get(t["v"], _leaf(t, bins, depth)))


def _cuts(trees: Column, edges: Column) -> Column:
    """Trees with the value ``t`` that an input must exceed to go right, in place of all edges."""
    at = lambda t, n: F.get(F.get(edges, F.get(t["f"], n)), F.get(t["b"], n) - 1)
    cut = lambda t: F.transform(t["f"], lambda f, n: F.when((f >= 0) & (F.get(t["b"], n) > 0), at(t, n)))
    return F.transform(trees, lambda t: F.struct(t["f"].alias("f"), t["b"].alias("b"), t["v"].alias("v"), cut(t).alias("t")))


def _sum_at(cuts: Column, x: Column, depth: int) -> Column:
    """What the trees of ``_cuts`` add up to; an input beyond bin 0 is known, beyond another above its last edge."""

    def leaf(tree: Column) -> Column:
        def step(node: Column, _: Column) -> Column:
            f = F.get(tree["f"], node)
            v = F.get(x, f).cast("double")
            right = _known(v) & ((F.get(tree["b"], node) == 0) | (v > F.get(tree["t"], node)))
            return F.when(f >= 0, node * 2 + F.when(right, 1).otherwise(0)).otherwise(node)

        return F.aggregate(F.array(*[F.lit(i) for i in range(depth)]), F.lit(1), step)

    return F.aggregate(cuts, F.lit(0.0), lambda s, t: s + F.get(t["v"], leaf(t)))


def _cut_places(x: np.ndarray, bins: int, by: str) -> list[list[float | None]]:
    """What ``_edges`` gives, of one series: the values at exact ranks for equal shares."""
    made: list[list[float | None]] = []
    for v in np.sort(x, axis=0).T:  # unknown values last
        known = len(v) - int(np.isnan(v).sum())
        if by == "width":
            lo, hi = (float(v[0]), float(v[known - 1])) if known else (None, None)
            made.append([lo + (hi - lo) * j / bins if known else None for j in range(1, bins)])
        else:
            ranks = [max(math.ceil(j / bins * known), 1) - 1 for j in range(1, bins)] if known else []
            made.append(np.unique(v[ranks]).tolist())
    return made


def _trees_of(placed: np.ndarray, y: np.ndarray, *, rounds: int, depth: int, cells: int, rate: float, l2: float, min_rows: int, min_gain: float) -> list[dict]:
    """The trees of one series from its inputs' bins: the histograms and splits of ``_best_splits`` and ``_grown``."""
    inputs, size, rest, trees = placed.shape[1], 2 ** (depth + 1), y.copy(), []
    cell = placed + np.arange(inputs) * cells
    for _ in range(rounds):
        f, b, v, node = np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.zeros(size), np.ones(len(y), np.int64)
        for level in range(depth):
            on = np.flatnonzero(node >= 2**level)
            if not len(on):
                break
            nodes, which = np.unique(node[on], return_inverse=True)
            at = (which[:, None] * (inputs * cells) + cell[on]).ravel()
            shape = (len(nodes), inputs, cells)
            c = np.bincount(at, minlength=math.prod(shape)).reshape(shape)
            g = np.bincount(at, np.repeat(rest[on], inputs), math.prod(shape)).reshape(shape)
            gl, nl = np.cumsum(g, axis=2), np.cumsum(c, axis=2)
            ga, na = gl[:, :, -1:], nl[:, :, -1:]
            gr, nr = ga - gl, na - nl
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.round(gl * gl / (nl + l2) + gr * gr / (nr + l2) - ga * ga / (na + l2), 9)
            gain = np.where((c > 0) & (nl >= min_rows) & (nr >= min_rows) & (gain > min_gain), gain, -np.inf).reshape(len(nodes), -1)
            # Equal gains go to the first input and bin.
            best = gain.argmax(axis=1)
            for k in np.flatnonzero(np.isfinite(gain[np.arange(len(nodes)), best])):
                n, (i, j) = nodes[k], divmod(int(best[k]), cells)
                f[n], b[n] = i, j
                v[2 * n], v[2 * n + 1] = rate * gl[k, i, j] / (nl[k, i, j] + l2), rate * gr[k, i, j] / (nr[k, i, j] + l2)
            split = f[node]
            right = placed[np.arange(len(y)), np.maximum(split, 0)] > b[node]
            node = np.where(split >= 0, 2 * node + right, node)
        rest = rest - v[node]
        trees.append({"f": f, "b": b, "v": v})
    return trees


def _fit_whole(rows: DataFrame, keys: list[str], *, depth: int, bins: int, by: str, **grow) -> DataFrame:
    """Models of series that each lie in one task, ``rows`` being their ``(series…, _x, _y)``."""
    tree = pa.struct([("f", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("v", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches, keys):
            y, lists, made = _doubles(table, "_y"), table.column("_x").combine_chunks(), {"n": [], "base": [], "edges": [], "trees": []}
            for i, j in zip(starts, [*starts[1:], table.num_rows]):
                x = lists.slice(i, j - i).flatten().cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False).reshape(j - i, -1)
                edges, base = _cut_places(x, bins, by), float(y[i:j].mean())
                placed = [np.where(np.isnan(v), 0, 1 + np.searchsorted(np.array(e, float), v)) for v, e in zip(x.T, edges)]
                placed = np.column_stack(placed) if placed else np.zeros((j - i, 0), np.int64)
                made["n"].append(int(j - i))
                made["base"].append(base)
                made["edges"].append(edges)
                made["trees"].append(_trees_of(placed, y[i:j] - base, depth=depth, cells=bins + 1, **grow))
            columns = {"n": pa.array(made["n"], pa.int64()), "base": pa.array(made["base"], pa.float64()), "edges": pa.array(made["edges"], pa.list_(pa.list_(pa.float64())))}
            yield _batch(table.select(keys).take(pa.array(starts)), {**columns, "trees": pa.array(made["trees"], pa.list_(tree))})

    kinds = {"n": "bigint", "base": "double", "edges": "array<array<double>>", "trees": f"array<{_TREE}>"}
    out = T.StructType([*[rows.schema[k] for k in keys], *[T.StructField(n, T.DataType.fromDDL(t)) for n, t in kinds.items()]])
    made = _together(rows, keys).mapInArrow(run, out)
    return made.select(*keys, "n", "base", F.lit(depth).alias("depth"), "edges", "trees")


def _edges(rows: DataFrame, keys: list[str], x: str, bins: int, by: str) -> DataFrame:
    """Inner edges of the bins of every input: equal widths, or equal shares of the rows."""
    cells = rows.select(*keys, F.posexplode(x).alias("_i", "_v")).withColumn("_v", F.col("_v").cast("double"))
    known = F.when(_known(F.col("_v")), F.col("_v"))
    if by == "width":
        lo, hi = F.min(known), F.max(known)
        cut = F.array(*[lo + (hi - lo) * j / bins for j in range(1, bins)])
    else:
        cut = F.array_distinct(F.percentile_approx(known, [j / bins for j in range(1, bins)], 20 * bins))
    none = F.expr("cast(array() as array<double>)")
    per_input = cells.groupBy(*keys, "_i").agg(F.coalesce(cut, none).alias("_cut"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_cut")))
    return per_input.groupBy(*keys).agg(F.transform(ordered, lambda s: s["_cut"]).alias("edges"))


def _best_splits(rows: DataFrame, keys: list[str], depth: int, level: int, l2: float, min_rows: int, min_gain: float) -> DataFrame:
    """The best split of every node of ``level``; equal gains go to the first input and bin."""
    node = _leaf(F.col("_tree"), F.col("_bins"), level).alias("_node")
    rest = (F.col("_y") - _sum_of(F.col("_live"), F.col("_bins"), depth)).alias("_rest")
    at = rows.select(*keys, "_bins", node, rest).filter(F.col("_node") >= 2**level)
    cells = at.select(*keys, "_node", "_rest", F.posexplode("_bins").alias("_f", "_b"))
    hist = cells.groupBy(*keys, "_node", "_f", "_b").agg(F.sum("_rest").alias("_g"), F.count(F.lit(1)).alias("_c"))
    # A partition holds the bins of one input in one node.
    whole = Window.partitionBy(*keys, "_node", "_f")
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = hist.select(
        *keys, "_node", "_f", "_b",
        F.sum("_g").over(upto).alias("_gl"), F.sum("_c").over(upto).alias("_nl"),
        F.sum("_g").over(whole).alias("_ga"), F.sum("_c").over(whole).alias("_na"),
    )
    gr, nr = F.col("_ga") - F.col("_gl"), F.col("_na") - F.col("_nl")
    part = lambda g, n: g * g / (n + l2)
    gain = part(F.col("_gl"), F.col("_nl")) + part(gr, nr) - part(F.col("_ga"), F.col("_na"))
    sums = sums.withColumns({"_gr": gr, "_nr": nr}).filter((F.col("_nl") >= min_rows) & (F.col("_nr") >= min_rows))
    sums = sums.withColumn("_gain", F.round(gain, 9)).filter(F.col("_gain") > min_gain)
    rank = F.struct("_gain", -F.col("_f"), -F.col("_b"))
    return sums.groupBy(*keys, "_node").agg(F.max_by(F.struct("_f", "_b", "_gl", "_nl", "_gr", "_nr"), rank).alias("_split"))


def _grown(tree: Column, cuts: Column, rate: float, l2: float) -> Column:
    """``tree`` with the splits of ``cuts``, a map from node to split, and values for their children."""
    own = lambda n: F.element_at(cuts, n.cast("int"))
    value = lambda g, n: F.lit(rate) * g / (n + l2)

    def of_child(v: Column, n: Column) -> Column:
        up = F.element_at(cuts, F.floor(n / 2).cast("int"))
        mine = F.when(n % 2 == 0, value(up["_gl"], up["_nl"])).otherwise(value(up["_gr"], up["_nr"]))
        return F.coalesce(mine, v)

    return F.struct(
        F.transform(tree["f"], lambda f, n: F.coalesce(own(n)["_f"], f)).alias("f"),
        F.transform(tree["b"], lambda b, n: F.coalesce(own(n)["_b"].cast("int"), b)).alias("b"),
        F.transform(tree["v"], of_child).alias("v"),
    )


def fit_boosted(
    rows: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    *,
    rounds: int = 20,
    depth: int = 3,
    bins: int = 32,
    rate: float = 0.1,
    l2: float = 1.0,
    min_rows: int = 5,
    min_gain: float = 1e-9,
    by: str = "share",
) -> DataFrame:
    """Boosted regression trees on the array ``x`` for every series: ``(series…, n, base, depth, edges, trees)``.

    ``rounds`` trees of ``depth`` levels are fitted to what the trees before leave of ``y``,
    each worth ``rate``; a leaf's value is its residuals' sum over their number plus ``l2``,
    and both sides of a split hold ``min_rows`` rows. ``by`` places the ``bins`` by equal
    shares of the rows (beyond ``WHOLE_ROWS`` rows from a mergeable sketch) or by equal widths
    (``"width"``).

    An unknown input (NULL or NaN) goes left at every split on it. Rows with an unknown ``y``
    or no ``x`` are left out; a series without any other row has no model.
    """
    keys = list(keys)
    target = F.col(y).cast("double")
    known = materialise(rows.filter(_known(target) & F.col(x).isNotNull()).select(*keys, F.col(x).alias("_x"), target.alias("_y")), "boosting-rows")
    base = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("base"), F.min(F.size("_x")).alias("_short"), F.max(F.size("_x")).alias("_long"))
    base = materialise(base, "boosting-base")
    fits = (F.col("n") <= WHOLE_ROWS) & (F.col("_short") == F.col("_long"))
    whole = join_series(known, base.filter(fits).select(*keys), keys, "left_semi")
    whole = _fit_whole(whole, keys, rounds=rounds, depth=depth, bins=bins, rate=rate, l2=l2, min_rows=min_rows, min_gain=min_gain, by=by)
    base = base.filter(~fits).drop("_short", "_long")
    if base.isEmpty():
        return whole
    known = join_series(known, base.select(*keys), keys, "left_semi")
    head = materialise(join_series(base, _edges(known, keys, "_x", bins, by), keys, "inner"), "boosting-bins")
    binned = join_series(known, head.select(*keys, "base", "edges"), keys, "inner")
    binned = materialise(binned.select(*keys, _bins(F.col("_x"), F.col("edges")).alias("_bins"), (F.col("_y") - F.col("base")).alias("_y")), "binned")

    size = 2 ** (depth + 1)
    empty = F.struct(
        F.array_repeat(F.lit(-1), size).alias("f"), F.array_repeat(F.lit(-1), size).alias("b"), F.array_repeat(F.lit(0.0), size).alias("v")
    )
    none = F.expr(_NO_TREES)
    state = head.select(*keys, none.alias("trees"), none.alias("_live"), empty.alias("_tree"))
    for r in range(rounds):
        if r and r % LIVE_TREES == 0:
            seen = join_series(binned, state.select(*keys, "_live"), keys, "inner")
            binned = materialise(seen.select(*keys, "_bins", (F.col("_y") - _sum_of(F.col("_live"), F.col("_bins"), depth)).alias("_y")), "binned")
            state = state.withColumn("_live", none)
        for level in range(depth):
            seen = join_series(binned, state.select(*keys, "_live", "_tree"), keys, "inner")
            found = _best_splits(seen, keys, depth, level, l2, min_rows, min_gain)
            cuts = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_node", "_split"))).alias("_cuts"))
            grown = join_series(state, cuts, keys)
            grown = grown.withColumn("_tree", F.when(F.col("_cuts").isNull(), F.col("_tree")).otherwise(_grown(F.col("_tree"), F.col("_cuts"), rate, l2)))
            grown = grown.drop("_cuts")
            if level == depth - 1:
                done = F.array(F.col("_tree"))
                grown = grown.select(*keys, F.concat("trees", done).alias("trees"), F.concat("_live", done).alias("_live"), empty.alias("_tree"))
            state = materialise(grown, "boosting-trees")
    levels = join_series(head, state.select(*keys, "trees"), keys, "inner").select(*keys, "n", "base", F.lit(depth).alias("depth"), "edges", "trees")
    return levels.unionByName(whole)


def score_boosted(rows: DataFrame, model: DataFrame, keys: Sequence[str], x: str, *, depth: int) -> DataFrame:
    """Add ``yhat``, NULL where a series has no model; ``depth`` is that of the fit."""
    joined = join_series(rows, model.select(*keys, "base", _cuts(F.col("trees"), F.col("edges")).alias("_cuts")), list(keys))
    return joined.select(*rows.columns, (F.col("base") + _sum_at(F.col("_cuts"), F.col(x), depth)).alias("yhat"))


def fit_boosted_sequence(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    features: Sequence[str],
    target: str,
    *,
    lookback: int = 60,
    horizon: int = 10,
    share: float = 0.8,
    depth: int = 3,
    slot_s: float = 30 * DAY,
    block_rows: int = 4096,
    **fit,
) -> DataFrame:
    """Trees on the last ``lookback`` rows of ``features`` for each of the next ``horizon`` steps.

    One model per (series, step), all grown together. Samples of the last ``1 - share`` part
    of a series are left out; ``val_mae`` is the mean absolute error of that step on them.
    """
    keys = list(keys)
    names = [*keys, "h"]
    windows = training_windows(df, keys, ts, features, target, lookback=lookback, horizon=horizon, slot_s=slot_s, block_rows=block_rows)
    windows = materialise(windows.select(*keys, "sample_id", F.flatten("x").alias("x"), "y"), "windows")
    sizes = windows.groupBy(*keys).agg(F.floor(F.count(F.lit(1)) * share).alias("_limit"))
    samples = join_series(windows, sizes, keys, "inner").select(
        *keys, (F.col("sample_id") < F.col("_limit")).alias("_train"), "x", F.posexplode("y").alias("_h", "y")
    )
    samples = samples.withColumn("h", F.col("_h") + 1).drop("_h")
    model = materialise(fit_boosted(samples.filter("_train"), names, "x", "y", depth=depth, **fit), "boosted")
    held = score_boosted(samples.filter("not _train"), model, names, "x", depth=depth)
    quality = held.groupBy(*names).agg(F.avg(F.abs(F.col("yhat") - F.col("y"))).alias("val_mae"))
    return join_series(model, quality, names)


def forecast_boosted(model: DataFrame, windows: DataFrame, keys: Sequence[str], *, horizon: int, depth: int) -> DataFrame:
    """Forecast from inference windows ``(series…, ts, x)``: ``(series…, ts, h, yhat)``."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")
    rows = windows.select(*keys, "ts", F.flatten("x").alias("x"), steps)
    return score_boosted(rows, model, [*keys, "h"], "x", depth=depth).filter("yhat is not null").drop("x")

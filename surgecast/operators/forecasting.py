"""Per-series forecasters fitted by distributed least squares.

Both models are linear in their coefficients, so training needs only the sums X'X and X'y.
These are formed per (series, block) and added up per series; a small ridge solve finishes
each series. No task sees more than one block of a series. Tasks read sorted Arrow batches
that hold many short series, so a series costs its arithmetic and no call of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.blocks import BLOCK, DAY, OWN, POS, SLOT, join_series, row_blocks, with_positions, with_slot
from ..plans.blocks import group_starts as _starts
from ..plans.blocks import whole_groups as _whole_groups
from ..session import materialise, release

# Seasonal terms, changepoints and prior scales of the seasonal model.
DAILY_TERMS, WEEKLY_TERMS = 4, 3
CHANGEPOINTS, CHANGEPOINT_SHARE, CHANGEPOINT_PRIOR = 25, 0.8, 0.05
INTERVAL_WIDTH_Z = 1.2815515655446004  # an 80 % interval
NOISE_SCALE = 0.1
SEASON_PENALTY = 1e-4

_DOUBLES = T.ArrayType(T.DoubleType())


def _gram(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """X'X, of which one half is kept, and X'y."""
    return (x.T @ x)[np.triu_indices(x.shape[1])], (x.T @ y).ravel()


def _sums_schema(df: DataFrame, names: Sequence[str]) -> T.StructType:
    fields = [df.schema[c] for c in names]
    extra = [("xx", _DOUBLES), ("xy", _DOUBLES), ("n", T.LongType())]
    return T.StructType([*fields, *[T.StructField(n, t) for n, t in extra]])


def _doubles(table: pa.Table | pa.RecordBatch, c: str) -> np.ndarray:
    """A numeric column with NaN where it is NULL."""
    column = table.column(c).cast(pa.float64())
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.fill_null(math.nan).to_numpy(zero_copy_only=False)


def _batch(heads: pa.Table, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The group columns of ``heads`` with ``columns`` beside them."""
    named = {**{c: heads.column(c).combine_chunks() for c in heads.column_names}, **columns}
    return pa.RecordBatch.from_arrays(list(named.values()), names=list(named))


def _sums_out(heads: pa.Table, sums: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
    xx, xy, n = zip(*sums)
    return _batch(heads, {"xx": pa.array(xx, pa.list_(pa.float64())), "xy": pa.array(xy, pa.list_(pa.float64())), "n": pa.array(n, pa.int64())})


def _totals(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[pa.Table, list[tuple[np.ndarray, np.ndarray, int]]]]:
    """Totals of the sums (xx, xy, n) of each group in batches sorted by ``names``; a task holds one group's totals beside a batch."""
    head, total = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch, names)
        heads = pa.Table.from_batches([batch]).select(list(names)).take(pa.array(starts))
        xx, xy, n = batch.column("xx"), batch.column("xy"), batch.column("n").to_numpy()
        goes_on = head is not None and head.to_pylist() == heads.slice(0, 1).to_pylist()
        ended, done = [], []
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], batch.num_rows])):
            if total is not None and not (i == 0 and goes_on):
                ended.append(head)
                done.append(total)
                total = None
            head = heads.slice(i, 1)
            for j in range(a, b):
                more = np.asarray(xx[j].values), np.asarray(xy[j].values), int(n[j])
                total = more if total is None else tuple(u + v for u, v in zip(total, more))
        if done:
            yield pa.concat_tables(ended), done
    if total is not None:
        yield head, [total]


def lasso(a: np.ndarray, c: np.ndarray, l1: np.ndarray, sweeps: int = 4000, tol: float = 1e-13) -> np.ndarray:
    """The ``b`` that minimises b'ab / 2 - c'b + sum(l1 |b|); coordinates with no ``l1`` are free.

    The free coordinates are solved out, the others found by coordinate descent with soft
    thresholds, and once the signs are known their values by one solve.
    """
    pen, free = np.flatnonzero(l1 > 0), np.flatnonzero(l1 == 0)
    across = a[np.ix_(pen, free)] @ np.linalg.pinv(a[np.ix_(free, free)]) if len(free) else np.zeros((len(pen), 0))
    left, right, limit = a[np.ix_(pen, pen)] - across @ a[np.ix_(free, pen)], c[pen] - across @ c[free], l1[pen]
    b, rest = np.zeros(len(pen)), right.copy()
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(pen)):
            if left[j, j] > 0:
                at = rest[j] + left[j, j] * b[j]
                step = np.sign(at) * max(abs(at) - limit[j], 0.0) / left[j, j] - b[j]
                if step:
                    b[j] += step
                    rest -= left[:, j] * step
                    moved = max(moved, abs(step))
        if moved < tol:
            break
    on = np.flatnonzero(b)
    if len(on):
        exact = np.linalg.lstsq(left[np.ix_(on, on)], right[on] - limit[on] * np.sign(b[on]), rcond=None)[0]
        if (np.sign(exact) == np.sign(b[on])).all():
            b[on] = exact
    out = np.zeros(len(c))
    out[pen] = b
    if len(free):
        out[free] = np.linalg.lstsq(a[np.ix_(free, free)], c[free] - a[np.ix_(free, pen)] @ b, rcond=None)[0]
    return out


def _solved(penalty: Sequence[float], l1: Sequence[float] | None = None) -> Callable[[np.ndarray, np.ndarray], np.ndarray | None]:
    """Coefficients from sums; none from sums that are not finite."""
    ridge, sparse = np.diag(np.asarray(penalty)), np.asarray(l1 or [0.0])

    def run(xx: np.ndarray, xy: np.ndarray) -> np.ndarray | None:
        p = len(ridge)
        if not (np.isfinite(xx).all() and np.isfinite(xy).all()):
            return None
        left = np.zeros((p, p))
        left[np.triu_indices(p)] = xx
        left, right = left + np.triu(left, 1).T + ridge, xy.reshape(p, -1)
        if sparse.any():
            return lasso(left, right[:, 0], sparse)
        try:
            coef = np.linalg.solve(left, right)
        except np.linalg.LinAlgError:
            coef = np.linalg.lstsq(left, right, rcond=None)[0]
        return coef.ravel()

    return run


#: Rows of a series that one task holds at once.
WHOLE_ROWS = 4096

#: Block sums that meet in one task on the way to a series' total.
FAN_IN = 32


def _together(rows: DataFrame, names: Sequence[str], *order: str) -> DataFrame:
    """Rows of a group in one task, one after the other."""
    return rows.repartition(*names).sortWithinPartitions(*names, *order)


def _group(block: str, n: Column) -> Column:
    """The group of a block of a series that has ``n`` of them."""
    return F.pmod(F.xxhash64(block), F.ceil(n / FAN_IN))


def _fit_sums(sums: DataFrame, keys: list[str], penalty: list[float], l1: list[float] | None = None) -> DataFrame:
    """Add up the block sums of each series in two steps and solve; one row out per series.

    A series' blocks are first added in groups ``_g`` of about ``FAN_IN`` each, so a
    task of the last step sees one row for each of those. Sums that are not finite give NULL
    coefficients.
    """
    solve = _solved(penalty, l1)
    out = T.StructType([*[sums.schema[c] for c in keys], T.StructField("coef", _DOUBLES), T.StructField("n", T.LongType())])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for heads, totals in _totals(batches, [*keys, "_g"]):
            yield _sums_out(heads.select(keys), totals)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for heads, totals in _totals(batches, keys):
            coef = pa.array([solve(xx, xy) for xx, xy, _ in totals], pa.list_(pa.float64()))
            yield _batch(heads, {"coef": coef, "n": pa.array([n for _, _, n in totals], pa.int64())})

    partly = _together(sums.select(*keys, "_g", "xx", "xy", "n"), [*keys, "_g"]).mapInArrow(some, _sums_schema(sums, keys))
    return _together(partly, keys).mapInArrow(whole, out)


def ridge_fit(rows: DataFrame, keys: Sequence[str], x: str, y: str, penalty: Sequence[float], l1: Sequence[float] | None = None) -> DataFrame:
    """Least squares per series for rows that carry a slot, a design array and a target.

    A task adds up what lies together, so rows sorted by series and slot give the fewest sums.
    ``penalty`` weighs squares and ``l1`` absolute values of the coefficients. Rows with an unknown value are left out of the sums and of ``n``.
    """
    names = [*keys, SLOT]
    p = len(penalty)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums of a slot's rows in one batch; a slot that lies in several has a row for each.
        for batch in batches:
            if not batch.num_rows:
                continue
            a = batch.column(x).flatten().fill_null(math.nan).to_numpy(zero_copy_only=False).reshape(-1, p)
            b = _doubles(batch, y)
            good = np.isfinite(a).all(axis=1) & np.isfinite(b)
            starts = _starts(batch, names)
            sums = []
            for i, j in zip(starts, [*starts[1:], batch.num_rows]):
                use = good[i:j]
                sums.append((*_gram(a[i:j][use], b[i:j][use][:, None]), int(use.sum())))
            yield _sums_out(pa.Table.from_batches([batch]).select(names).take(pa.array(starts)), sums)

    sums = materialise(rows.select(*names, x, y).mapInArrow(partial, _sums_schema(rows, names)), "sums")
    size = sums.groupBy(*keys).agg(F.count("*").alias("_n"))
    grouped = join_series(sums, size, keys, "inner").withColumn("_g", _group(SLOT, F.col("_n")))
    return _fit_sums(grouped, list(keys), list(penalty), list(l1) if l1 else None)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


# -- seasonal model ---------------------------------------------------------------------


def _trend_terms(tau: Column, changepoints: int = CHANGEPOINTS) -> list[Column]:
    """Intercept, slope and a hinge per changepoint, on time scaled to [0, 1]."""
    spots = [CHANGEPOINT_SHARE * (j + 1) / (changepoints + 1) for j in range(changepoints)]
    return [F.lit(1.0), tau, *[F.greatest(F.lit(0.0), tau - s) for s in spots]]


def _season_terms(ts: str, daily: int = DAILY_TERMS, weekly: int = WEEKLY_TERMS) -> list[Column]:
    seconds = F.unix_micros(ts) / 1_000_000.0
    terms = []
    for period, order in ((86_400.0, daily), (604_800.0, weekly)):
        for k in range(1, order + 1):
            angle = seconds * (2.0 * math.pi * k / period)
            terms += [F.sin(angle), F.cos(angle)]
    return terms


def _tau(ts: str) -> Column:
    span = F.greatest(F.unix_micros("t1") - F.unix_micros("t0"), F.lit(1))
    return (F.unix_micros(ts) - F.unix_micros("t0")) / span


def fit_seasonal(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    target: str,
    *,
    changepoints: int = CHANGEPOINTS,
    changepoint_prior: float = CHANGEPOINT_PRIOR,
    daily: int = DAILY_TERMS,
    weekly: int = WEEKLY_TERMS,
    slot_s: float = 30 * DAY,
    sparse: bool = False,
    whole_rows: int = WHOLE_ROWS,
) -> DataFrame:
    """Fit ``y = trend * (1 + season)`` per series; one row of coefficients per series.

    Hinges have a normal prior or, with ``sparse``, a Laplace one: most of them are zero
    then, and the trend bends only where the rows ask for it.

    First the trend, with seasonal terms beside it so that it is not bent by them, then what
    is left of ``y`` on the seasonal terms times the trend, so that no row is left out where
    the trend is near zero. ``changepoints``, ``daily`` and ``weekly`` say how many hinges
    and harmonics there are; zero switches them off. ``sigma`` and ``mae`` are in-sample.

    Series of up to ``whole_rows`` rows are solved by the task that holds them, longer ones
    by the sums of their slots.
    """
    keys = list(keys)
    spans = df.groupBy(*keys).agg(
        F.min(ts).alias("t0"), F.max(ts).alias("t1"), F.greatest(F.max(F.abs(F.col(target))), F.lit(1e-12)).alias("scale"), F.count(F.lit(1)).alias("_n")
    )
    spans = materialise(spans, "spans")
    narrow = df.select(*keys, F.col(ts).alias("ts"), F.col(target).cast("double").alias("y")).filter("y is not null and not isnan(y)")
    trend_p = [1e-9, 1e-9] + [1e-9 if sparse else (NOISE_SCALE / changepoint_prior) ** 2] * changepoints
    season_p = [SEASON_PENALTY] * (2 * (daily + weekly))
    l1 = [0.0, 0.0, *[NOISE_SCALE**2 / changepoint_prior] * changepoints, *[0.0] * len(season_p)] if sparse else None
    terms = F.array(*_trend_terms(_tau("ts"), changepoints), *_season_terms("ts", daily, weekly)).alias("x")

    def scaled(which: str) -> DataFrame:
        return narrow.join(spans.filter(which).drop("_n"), keys).withColumn("y", F.col("y") / F.col("scale"))

    # A series that is whole in a task is solved there: its sums, larger than its rows, are written nowhere.
    rows = _together(scaled(f"_n <= {whole_rows}"), keys, "ts")
    head = [*keys, "t0", "t1", "scale"]
    out = T.StructType(
        [
            *[rows.schema[c] for c in head],
            *[T.StructField(c, _DOUBLES) for c in ("trend", "season")],
            *[T.StructField(c, T.DoubleType()) for c in ("sigma", "mae")],
            T.StructField("n", T.LongType()),
        ]
    )
    alone = rows.select(*head, "y", terms).mapInArrow(_seasonal_alone(keys, head, trend_p, season_p, l1), out)
    columns = [*head, "trend", F.lit(daily).alias("daily"), F.lit(weekly).alias("weekly"), "season", "sigma", "mae", "n"]
    alone = alone.select(*columns)
    if spans.filter(f"_n > {whole_rows}").isEmpty():
        return alone

    # Shuffle the narrow rows once, so that slots lie together; the design arrays are built where they are read.
    rows = _together(with_slot(scaled(f"_n > {whole_rows}"), "ts", slot_s), [*keys, SLOT])
    rows = materialise(rows, "seasonal-rows")
    first = ridge_fit(rows.select(*keys, SLOT, "y", terms), keys, "x", "y", trend_p + season_p, l1)
    trend = materialise(first.select(*keys, F.slice("coef", 1, len(trend_p)).alias("trend")), "seasonal-trend")
    model = join_series(spans.drop("_n"), trend, keys, "inner").withColumns({"daily": F.lit(daily), "weekly": F.lit(weekly)})
    if season_p:
        level = _dot(F.col("trend"), F.array(*_trend_terms(_tau("ts"), changepoints)))
        rest = join_series(rows, trend, keys, "inner").select(*keys, SLOT, "ts", "y", level.alias("_level")).sortWithinPartitions(*keys, SLOT)
        swing = F.array(*[t * F.col("_level") for t in _season_terms("ts", daily, weekly)])
        rest = rest.select(*keys, SLOT, (F.col("y") - F.col("_level")).alias("y"), swing.alias("x"))
        season = ridge_fit(rest, keys, "x", "y", season_p).select(*keys, F.col("coef").alias("season"))
        model = join_series(model, season, keys)
    else:
        model = model.withColumn("season", F.array().cast(_DOUBLES))
    model = materialise(model, "seasonal-model")

    fitted = score_seasonal(rows.select(*keys, "ts", (F.col("y") * F.col("scale")).alias("y")), model, keys, "ts")
    error = F.col("y") - F.col("yhat")
    quality = fitted.groupBy(*keys).agg(
        F.sqrt(F.avg(error * error)).alias("sigma"), F.avg(F.abs(error)).alias("mae"), F.count(F.lit(1)).alias("n")
    )
    return alone.unionByName(model.join(quality, keys))


def _seasonal_alone(keys: Sequence[str], head: Sequence[str], trend_p: list[float], season_p: list[float], l1: list[float] | None):
    """The seasonal model of every series from its whole rows, scaled ``y`` and the terms ``x``."""
    k, p = len(trend_p), len(trend_p) + len(season_p)
    solve_trend, solve_season = _solved(trend_p + season_p, l1), _solved(season_p)

    def sums(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good = np.isfinite(x).all(axis=1) & np.isfinite(y)
        return _gram(x[good], y[good][:, None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches, keys):
            a = table.column("x").combine_chunks().flatten().fill_null(math.nan).to_numpy(zero_copy_only=False).reshape(-1, p)
            b, scales = _doubles(table, "y"), _doubles(table, "scale")
            trends, seasons, sigmas, maes, counts = [], [], [], [], []
            for i, j in zip(starts, [*starts[1:], table.num_rows]):
                x, y, scale, trend, season, sigma, mae = a[i:j], b[i:j], scales[i], None, [], None, None
                found = solve_trend(*sums(x, y))
                if found is not None:
                    trend = found[:k]
                with np.errstate(all="ignore"):
                    level = x[:, :k] @ trend if trend is not None else np.full(len(y), math.nan)
                    if season_p:
                        season = solve_season(*sums(x[:, k:] * level[:, None], y - level))
                    if trend is not None:
                        swing = x[:, k:] @ season if season_p and season is not None else 0.0
                        error = y * scale - scale * level * (1.0 + swing)
                        sigma, mae = math.sqrt(np.mean(error * error)), float(np.mean(np.abs(error)))
                for values, v in zip((trends, seasons, sigmas, maes, counts), (trend, season, sigma, mae, j - i)):
                    values.append(v)
            doubles = pa.list_(pa.float64())
            made = {"trend": pa.array(trends, doubles), "season": pa.array(seasons, doubles), "sigma": pa.array(sigmas, pa.float64()), "mae": pa.array(maes, pa.float64())}
            yield _batch(table.select(list(head)).take(pa.array(starts)), made | {"n": pa.array(counts, pa.int64())})

    return run


def score_seasonal(rows: DataFrame, model: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Add ``yhat``: a projection over the joined coefficients, no Python involved.

    The model says how many terms it has; a series without a model gets NULL.
    """
    joined = join_series(rows, model.select(*keys, "t0", "t1", "scale", "trend", "season", "daily", "weekly"), keys)
    tau = _tau(ts)
    # Coefficients from the third on belong to hinges, spread evenly over the changepoint share.
    hinges = F.size("trend") - 2
    hinge = lambda c, i: F.when(i < 2, c * F.when(i == 0, 1.0).otherwise(tau)).otherwise(
        c * F.greatest(F.lit(0.0), tau - F.lit(CHANGEPOINT_SHARE) * (i - 1) / (hinges + 1))
    )
    level = F.aggregate(F.transform("trend", hinge), F.lit(0.0), lambda s, v: s + v)
    seconds = F.unix_micros(ts) / 1_000_000.0
    by_day = F.col("daily") * 2

    def wave(c: Column, i: Column) -> Column:
        at = F.when(i < by_day, i).otherwise(i - by_day)
        angle = seconds * (F.lit(2.0 * math.pi) * (F.floor(at / 2) + 1) / F.when(i < by_day, F.lit(86_400.0)).otherwise(604_800.0))
        return c * F.when(at % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))

    swing = F.coalesce(F.aggregate(F.transform("season", wave), F.lit(0.0), lambda s, v: s + v), F.lit(0.0))
    return joined.select(*rows.columns, (F.col("scale") * level * (1.0 + swing)).alias("yhat"))


def forecast_grid(last: DataFrame, keys: Sequence[str], ts: str, step_s: int, horizon: int) -> DataFrame:
    """The next ``horizon`` steps after each series' last timestamp."""
    at = F.timestamp_micros(F.unix_micros(ts) + F.col("h").cast("long") * F.lit(step_s * 1_000_000))
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")
    return last.select(*keys, ts, steps).select(*keys, "h", at.alias(ts))


def forecast_seasonal(
    model: DataFrame, last: DataFrame, keys: Sequence[str], ts: str, *, step_s: int = 60, horizon: int = 10, z: float = INTERVAL_WIDTH_Z
) -> DataFrame:
    """Forecast with a band of ``z`` in-sample deviations."""
    scored = score_seasonal(forecast_grid(last, keys, ts, step_s, horizon), model, keys, ts)
    scored = join_series(scored, model.select(*keys, "sigma"), keys)
    margin = F.col("sigma") * z
    return scored.select(
        *keys, "h", ts, "yhat", (F.col("yhat") - margin).alias("yhat_lower"), (F.col("yhat") + margin).alias("yhat_upper")
    )


def seasonal_naive(history: DataFrame, points: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Forecast each point by the mean of the same weekday and hour."""
    slot = [F.weekday(ts).alias("_d"), F.hour(ts).alias("_h")]
    means = history.groupBy(*keys, *slot).agg(F.avg(value).alias("yhat"))
    return points.select("*", *slot).join(means, [*keys, "_d", "_h"], "left").drop("_d", "_h")


# -- sequence model ---------------------------------------------------------------------


def _samples(values: np.ndarray, goal: np.ndarray, own: np.ndarray, lookback: int, horizon: int):
    """Design, target and place of the last history row of every full window of a block whose last history row is its own.

    A block's rows are consecutive, so windows are strided views of one array.
    """
    n = len(values) - lookback - horizon + 1
    if n <= 0:
        return None
    view = np.lib.stride_tricks.sliding_window_view
    x = view(values, lookback, axis=0)[:n].transpose(0, 2, 1).reshape(n, -1)
    y = view(goal[lookback:], horizon)[:n]
    at = np.arange(lookback - 1, lookback - 1 + n)
    # Windows with an unknown value teach nothing.
    use = own[at].astype(bool) & np.isfinite(x).all(axis=1) & np.isfinite(y).all(axis=1)
    return np.hstack([np.ones((n, 1)), x])[use], y[use], at[use]


def _train_limit(n: Column, lookback: int, horizon: int, share: float) -> Column:
    """Position of the last history row that belongs to the training part."""
    return F.floor((n - (lookback + horizon - 1)) * share) + (lookback - 1)


def _sequence_blocks(df, keys, ts, features, target, lookback, horizon, share, slot_s, block_rows):
    placed = with_positions(df, keys, ts, slot_s=slot_s, total="_n")
    placed = placed.withColumn("_limit", _train_limit(F.col("_n"), lookback, horizon, share))
    cols = list(dict.fromkeys([*features, target]))
    # A series that fits into one block needs no copies of its rows in others.
    whole = F.col("_n") <= block_rows
    narrow = placed.select(*keys, POS, "_limit", whole.alias("_whole"), F.ceil(F.col("_n") / block_rows).alias("_blocks"), *cols)
    return row_blocks(narrow, size=block_rows, back=lookback - 1, ahead=horizon).filter(F.col(OWN) | ~F.col("_whole"))


def fit_sequence(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    features: Sequence[str],
    target: str,
    *,
    lookback: int = 60,
    horizon: int = 10,
    share: float = 0.8,
    penalty: float = 1e-2,
    slot_s: float = 30 * DAY,
    block_rows: int = 4096,
) -> DataFrame:
    """Direct multi-horizon ridge regression on the last ``lookback`` rows of ``features``.

    All horizons share X'X, so one pass trains them together. Samples of the last
    ``1 - share`` part of a series are left out; ``val_mae`` is the mean absolute error on
    them (NULL when there are none). Windows that hold an unknown value are left out and not
    counted in ``n``. Series of up to ``block_rows`` rows are solved by the task that holds
    them, longer ones by the sums of their blocks.
    """
    keys, features = list(keys), list(features)
    blocks = _sequence_blocks(df, keys, ts, features, target, lookback, horizon, share, slot_s, block_rows)
    names, cols = [*keys, BLOCK], list(dict.fromkeys([*features, target]))

    written = materialise(blocks, "sequence-blocks")
    blocks, whole = written.filter("not _whole").withColumn("_g", _group(BLOCK, F.col("_blocks"))), written.filter("_whole")
    penalties = [1e-9] + [penalty] * (lookback * len(features))

    def windows(table: pa.Table, starts: np.ndarray, skip: np.ndarray):
        """Number, samples and training flags of every block that has samples, without its first ``skip`` rows."""
        values, goal = np.column_stack([_doubles(table, c) for c in features]), _doubles(table, target)
        own, pos, limit = (table.column(c).combine_chunks().cast(pa.int64()).fill_null(0).to_numpy() for c in (OWN, POS, "_limit"))
        for k, (i, j) in enumerate(zip(starts + skip, [*starts[1:], table.num_rows])):
            made = _samples(values[i:j], goal[i:j], own[i:j], lookback, horizon)
            if made is not None:
                x, y, at = made
                yield k, x, y, pos[i:j][at] <= limit[i:j][at]

    def missed_by(coef: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.abs(x @ coef.reshape(x.shape[1], -1) - y)

    # A series that is whole in a task is solved there: its sums, larger than its rows, are written nowhere.
    solve = _solved(penalties)
    out = T.StructType([*[whole.schema[c] for c in keys], T.StructField("coef", _DOUBLES), T.StructField("n", T.LongType()), T.StructField("val_mae", T.DoubleType())])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches, keys):
            found, coefs, counts, maes = [], [], [], []
            for k, x, y, train in windows(table, starts, np.zeros(len(starts), np.int64)):
                if train.any():
                    coef = solve(*_gram(x[train], y[train]))
                    known = coef is not None and not train.all()
                    found.append(starts[k])
                    coefs.append(coef)
                    counts.append(int(train.sum()))
                    maes.append(float(missed_by(coef, x[~train], y[~train]).mean()) if known else None)
            if found:
                made = {"coef": pa.array(coefs, pa.list_(pa.float64())), "n": pa.array(counts, pa.int64()), "val_mae": pa.array(maes, pa.float64())}
                yield _batch(table.select(keys).take(pa.array(found)), made)

    fitted = materialise(_together(whole.select(*keys, POS, "_limit", OWN, *cols), keys, POS).mapInArrow(alone, out), "sequence-whole")
    if blocks.isEmpty():
        release(written)
        return fitted

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches, names):
            found, sums = [], []
            for k, x, y, train in windows(table, starts, np.zeros(len(starts), np.int64)):
                if train.any():
                    found.append(starts[k])
                    sums.append((*_gram(x[train], y[train]), int(train.sum())))
            if found:
                yield _sums_out(table.select([*keys, "_g"]).take(pa.array(found)), sums)

    sums = _together(blocks, names, POS).mapInArrow(partial, _sums_schema(blocks, [*keys, "_g"]))
    model = materialise(_fit_sums(sums, keys, penalties), "sequence-model")
    missing = T.StructType([*[blocks.schema[c] for c in keys], T.StructField("miss", T.DoubleType()), T.StructField("terms", T.LongType())])

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches, names):
            # A block's first row brings its coefficients, or the series has none.
            coefs = table.column("coef").combine_chunks()
            has = coefs.is_valid().to_numpy(zero_copy_only=False)
            found, miss, terms = [], [], []
            for k, x, y, train in windows(table, starts, has[starts].astype(np.int64)):
                val = ~train
                if has[starts[k]] and val.any():
                    off = missed_by(np.asarray(coefs[starts[k]].values), x[val], y[val])
                    found.append(starts[k])
                    miss.append(float(off.sum()))
                    terms.append(int(off.size))
            if found:
                yield _batch(table.select(keys).take(pa.array(found)), {"miss": pa.array(miss), "terms": pa.array(terms, pa.int64())})

    # One coefficient row per block, not per data row; it comes before the block's rows.
    block_names = blocks.select(*[F.col(c).alias(c) for c in names]).distinct()
    per_block = join_series(block_names, model.select(*keys, "coef").filter("coef is not null"), keys, "inner")
    rows = blocks.unionByName(per_block.withColumn(POS, F.lit(0)), allowMissingColumns=True)
    missed = _together(rows, names, POS).mapInArrow(errors, missing)
    quality = missed.groupBy(*keys).agg((F.sum("miss") / F.sum("terms")).alias("val_mae"))
    long = materialise(model.join(quality, keys, "left"), "sequence-long")
    release(written, model)
    return fitted.unionByName(long)


def forecast_sequence(model: DataFrame, windows: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """Forecast from inference windows ``(series…, ts, x)``: ``(series…, ts, h, yhat)``."""
    joined = join_series(windows, model.select(*keys, "coef").filter("coef is not null"), keys, "inner")
    flat = F.concat(F.array(F.lit(1.0)), F.transform(F.flatten("x"), lambda v: v.cast("double")))
    steps = joined.select(*keys, "ts", "coef", flat.alias("_x"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    # Coefficients are stored row by row: one row per input, one column per horizon step.
    column = F.transform("_x", lambda v, i: v * F.get("coef", i * horizon + F.col("h") - 1))
    return steps.select(*keys, "ts", "h", F.aggregate(column, F.lit(0.0), lambda s, v: s + v).alias("yhat"))


# -- shared -----------------------------------------------------------------------------


def mae(df: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    aggs = [F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mae"), F.count(F.lit(1)).alias("n")]
    return df.groupBy(*keys).agg(*aggs)


def long_enough(df: DataFrame, keys: Sequence[str], ts: str, min_hours: float = 72) -> DataFrame:
    """Training span per series and whether it allows the sequence model."""
    hours = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 3_600_000_000
    return df.groupBy(*keys).agg(hours.alias("hours")).withColumn("trains_sequence", F.col("hours") >= min_hours)

"""Cleaning, features, scaling and sequence building."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, features, normalize, sequences
from ..plans import flows
from ..plans.blocks import parts_for, slot_for
from ..sources.tables import METRICS, SERIES, read_table
from .base import BY, CLEANED, FRAME, INTERPOLATED, KEYS, PRIMARY, frame, query, r, rounded, rs

# -- cleaning ---------------------------------------------------------------------------


@query("interpolate", "E1", f"WITH {INTERPOLATED} SELECT {KEYS}, ts, {rs(METRICS)} FROM interpolated")
def interpolate(spark, sf_dir):
    return rounded(cleaning.interpolate(frame(spark, sf_dir), SERIES, "ts", METRICS))


GAP = 8 * 3600


@query(
    "interpolate_max_gap",
    "E2",
    f"""WITH {INTERPOLATED} SELECT k.namespace, k.deployment, k.ts, {r(f'CASE WHEN k.cpu_usage IS NOT NULL OR coalesce(k.n_cpu_usage.t, epoch_us(k.ts)) - coalesce(k.p_cpu_usage.t, epoch_us(k.ts)) <= {GAP}::BIGINT * 1000000 THEN i.cpu_usage END', 'cpu_usage')}
    FROM known k JOIN interpolated i USING ({KEYS}, ts)""",
)
def interpolate_max_gap(spark, sf_dir):
    """Holes wider than eight hours stay NULL."""
    filled = cleaning.interpolate(frame(spark, sf_dir), SERIES, "ts", ["cpu_usage"], max_gap_s=GAP)
    return rounded(filled.select(*SERIES, "ts", "cpu_usage"))


@query("clip_outliers", "E3", f"WITH {CLEANED} SELECT {KEYS}, ts, {rs(METRICS)} FROM cleaned")
def clip_outliers(spark, sf_dir):
    filled = cleaning.interpolate(frame(spark, sf_dir), SERIES, "ts", METRICS)
    return rounded(cleaning.clip_outliers(filled, SERIES, METRICS))


@query(
    "clip_counts",
    "E4",
    f"WITH {CLEANED}, both_rows AS (SELECT c.namespace, c.deployment, "
    + ", ".join(f"(c.{m} <> i.{m})::INT AS {m}" for m in METRICS)
    + f" FROM cleaned c JOIN interpolated i USING ({KEYS}, ts)) "
    + " UNION ALL ".join(f"SELECT {KEYS}, '{m}' AS \"column\", sum({m})::BIGINT AS clipped FROM both_rows GROUP BY {KEYS}" for m in METRICS),
)
def clip_counts(spark, sf_dir):
    filled = cleaning.interpolate(frame(spark, sf_dir), SERIES, "ts", METRICS)
    return cleaning.clip_counts(filled, SERIES, METRICS)


@query(
    "clip_supplier_prices",
    "E3",
    f"""WITH s AS (SELECT l_suppkey, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, count(*) AS n, sum((l_extendedprice > m + 1.5 * d OR l_extendedprice < m - 1.5 * d)::INT)::BIGINT AS clipped,
           {r('sum(least(greatest(l_extendedprice, m - 1.5 * d), m + 1.5 * d))', 'total', 2)}
    FROM lineitem JOIN s USING (l_suppkey) GROUP BY ALL""",
)
def clip_supplier_prices(spark, sf_dir):
    """Volume run: clip order-line prices per supplier at 1.5 deviations."""
    rows = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    rows = rows.withColumn("raw", F.col("l_extendedprice"))
    clipped = cleaning.clip_outliers(rows, ["l_suppkey"], ["l_extendedprice"], 1.5)
    return rounded(
        clipped.groupBy("l_suppkey").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("raw") != F.col("l_extendedprice")).alias("clipped"),
            F.sum("l_extendedprice").alias("total"),
        ),
        2,
    )


@query(
    "fill_remaining",
    "E5",
    f"""WITH {FRAME} SELECT {KEYS}, ts, """
    + ", ".join(
        r(f"coalesce(last_value({m} IGNORE NULLS) OVER p, first_value({m} IGNORE NULLS) OVER n)", m) for m in METRICS
    )
    + f""" FROM frame WINDOW p AS ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    n AS ({BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
def fill_remaining(spark, sf_dir):
    return rounded(cleaning.fill_remaining(frame(spark, sf_dir), SERIES, "ts", METRICS))


@query(
    "quality_report",
    "E6",
    f"WITH {FRAME} "
    + " UNION ALL ".join(
        f"SELECT {KEYS}, '{m}' AS \"column\", count({m}) AS count, count(*) - count({m}) AS nulls, "
        f"{r(f'(count(*) - count({m})) / count(*) * 100', 'null_pct')}, {r(f'avg({m})', 'mean')}, "
        f"{r(f'stddev_samp({m})', 'std')}, {r(f'min({m})', 'min')}, {r(f'max({m})', 'max')} FROM frame GROUP BY {KEYS}"
        for m in METRICS
    ),
)
def quality_report(spark, sf_dir):
    return rounded(cleaning.quality_report(frame(spark, sf_dir), SERIES, exclude=["ts"], round_values=False))


@query("clean_frame", "E1 E3 E5 B4 B7", f"WITH {CLEANED} SELECT {KEYS}, ts, {rs(METRICS)} FROM cleaned")
def clean_frame(spark, sf_dir):
    return rounded(cleaning.clean(frame(spark, sf_dir), SERIES, "ts"))


# -- features ---------------------------------------------------------------------------


def cleaned(spark, sf_dir, grid=None):
    return cleaning.clean(frame(spark, sf_dir) if grid is None else grid, SERIES, "ts")


def rows_frame(back: int) -> str:
    return f"OVER ({BY} ROWS BETWEEN {back - 1} PRECEDING AND CURRENT ROW)"


def rolling_sql(cols, sizes, stats=("mean", "std")):
    out = []
    for c in cols:
        for n in sizes:
            if "mean" in stats:
                out.append((f"avg({c}) {rows_frame(n)}", f"{c}_rolling_mean_{n}m"))
            if "std" in stats:
                out.append((f"coalesce(stddev_samp({c}) {rows_frame(n)}, 0)", f"{c}_rolling_std_{n}m"))
    return out


def difference_sql(cols):
    return [(f"coalesce({c} - lag({c}) OVER ({BY}), 0)", f"{c}_rate_of_change") for c in cols]


def lag_sql(cols):
    return [(f"lag({c}, {n}) OVER ({BY})", f"lag_{c}_{n}m") for c in cols for n in (15, 60)]


CALENDAR_SQL = [
    ("sin(2 * pi() * (hour(ts) + minute(ts) / 60.0::DOUBLE) / 24)", "hour_sin"),
    ("cos(2 * pi() * (hour(ts) + minute(ts) / 60.0::DOUBLE) / 24)", "hour_cos"),
    ("sin(2 * pi() * (isodow(ts) - 1) / 7)", "dow_sin"),
    ("cos(2 * pi() * (isodow(ts) - 1) / 7)", "dow_cos"),
]
WEEKEND_SQL = "CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend"


def select_rounded(items, places=6):
    return ", ".join(r(e, n, places) for e, n in items)


def ema_ctes(cols, span=30) -> str:
    """The recurrence itself, followed row by row."""
    a = 2.0 / (span + 1)
    step = ", ".join(f"{a!r} * n.{c} + {1 - a!r} * e.{c}_ema_{span} AS {c}_ema_{span}" for c in cols)
    return f"""numbered AS (SELECT *, row_number() OVER ({BY}) AS rn FROM cleaned),
ema AS (
  SELECT {KEYS}, ts, rn, {', '.join(f'{c} AS {c}_ema_{span}' for c in cols)} FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.namespace, n.deployment, n.ts, n.rn, {step}
  FROM ema e JOIN numbered n ON n.namespace = e.namespace AND n.deployment = e.deployment AND n.rn = e.rn + 1)"""


@query("rolling_mean", "F1", f"WITH {CLEANED} SELECT {KEYS}, ts, {select_rounded(rolling_sql(PRIMARY, (5, 15, 60), ['mean']))} FROM cleaned")
def rolling_mean(spark, sf_dir):
    out = features.row_features(cleaned(spark, sf_dir), SERIES, "ts", PRIMARY, rolling=(5, 15, 60), rolling_stats=["mean"], slot_s=30 * 86400)
    return rounded(out.drop(*METRICS))


@query("rolling_std", "F2", f"WITH {CLEANED} SELECT {KEYS}, ts, {select_rounded(rolling_sql(PRIMARY, (5, 15, 60), ['std']))} FROM cleaned")
def rolling_std(spark, sf_dir):
    out = features.row_features(cleaned(spark, sf_dir), SERIES, "ts", PRIMARY, rolling=(5, 15, 60), rolling_stats=["std"], slot_s=30 * 86400)
    return rounded(out.drop(*METRICS))


def _last_minutes(n):
    return f"OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {n * 60_000_000 - 1} PRECEDING AND CURRENT ROW)"


@query(
    "rolling_time",
    "F2b",
    "SELECT user_id, ts, event_id, "
    + ", ".join(
        f"{r(f'avg(value) {_last_minutes(n)}', f'value_mean_last_{n}min')}, "
        f"{r(f'coalesce(stddev_samp(value) {_last_minutes(n)}, 0)', f'value_std_last_{n}min')}"
        for n in (60, 720)
    )
    + " FROM events",
)
def rolling_time(spark, sf_dir):
    """Rolling statistics over true time on the irregular raw events of each user."""
    rows = read_table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    slot = slot_for(rows, ["user_id"], "ts")
    return rounded(features.rolling_time(rows, ["user_id"], "ts", ["value"], (60, 720), block_s=slot).drop("value"))


@query("rate_of_change", "F3", f"WITH {CLEANED} SELECT {KEYS}, ts, {select_rounded(difference_sql(PRIMARY))} FROM cleaned")
def rate_of_change(spark, sf_dir):
    out = features.row_features(cleaned(spark, sf_dir), SERIES, "ts", PRIMARY, difference=True, slot_s=30 * 86400)
    return rounded(out.drop(*METRICS))


@query("lags", "F4", f"WITH {CLEANED} SELECT {KEYS}, ts, {select_rounded(lag_sql(PRIMARY))} FROM cleaned")
def lags(spark, sf_dir):
    out = features.row_features(cleaned(spark, sf_dir), SERIES, "ts", PRIMARY, lags=(15, 60), slot_s=30 * 86400)
    return rounded(out.drop(*METRICS))


@query(
    "ema",
    "F5",
    f"WITH RECURSIVE {CLEANED}, {ema_ctes(PRIMARY)} SELECT {KEYS}, ts, {rs([f'{c}_ema_30' for c in PRIMARY])} FROM ema",
)
def ema(spark, sf_dir):
    """Exponential averages by block scan; blocks are short here so that carries are used."""
    out = features.row_features(cleaned(spark, sf_dir), SERIES, "ts", PRIMARY, ema_span=30, slot_s=5 * 86400, block_rows=50)
    return rounded(out.drop(*METRICS))


@query("calendar", "F6 F7 F8", f"WITH {FRAME} SELECT {KEYS}, ts, {select_rounded(CALENDAR_SQL)}, {WEEKEND_SQL} FROM frame")
def calendar(spark, sf_dir):
    return rounded(features.add_calendar(frame(spark, sf_dir).select(*SERIES, "ts"), "ts"))


ALL_FEATURES = rolling_sql(PRIMARY, (5, 15, 60)) + difference_sql(PRIMARY) + lag_sql(PRIMARY)
EMA_NAMES = [f"{c}_ema_30" for c in PRIMARY]
FEATURES = f"""{CLEANED}, {ema_ctes(PRIMARY)},
windowed AS (SELECT {KEYS}, ts, {', '.join(METRICS)}, {', '.join(f'{e} AS {n}' for e, n in ALL_FEATURES)},
  {', '.join(f'{e} AS {n}' for e, n in CALENDAR_SQL)}, {WEEKEND_SQL} FROM cleaned),
features AS (
  SELECT w.*, {', '.join(f'e.{n}' for n in EMA_NAMES)} FROM windowed w JOIN ema e USING ({KEYS}, ts)
  WHERE lag_cpu_usage_60m IS NOT NULL)"""
FEATURE_NAMES = METRICS + [n for _, n in ALL_FEATURES] + EMA_NAMES + [n for _, n in CALENDAR_SQL]


@query("engineer_features", "F10 B5 F1 F2 F3 F4 F5 F6 F7 F8", f"WITH RECURSIVE {FEATURES} SELECT {KEYS}, ts, {rs(FEATURE_NAMES)}, is_weekend FROM features")
def engineer_features(spark, sf_dir):
    return rounded(features.engineer(cleaned(spark, sf_dir), SERIES, "ts"))


@query(
    "features_with_missing_metric",
    "B4 F10",
    f"""WITH {FRAME}, sizes AS (SELECT {KEYS}, count(*) - 60 AS n FROM frame GROUP BY ALL)
    SELECT {KEYS}, n, n AS with_cpu, CASE WHEN namespace = 'prod' THEN n ELSE 0 END AS with_errors FROM sizes WHERE n > 0""",
)
def features_with_missing_metric(spark, sf_dir):
    """Staging reports no error rate: its other features survive, and every row with full history."""
    rows = frame(spark, sf_dir).withColumn("error_rate", F.when(F.col("namespace") == "prod", F.col("error_rate")))
    out = features.engineer(cleaning.clean(rows, SERIES, "ts"), SERIES, "ts")
    return out.groupBy(*SERIES).agg(F.count("*").alias("n"), F.count("cpu_usage_ema_30").alias("with_cpu"), F.count("error_rate_ema_30").alias("with_errors"))


LINE_ORDER = "PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber"


@query(
    "supplier_features",
    "F1 F2 F3 F4",
    f"""SELECT l_suppkey, l_orderkey, l_linenumber,
    {r(f'avg(l_quantity) OVER ({LINE_ORDER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)', 'l_quantity_rolling_mean_5m')},
    {r(f'coalesce(stddev_samp(l_quantity) OVER ({LINE_ORDER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0)', 'l_quantity_rolling_std_5m')},
    {r(f'avg(l_quantity) OVER ({LINE_ORDER} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)', 'l_quantity_rolling_mean_60m')},
    {r(f'coalesce(stddev_samp(l_quantity) OVER ({LINE_ORDER} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 0)', 'l_quantity_rolling_std_60m')},
    {r(f'coalesce(l_quantity - lag(l_quantity) OVER ({LINE_ORDER}), 0)', 'l_quantity_rate_of_change')},
    {r(f'lag(l_quantity, 60) OVER ({LINE_ORDER})', 'lag_l_quantity_60m')} FROM lineitem""",
)
def supplier_features(spark, sf_dir):
    """Volume run: features over every order line of each supplier, in shipping order."""
    rows = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    slot = slot_for(rows, ["l_suppkey"], "l_shipdate")
    out = features.row_features(
        rows,
        ["l_suppkey"],
        "l_shipdate",
        ["l_quantity"],
        order=["l_shipdate", "l_orderkey", "l_linenumber"],
        rolling=(5, 60),
        difference=True,
        lags=(60,),
        slot_s=slot,
        parts=parts_for(rows),
    )
    return rounded(out.drop("l_shipdate", "l_quantity"))


# -- scaling ----------------------------------------------------------------------------


def params_sql(method: str) -> str:
    parts = []
    for m in METRICS:
        if method == "minmax":
            scale = f"1.0::DOUBLE / CASE WHEN max({m}) > min({m}) THEN max({m}) - min({m}) ELSE 1.0 END"
            vals = f"min({m}) AS data_min, max({m}) AS data_max, {scale} AS scale, -min({m}) * ({scale}) AS min_, NULL::DOUBLE AS mean, NULL::DOUBLE AS var"
        else:
            scale = f"CASE WHEN max({m}) > min({m}) THEN stddev_pop({m}) ELSE 1.0::DOUBLE END"
            vals = f"NULL::DOUBLE AS data_min, NULL::DOUBLE AS data_max, {scale} AS scale, NULL::DOUBLE AS min_, avg({m}) AS mean, var_pop({m}) AS var"
        parts.append(f"SELECT {KEYS}, '{method}' AS method, '{m}' AS feature, {vals} FROM cleaned GROUP BY {KEYS}")
    return "params AS (" + " UNION ALL ".join(parts) + ")"


def scaled_sql(method: str) -> str:
    if method == "minmax":
        exprs = [(f"coalesce(({m} - min({m}) OVER k) / nullif(max({m}) OVER k - min({m}) OVER k, 0), {m} - min({m}) OVER k)", m) for m in METRICS]
    else:
        exprs = [(f"({m} - avg({m}) OVER k) / coalesce(nullif(stddev_pop({m}) OVER k, 0), 1)", m) for m in METRICS]
    return f"SELECT {KEYS}, ts, {select_rounded(exprs)} FROM cleaned WINDOW k AS (PARTITION BY {KEYS})"


P_COLS = ["data_min", "data_max", "scale", "min_", "mean", "var"]


@query("fit_minmax", "G1 G7", f"WITH {CLEANED}, {params_sql('minmax')} SELECT {KEYS}, method, feature, {rs(P_COLS)} FROM params")
def fit_minmax(spark, sf_dir):
    return rounded(normalize.fit(cleaned(spark, sf_dir), SERIES, METRICS, "minmax"))


@query("fit_standard", "G2 G7", f"WITH {CLEANED}, {params_sql('standard')} SELECT {KEYS}, method, feature, {rs(P_COLS)} FROM params")
def fit_standard(spark, sf_dir):
    return rounded(normalize.fit(cleaned(spark, sf_dir), SERIES, METRICS, "standard"))


@query("scale_minmax", "G3 G4", f"WITH {CLEANED} {scaled_sql('minmax')}")
def scale_minmax(spark, sf_dir):
    return rounded(normalize.fit_transform(cleaned(spark, sf_dir), SERIES, METRICS, "minmax")[0])


@query("scale_standard", "G3 G4", f"WITH {CLEANED} {scaled_sql('standard')}")
def scale_standard(spark, sf_dir):
    return rounded(normalize.fit_transform(cleaned(spark, sf_dir), SERIES, METRICS, "standard")[0])


@query(
    "scale_whole_table",
    "G1 G3",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(r(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())", c) for c in ("l_quantity", "l_discount"))
    + " FROM lineitem",
)
def scale_whole_table(spark, sf_dir):
    """One scaler for all order lines: a single row of parameters becomes literals."""
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rounded(normalize.fit_transform(rows, [], ["l_quantity", "l_discount"])[0])


@query("inverse_scale", "G5", f"WITH {CLEANED} SELECT {KEYS}, ts, {rs(METRICS)} FROM cleaned")
def inverse_scale(spark, sf_dir):
    """Scaling and back must give the cleaned frame again."""
    scaled, params = normalize.fit_transform(cleaned(spark, sf_dir), SERIES, METRICS, "standard")
    return rounded(normalize.inverse_transform(scaled, params, SERIES, METRICS))


@query(
    "inverse_scale_array",
    "G6",
    f"""WITH {CLEANED} SELECT {KEYS}, {r('min(cpu_usage)', 'at_zero')}, {r('max(cpu_usage)', 'at_one')},
    {r('(min(cpu_usage) + max(cpu_usage)) / 2', 'at_half')} FROM cleaned GROUP BY ALL""",
)
def inverse_scale_array(spark, sf_dir):
    rows = cleaned(spark, sf_dir)
    params = normalize.fit(rows, SERIES, METRICS)
    arrays = rows.groupBy(*SERIES).agg(F.max("ts").alias("ts")).withColumn("v", F.array(F.lit(0.0), F.lit(1.0), F.lit(0.5)))
    back = normalize.inverse_transform_array(arrays, params, SERIES, "v", "cpu_usage")
    return rounded(back.select(*SERIES, *[F.element_at("v", i + 1).alias(n) for i, n in enumerate(["at_zero", "at_one", "at_half"])]))


# -- sequences --------------------------------------------------------------------------

PAIR = ["cpu_usage", "memory_usage"]


@query(
    "training_windows",
    "H1",
    f"""WITH {CLEANED}, placed AS (SELECT {KEYS}, ts, cpu_usage::FLOAT AS c, memory_usage::FLOAT AS m,
      row_number() OVER ({BY}) AS pos, count(*) OVER (PARTITION BY {KEYS}) AS n FROM cleaned),
    framed AS (SELECT {KEYS}, ts, pos, n,
      first_value(c) OVER x AS x_first, last_value(m) OVER x AS x_last, sum(c::DOUBLE) OVER x AS x_sum,
      first_value(c) OVER y AS y_first, last_value(c) OVER y AS y_last, sum(c::DOUBLE) OVER y AS y_sum
      FROM placed WINDOW x AS ({BY} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), y AS ({BY} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))
    SELECT {KEYS}, ts, pos - 60 AS sample_id, {rs(['x_first', 'x_last', 'x_sum', 'y_first', 'y_last', 'y_sum'], 5)}
    FROM framed WHERE pos >= 60 AND pos <= n - 10""",
)
def training_windows(spark, sf_dir):
    """Sliding windows, reported by their corner values and sums."""
    w = sequences.training_windows(cleaned(spark, sf_dir), SERIES, "ts", PAIR, "cpu_usage", lookback=60, horizon=10)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double"))
    return rounded(
        w.select(
            *SERIES,
            "ts",
            "sample_id",
            F.element_at(F.element_at("x", 1), 1).cast("double").alias("x_first"),
            F.element_at(F.element_at("x", -1), 2).cast("double").alias("x_last"),
            total(F.transform("x", lambda v: v[0])).alias("x_sum"),
            F.element_at("y", 1).cast("double").alias("y_first"),
            F.element_at("y", -1).cast("double").alias("y_last"),
            total(F.col("y")).alias("y_sum"),
        ),
        5,
    )


@query(
    "inference_window",
    "H2",
    f"""WITH {CLEANED}, recent AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY ts DESC) AS back FROM cleaned),
    places AS (SELECT {KEYS}, ts AS last_ts, unnest(range(1, 501)) AS i FROM recent WHERE back = 1)
    SELECT p.namespace, p.deployment, p.last_ts AS ts, p.i, {r('coalesce(r.cpu_usage::FLOAT::DOUBLE, 0)', 'cpu_usage', 4)}
    FROM places p LEFT JOIN recent r ON r.namespace = p.namespace AND r.deployment = p.deployment AND r.back = 501 - p.i""",
)
def inference_window(spark, sf_dir):
    """The newest 500 rows of each series, more than any series has, so the left is padded."""
    w = sequences.inference_window(cleaned(spark, sf_dir), SERIES, "ts", ["cpu_usage"], lookback=500)
    rows = w.select(*SERIES, "ts", F.posexplode("x").alias("i", "v"))
    return rounded(rows.select(*SERIES, "ts", (F.col("i") + 1).cast("long").alias("i"), F.col("v")[0].cast("double").alias("cpu_usage")), 4)


@query(
    "chronological_split",
    "H3",
    f"""WITH {FRAME} SELECT {KEYS}, ts, row_number() OVER ({BY}) <= floor(count(*) OVER (PARTITION BY {KEYS}) * 0.8) AS is_train FROM frame""",
)
def chronological_split(spark, sf_dir):
    return sequences.chronological_split(frame(spark, sf_dir).select(*SERIES, "ts"), SERIES, "ts")


# -- the whole preparation --------------------------------------------------------------

SCALED = [*FEATURE_NAMES, "is_weekend"]


@query(
    "prepare_training_rows",
    "F10 G1 G3 H3",
    f"""WITH RECURSIVE {FEATURES},
    split AS (SELECT *, row_number() OVER ({BY}) <= floor(count(*) OVER (PARTITION BY {KEYS}) * 0.8) AS is_train FROM features),
    fitted AS (SELECT {KEYS}, {', '.join(f'min({n}) AS lo_{n}, max({n}) AS hi_{n}' for n in SCALED)} FROM split WHERE is_train GROUP BY {KEYS})
    SELECT {KEYS}, ts, {', '.join(r(f'({n} - lo_{n}) / CASE WHEN hi_{n} > lo_{n} THEN hi_{n} - lo_{n} ELSE 1 END', n, 5) for n in SCALED)}
    FROM split JOIN fitted USING ({KEYS})""",
)
def prepare_training_rows(spark, sf_dir):
    """Clean, derive all features and scale them by the training part of each series."""
    return rounded(flows.prepare(frame(spark, sf_dir), SERIES, "ts").rows, 5)

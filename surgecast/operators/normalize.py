"""Min-max and standard scaling with parameters kept as a table, one row per feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import join_series

METHODS = ("minmax", "standard")


def fit(df: DataFrame, keys: Sequence[str], features: Sequence[str], method: str = "minmax") -> DataFrame:
    """Parameters per series and feature from one aggregation pass.

    ``minmax``: scale is 1/(max-min); ``standard``: scale is the population deviation. A
    constant feature divides by 1.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    keys = list(keys)
    aggs = []
    for c in features:
        lo, hi = F.min(c).cast("double"), F.max(c).cast("double")
        mean, var = F.avg(c), F.var_pop(F.col(c).cast("double"))
        if method == "minmax":
            scale = F.lit(1.0) / F.when(hi > lo, hi - lo).otherwise(1.0)
            fields = [lo.alias("data_min"), hi.alias("data_max"), scale.alias("scale"), (-lo * scale).alias("min_")]
            fields += [F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("var")]
        else:
            scale = F.when(hi > lo, F.sqrt(var)).otherwise(1.0)
            none = F.lit(None).cast("double")
            fields = [none.alias("data_min"), none.alias("data_max"), scale.alias("scale"), none.alias("min_")]
            fields += [mean.alias("mean"), var.alias("var")]
        aggs.append(F.struct(F.lit(method).alias("method"), F.lit(c).alias("feature"), *fields).alias(f"_p_{c}"))
    wide = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    return wide.select(*keys, F.explode(F.array(*[f"_p_{c}" for c in features])).alias("p")).select(*keys, "p.*")


def _wide(params: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    entry = F.struct("method", "scale", "min_", "mean")
    picks = [F.first(F.when(F.col("feature") == c, entry), ignorenulls=True).alias(f"_p_{c}") for c in features]
    return params.groupBy(*keys).agg(*picks)


def _attach(df: DataFrame, params: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    if params is None:
        raise RuntimeError("the scaler has not been fitted")
    wide = _wide(params, keys, features)
    if keys:
        return join_series(df, wide, keys)
    # One scaler for the whole table: a single row, read once and used as literals.
    row = wide.first()
    out = df
    for c in features:
        p = row[f"_p_{c}"]
        fields = [F.lit(p[n]).cast("string" if n == "method" else "double").alias(n) for n in ("method", "scale", "min_", "mean")]
        out = out.withColumn(f"_p_{c}", F.struct(*fields))
    return out


def _scaled(value: Column, p: Column) -> Column:
    return F.when(p["method"] == "minmax", value * p["scale"] + p["min_"]).otherwise((value - p["mean"]) / p["scale"])


def _unscaled(value: Column, p: Column) -> Column:
    return F.when(p["method"] == "minmax", (value - p["min_"]) / p["scale"]).otherwise(value * p["scale"] + p["mean"])


def transform(df: DataFrame, params: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Scale the features with fitted parameters; values outside the fitted range are not clipped.

    Rows of a series without parameters stay, with NULL for the scaled features.
    """
    rows = _attach(df, params, keys, features)
    return rows.select(*[_scaled(F.col(c), F.col(f"_p_{c}")).alias(c) if c in features else F.col(c) for c in df.columns])


def fit_transform(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], method: str = "minmax"
) -> tuple[DataFrame, DataFrame]:
    params = fit(df, keys, features, method)
    return transform(df, params, keys, features), params


def inverse_transform(df: DataFrame, params: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    rows = _attach(df, params, keys, features)
    return rows.select(*[_unscaled(F.col(c), F.col(f"_p_{c}")).alias(c) if c in features else F.col(c) for c in df.columns])


def inverse_transform_array(
    df: DataFrame, params: DataFrame, keys: Sequence[str], values: str, feature: str
) -> DataFrame:
    """Bring an array column of scaled values of one feature back to its units."""
    if params.filter(F.col("feature") == feature).isEmpty():
        raise ValueError(f"Unknown column: {feature}")
    rows = _attach(df, params, keys, [feature])
    p = F.col(f"_p_{feature}")
    back = F.transform(values, lambda v: _unscaled(v, p)).alias(values)
    return rows.select(*[back if c == values else F.col(c) for c in df.columns])

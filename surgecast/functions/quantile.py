"""Histogram quantiles as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket_counts(value: Column, bounds: Sequence[float], prefix: str = "_le") -> list[Column]:
    """Aggregates that count values at or below each bound, and all values."""
    cols = [
        F.sum(F.when(value <= b, 1).otherwise(0)).cast("double").alias(f"{prefix}{i}")
        for i, b in enumerate(bounds)
    ]
    return [*cols, F.count(value).cast("double").alias(f"{prefix}{len(bounds)}")]


def quantile_from_counts(q: float, bounds: Sequence[float], prefix: str = "_le") -> Column:
    """The quantile read from the columns :func:`bucket_counts` made.

    The bounds are known, so this is a plain chain of conditions that compiles to code; see
    :func:`histogram_quantile` for the definition.
    """
    total = F.col(f"{prefix}{len(bounds)}")
    rank = total * F.lit(float(q))
    value, lower, below = None, F.lit(0.0), F.lit(0.0)
    for i, bound in enumerate(bounds):
        cum = F.col(f"{prefix}{i}")
        inside = lower + (F.lit(float(bound)) - lower) * F.try_divide(rank - below, cum - below)
        value = (F if value is None else value).when(cum >= rank, inside)
        lower, below = F.lit(float(bound)), cum
    return F.when(total > 0, value.otherwise(lower))


def histogram_quantile(q: float, buckets: Column) -> Column:
    """Quantile of a cumulative histogram.

    ``buckets`` is an array of ``struct(le, cum)`` sorted by bound with the overflow bucket
    (``le`` NULL) last. The rank is interpolated linearly inside its bucket, whose lower
    edge is 0 for the first one; in the overflow bucket the highest finite bound is
    returned; an empty histogram gives NULL.
    """
    total = F.element_at(buckets, -1)["cum"]
    rank = total * F.lit(float(q))
    start = F.struct(
        F.lit(0.0).alias("le"), F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("hit")
    )

    def step(acc: Column, b: Column) -> Column:
        inside = acc["le"] + (b["le"] - acc["le"]) * F.try_divide(rank - acc["cum"], b["cum"] - acc["cum"])
        hit = F.when(b["le"].isNull(), acc["le"]).otherwise(F.coalesce(inside, b["le"]))
        return F.struct(
            F.coalesce(b["le"], acc["le"]).alias("le"),
            b["cum"].alias("cum"),
            F.when(acc["hit"].isNotNull(), acc["hit"])
            .when(b["cum"] >= rank, hit)
            .alias("hit"),
        )

    found = F.aggregate(buckets, start, step, lambda acc: acc["hit"])
    return F.when(total > 0, found)


#: Size parameter of a sketch; a rank read from it is off by less than ``RANK_ERROR`` of all values, nearly always.
SKETCH_K = 400
RANK_ERROR = 0.01


def quantile_sketch(value: Column, k: int = SKETCH_K) -> Column:
    """Aggregate: a mergeable summary of raw values, of a size that hardly grows with their number."""
    return F.kll_sketch_agg_double(value.cast("double"), k)


def merged_sketch(sketch: Column, k: int = SKETCH_K) -> Column:
    """Aggregate: the summary of all values that the given summaries stand for."""
    return F.kll_merge_agg_double(sketch, k)


def sketched_quantile(sketch: Column, q: float) -> Column:
    """The quantile that a summary tells; one of its values."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(q)))

"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _lowest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down)
    moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that occurs in ``links`` (src, dst); root is the smallest node reachable.

    Each round hangs nodes below smaller ones in two joins and is written to the shared
    folder. Nothing but a row count and a checksum reaches the driver. Minima are combined
    before the shuffle and the joins are plain equi-joins, so a star with very many leaves
    is split by Spark. Rows with a NULL end are no links.
    """
    at = materialise(links.select(F.col("src").alias("u"), F.col("dst").alias("v")).filter("u <> v").distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        at = materialise(_small_star(_large_star(at)), "links")
        now = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            roots = at.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
        seen = now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")

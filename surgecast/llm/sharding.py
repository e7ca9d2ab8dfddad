"""Shuffled shards of a corpus by an external shuffle in two passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, small_table

SHARDS = 40
SEED = 1_301
#: Cells that rows are counted in before buckets are known; their counts are all the driver sees.
CELLS = 1 << 18
#: Bytes of rows that one task holds while it shuffles them.
BUCKET_BYTES = 32 << 20
#: Repeats of one row that are written out in one go.
REPEATS = 1_000
#: What a row weighs besides its text.
ROW_BYTES = 16

RESULT = ("shard", "slot")


def size():
    """UTF-8 bytes of the text and ``ROW_BYTES``; a null text has none."""
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES


def _fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform order of ``n`` items; a number of 64 random bits picks each partner."""
    order = list(range(n))
    draws = np.random.PCG64(seed).random_raw(n).tolist()
    for i in range(n - 1, 0, -1):
        j = draws[i] * (i + 1) >> 64
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _shuffle_buckets(seed: int, starts: np.ndarray, shards: int):
    """Shuffle every bucket in memory and number its rows from the bucket's first place."""
    total = int(starts[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        del held
        buckets = rows.column("bucket").to_numpy()
        # Rows arrive in any order; by their hashes they start from the same one each time.
        by = np.lexsort((rows.column("key2").to_numpy(), rows.column("key").to_numpy(), buckets))
        cuts = np.flatnonzero(np.diff(buckets[by], prepend=-1, append=-1))
        only = rows.select(["row"])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            bucket = int(buckets[by[a]])
            if b - a != starts[bucket + 1] - starts[bucket]:
                raise RuntimeError("the input gave other rows when it was read again")
            order = by[a:b][_fisher_yates(b - a, [seed, bucket])]
            at = starts[bucket] + np.arange(b - a)
            shard = ((at + 1) * shards - 1) // total
            slot = at - shard * total // shards
            for i in range(0, b - a, 2_000):
                part = only.take(pa.array(order[i : i + 2_000])).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shard[i : i + 2_000], pa.int32()), pa.array(slot[i : i + 2_000])], names=["row", "shard", "slot"])

    return run


def shuffled_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of ``docs`` in a random order, cut into shards whose row counts differ by one at most.

    Adds shard (from 0) and slot (from 0 in each shard, without gaps). The first pass
    scatters rows by a seeded hash of all their columns into buckets of about
    ``bucket_bytes``, one to a task; the second shuffles each bucket there by Fisher and
    Yates. Buckets follow each other in one sequence, and shards are equal stretches of it,
    known from the bucket counts before anything is shuffled.

    Rows with equal texts are scattered apart by their other columns. Rows equal in all
    columns share a hash: cells that hold more of them than a bucket should are folded to
    one row with a count, which is dealt again by (hash, number), so a row repeated any
    number of times spreads evenly. The order depends on the seed and the rows, not on
    files or partitions. Null texts and ids are values like any other; an empty table gives
    no rows. Columns of maps take no part in the hash. A column that is named like a result
    is left out. A single text above ``bucket_bytes`` still has to fit a task.
    """
    spark = docs.sparkSession
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULT]
    key = F.xxhash64(F.lit(seed), *hashed)
    rows = docs.select(F.struct(*kept).alias("row"), size().alias("bytes"), key.alias("key"), F.xxhash64(*hashed, F.lit(seed)).alias("key2"))
    rows = rows.withColumn("cell", F.pmod("key", F.lit(CELLS)))
    names = ["row", "key", "key2", "cell"]

    # At most CELLS rows, whatever the size of the input.
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).toArrow()
    cell, n, weight = (cells.column(c).to_numpy() for c in ("cell", "n", "bytes"))
    buckets = max(1, -(-int(weight.sum()) // bucket_bytes))
    bucket_of = cell * buckets // CELLS
    hot = (n > 1) & (weight > bucket_bytes // 4)
    counts = np.bincount(bucket_of[~hot], n[~hot], buckets).astype(np.int64)
    dealt = rows.select(*names)
    if hot.any():
        ids = small_table(spark, {"cell": cell[hot].tolist()}, {"cell": pa.int64()})
        folded = materialise(rows.join(F.broadcast(ids), "cell", "left_semi").groupBy("row", "key", "key2").count(), "repeated")
        tasks = 1 + int(weight[hot].sum()) // bucket_bytes
        runs = folded.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / REPEATS)))).repartition(tasks, "key", "run")
        number = F.explode(F.sequence(F.col("run") * REPEATS, F.least(F.col("count"), (F.col("run") + 1) * REPEATS) - 1))
        again = runs.withColumn("number", number).withColumn("key", F.xxhash64(F.lit(seed), "key", "number")).withColumn("cell", F.pmod("key", F.lit(CELLS))).select(*names)
        spread = again.groupBy(F.floor(F.col("cell") * buckets / CELLS).alias("bucket")).count().toArrow()
        counts += np.bincount(spread.column("bucket").to_numpy(), spread.column("count").to_numpy(), buckets).astype(np.int64)
        dealt = dealt.join(F.broadcast(ids), "cell", "left_anti").select(*names).unionAll(again)
    starts = np.concatenate([[0], np.cumsum(counts)])

    placed = dealt.withColumn("bucket", F.expr(f"int(cell * {buckets} div {CELLS})")).drop("cell").repartitionById(buckets, "bucket")
    result = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return placed.mapInArrow(_shuffle_buckets(seed, starts, shards), result).select("row.*", "shard", "slot")


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the shuffled shards as ``folder/shard=k``, rows of a file in slot order, and return them read again."""
    found = shuffled_shards(docs, shards, seed, bucket_bytes)
    found.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.schema(found.schema).parquet(folder)

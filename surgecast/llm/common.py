"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import importable, materialise, scratch_dir  # noqa: F401  re-exported for the operators

#: Words are runs of anything but ASCII white space; ``bytes.split()`` finds the same runs.
WORD_GAP = "[ \\t-\\r]+"
#: Texts that one batch hands to Python; words cut from them take about ten times that.
BATCH_BYTES = 1 << 20
#: Bits of a sieve for each key, and of the whole at most, 8 MB; its parts are as long as Spark's bitmaps.
SIEVE_BITS, SIEVE_MOST, SIEVE_PART = 32, 1 << 26, 1 << 15


def prepare(spark: SparkSession) -> SparkSession:
    """Settings of one session that these operators rely on.

    A batch of whole texts handed to Python is bounded by bytes, not only by rows, and
    shuffle files go when the job that wrote them ends. Parquet's parallel reads are off, as
    each of their threads keeps a buffer outside the heap as large as the largest column
    chunk that it has read.
    """
    importable(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, with memory that Arrow no longer needs given back when a task ends.

    Workers wait for the next task, a minute at most, beside stages that need none, and would hold on to it.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return task


def id_key(docs: DataFrame, name: str = "doc_id") -> Column:
    """A long that stands for an id in keys: whole numbers as they are, other types by hash, NULL as the smallest long."""
    whole = isinstance(docs.schema[name].dataType, T.IntegralType)
    return F.when(F.col(name).isNull(), F.lit(-(2**63))).otherwise(F.col(name).cast("long") if whole else F.xxhash64(name))


def small_table(spark: SparkSession, columns: dict[str, list], types: dict[str, pa.DataType]) -> DataFrame:
    """A bounded driver-side list as a DataFrame that Spark knows the size of."""
    return spark.createDataFrame(pa.table({k: pa.array(v, types[k]) for k, v in columns.items()}))


def blocks_of(counts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Slices [a, b) of consecutive items whose counts add up to about ``limit`` at most."""
    start, total = 0, 0
    for i, c in enumerate(counts.tolist()):
        if total and total + c > limit:
            yield start, i
            start, total = i, 0
        total += c
    if start < len(counts):
        yield start, len(counts)


def split_hot(rows: DataFrame, keys: list[str], chunk: int, by: str) -> DataFrame:
    """Deal the rows of every key into cells ``(a, b)`` so that each pair of rows meets in one.

    A key with at most ``chunk`` rows has the one cell (0, 0). A larger one is cut into
    ``n`` parts by the hash of ``by``; part ``i`` goes to the cells (i, j) and (j, i),
    so a cell holds about two parts whatever the size of the key. ``side`` is true for
    rows of the first part. Only keys with more than ``chunk`` rows are counted out, and
    there are at most rows / chunk of those.
    """
    hot = rows.groupBy(*keys).count().filter(F.col("count") > chunk).select(*keys, F.ceil(F.col("count") / F.lit(chunk)).cast("int").alias("_n"))
    part = F.pmod(F.xxhash64(by), F.col("_n")).cast("int")
    joined = rows.join(hot, keys, "left").withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("_p", part)
    cells = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda j: F.struct(F.least("_p", j).alias("a"), F.greatest("_p", j).alias("b")))
    one = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    return joined.withColumn("_c", F.explode(F.when(F.col("_n") == 1, one).otherwise(cells))).select(*rows.columns, F.col("_c.a").alias("a"), F.col("_c.b").alias("b"), (F.col("_p") == F.col("_c.a")).alias("side"))


def sifted(rows: DataFrame, by: Column, keys: DataFrame, key: Column, count: int) -> tuple[DataFrame, DataFrame]:
    """The rows that may meet one of ``count`` keys, and those that surely meet none.

    ``by`` and ``key`` are long hashes that are equal where a row and a key meet. A bitmap of
    the keys' hashes tells the rows apart where they lie, so that a join need only move the
    former. It is bounded: more keys than it is made for only let more rows through.
    """
    size = min(SIEVE_MOST, max(SIEVE_PART, 1 << (SIEVE_BITS * max(1, count) - 1).bit_length()))
    part = lambda h: F.floor(F.pmod(h, F.lit(size)) / SIEVE_PART)
    bit = lambda h: F.pmod(h, F.lit(SIEVE_PART))
    # One row for 32,768 bits that are not all zero, 2,048 rows at most.
    bits = keys.select(part(key).alias("_part"), bit(key).alias("_bit")).repartition("_part").groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit(by) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (bit(by) % 8).cast("int")) == 1, F.lit(False))
    marked = rows.join(F.broadcast(bits), part(by) == F.col("_part"), "left")
    return marked.filter(found).select(*rows.columns), marked.filter(~found).select(*rows.columns)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], at_least: int = 50_000) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no run of equal keys is cut; about ``at_least`` rows each."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def last_start(t: pa.Table) -> int:
        n, start = t.num_rows, 0
        for k in keys:
            v = t.column(k).to_numpy(zero_copy_only=False)
            diff = np.flatnonzero(v[1:] != v[:-1])
            start = max(start, int(diff[-1]) + 1 if len(diff) else 0)
        return start if n else 0

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= at_least:
            t = pa.Table.from_batches(held).combine_chunks()
            cut = last_start(t)
            if cut:
                yield t.slice(0, cut)
                rest = t.slice(cut).combine_chunks()
                held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            break
        root = new
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root

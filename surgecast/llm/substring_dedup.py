"""Removal of repeated word windows by a compacted de Bruijn graph over words.

An edge of the graph is a window of ``k`` words. Edges are never shuffled one by one at
first: every run of consecutive windows of a document that share their minimizer (the
smallest hash of the ``m``-word runs inside a window) is one path. Equal windows have equal
minimizers, so a window that occurs twice meets its copies among the paths of its
minimizer, and all other paths drop out by counting. Equal paths are compacted to one by a
join; where several different paths run through one minimizer, their first copies are
taken apart into edges. What is removed is told by source coordinates (document, window
start), and the final pass checks them against the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_key, materialise
from .words import mix, rolled, sliding_min, word_hashes

K = 20
M = 6
#: Windows of one path; two windows of a path this long still cover all of it.
PATH = 20


def _windows(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word position, row, start in its document) of every window of k words."""
    n = np.maximum(counts - (k - 1), 0)
    row = np.repeat(np.arange(len(counts)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return start + np.repeat(np.cumsum(counts) - counts, n), row, start


def _paths(k: int, m: int):
    """minimizer, path hash, source and (start, windows, whether a window recurs inside) packed in one long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            for lo, _, counts, (h,) in word_hashes(batch.column("text")):
                at, row, start = _windows(counts, k)
                if not len(at):
                    continue
                edge = rolled(h, k)[at]
                low = sliding_min(rolled(h, m), k - m + 1)[at]
                new = np.ones(len(at), bool)
                new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(new)
                place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                new |= place % PATH == 0
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(at)))
                path = np.cumsum(new) - 1
                again = np.zeros(len(first), bool)
                for p in range(1, min(PATH, len(at))):
                    same = np.flatnonzero(edge[p:] == edge[:-p])
                    again[path[same[path[same] == path[same + p]]]] = True
                span = mix(edge[first] + mix(edge[first + n - 1] + n.astype(np.uint64)))
                packed = start[first] << 8 | n << 1 | again
                r = row[first] + lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low[first].view(np.int64)), pa.array(span.view(np.int64)), pa.array(doc[r]), pa.array(tie[r]), pa.array(packed)],
                    names=["low", "span", "doc", "tie", "packed"],
                )

    return run


def _edges(k: int):
    """Two independent hashes and the source of every window inside the given paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            wanted = batch.column("wanted")
            for lo, hi, counts, (h1, h2) in word_hashes(batch.column("text"), (1, 2)):
                e1, e2 = rolled(h1, k, 1), rolled(h2, k, 2)
                before = np.cumsum(counts) - counts
                part = wanted.slice(lo, hi - lo)
                packed = part.flatten().to_numpy()
                row = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())
                n = packed >> 1 & 127
                start = np.repeat(packed >> 8, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(row, n)
                at = before[row] + start
                r = row + lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array(e1[at].view(np.int64)), pa.array(e2[at].view(np.int64)), pa.array(doc[r]), pa.array(tie[r]), pa.array(start)],
                    names=["e1", "e2", "doc", "tie", "start"],
                )

    return run


def _kept(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept_text = [], [], []
            for text, packed in zip(batch.column("text").to_pylist(), batch.column("removed")):
                words = text.encode().split()
                gone = 0
                if packed.is_valid and words:
                    p = packed.values.to_numpy()
                    start, n = p >> 8, p >> 1 & 127
                    end = start + n + k - 1
                    if end.max() > len(words):
                        raise AssertionError("a removed window lies outside its document")
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, start, 1)
                    np.add.at(depth, end, -1)
                    out = np.cumsum(depth[:-1]) > 0
                    gone = int(out.sum())
                    kept = b" ".join([words[i] for i in np.flatnonzero(~out).tolist()])
                else:
                    kept = b" ".join(words)
                n_words.append(len(words))
                n_removed.append(gone)
                kept_text.append(kept.decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text)], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def removed_windows(rows: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """(doc, tie, packed) of windows whose words also start earlier, as paths of one or more windows.

    ``rows`` has doc and tie (longs that order and tell apart documents) and text.
    """
    schema = "low long, span long, doc long, tie long, packed long"
    paths = rows.mapInArrow(_paths(k, m), schema)
    odd = F.col("packed").bitwiseAND(F.lit(1)) == 1
    # Minimizers that occur once, outside a path that repeats itself, hold nothing repeated.
    again = materialise(paths.groupBy("low").agg(F.count("*").alias("n"), F.max(odd).alias("odd")).filter("n > 1 or odd").select("low"), "again")
    cand = materialise(paths.join(again, "low"), "paths")
    source = F.struct("doc", "tie", "packed")
    spans = materialise(cand.groupBy("low", "span").agg(F.count("*").alias("n"), F.min(source).alias("first"), F.max(odd).alias("odd")), "spans")
    # Compaction: all copies of a path but the first are removed whole.
    copies = cand.join(spans.filter("n > 1").select("low", "span", "first"), ["low", "span"]).filter(source != F.col("first")).select("doc", "tie", "packed")
    # Branching: several paths through one minimizer, or one that meets itself.
    branching = spans.groupBy("low").agg(F.count("*").alias("n"), F.max("odd").alias("odd")).filter("n > 1 or odd").select("low")
    apart = materialise(spans.join(branching, "low").select("first.*"), "apart")
    wanted = apart.groupBy("doc", "tie").agg(F.collect_list("packed").alias("wanted"))
    edges = materialise(rows.join(wanted, ["doc", "tie"]).mapInArrow(_edges(k), "e1 long, e2 long, doc long, tie long, start long").distinct(), "edges")
    at = F.struct("doc", "tie", "start")
    first = edges.groupBy("e1", "e2").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1").select("e1", "e2", "first")
    later = edges.join(first, ["e1", "e2"]).filter(at != F.col("first")).select("doc", "tie", F.shiftleft("start", 8).bitwiseOR(F.lit(2)).alias("packed"))
    return copies.unionAll(later)


def dedup_windows(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words of every row of ``docs`` (doc_id, text).

    A word goes if a window of ``k`` words over it starts earlier too: in a smaller doc_id,
    or before it in the same document. Null texts have no words, and a document of fewer
    than ``k`` words has no window. Rows with one id and different texts are ordered by a
    hash of their texts; rows equal in both are one document and do not judge each other. A
    null id comes before all others. Ids may be of any type that has an order. Other columns
    are ignored.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        rows = texts.withColumn("doc", id_key(docs))
    else:
        # Other ids are numbered in their own order, nulls first.
        order = docs.select(F.col("doc_id").alias("_id")).distinct().orderBy("_id").withColumn("doc", F.monotonically_increasing_id())
        rows = texts.join(materialise(order, "order"), F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    unique = not rows.groupBy("doc").count().filter("count > 1").limit(1).count()
    rows = rows.withColumn("tie", F.lit(0).cast("long") if unique else F.xxhash64("text"))
    removed = materialise(removed_windows(rows.select("doc", "tie", "text"), k, m), "removed").groupBy("doc", "tie").agg(F.collect_list("packed").alias("removed"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = rows.join(removed, ["doc", "tie"], "left").select("doc_id", "text", "removed")
    return joined.mapInArrow(_kept(k), f"doc_id {kind}, n_words long, n_removed long, kept string")

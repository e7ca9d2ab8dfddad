"""SimHash fingerprints and their near-duplicate groups by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, local_components, materialise, sorted_groups, split_hot
from .components import components

SEED = 42
RADIUS = 4
#: Fingerprints of one bucket that meet in one cell, at most twice this many.
CHUNK = 1024
#: (query, block) pairs compared in one go.
SLICE = 1 << 17


def _set_bits(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit number."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 15):
        part = hashes[i : i + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprint(text: str, words: int = 4, seed: int = SEED) -> int:
    """SimHash of the word shingles of ``text``: A-Z in lower case, joined by one space.

    A text with fewer words than a shingle is one shingle; one without words gets zero.
    """
    found = text.encode().lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], seed) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist())]
    return _set_bits(np.array(hashes, dtype="<u8"))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, tag (a hash of the text), fp (64 bits as a long) of every row; nulls count as empty texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t or "", words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(fp, pa.int64())], names=["doc_id", "tag", "fp"])

    return docs.select("doc_id", _tag().alias("tag"), "text").mapInArrow(lean(run), f"doc_id {kind}, tag long, fp long")


def _tag():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def block_keys(fp: str, radius: int, kept: int = 2):
    """Bucket keys that two fingerprints within ``radius`` bits share at least once.

    The 64 bits are cut into radius + kept blocks. At most ``radius`` of them differ, so
    ``kept`` blocks are equal: every choice of that many blocks is a table, and its number
    and the bits of its blocks are the key.
    """
    edges = [round(i * 64 / (radius + kept)) for i in range(radius + kept + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(radius + kept), kept)):
        key = F.lit(t).cast("long")
        for c in chosen:
            width = edges[c + 1] - edges[c]
            bits = F.shiftrightunsigned(F.col(fp), edges[c]).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key, width).bitwiseOR(bits)
        keys.append(key)
    return F.array(*keys)


def _beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is above ``radius``."""
    more, same = np.zeros_like(over), ~np.zeros_like(over)
    for j in reversed(range(len(counters))):
        if radius >> j & 1:
            same = same & counters[j]
        else:
            more = more | (same & counters[j])
            same = same & ~counters[j]
    return over | more


def _near(planes: np.ndarray, fps: np.ndarray, query: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, block, lanes) where some lane of the block is within ``radius`` of the query.

    ``planes[b, p]`` holds bit p of the 64 fingerprints of block b. Two planes at a time are
    compared with the query's bits and added to vertical counters by a carry-save adder;
    every eighth plane, pairs whose lanes are all beyond the radius are given up.
    """
    counters = [np.zeros(len(query), np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(query), np.uint64)
    for p in range(0, 64, 2):
        d = [planes[block, q] ^ (np.uint64(0) - (fps[query] >> np.uint64(q) & np.uint64(1))) for q in (p, p + 1)]
        low = counters[0]
        half = low ^ d[0]
        carry = (low & d[0]) | (half & d[1])
        counters[0] = half ^ d[1]
        for j in range(1, len(counters)):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        over |= carry
        if p % 8 == 6:
            alive = np.flatnonzero(~_beyond(counters, over, radius))
            if len(alive) < len(query):
                query, block, over = query[alive], block[alive], over[alive]
                counters = [c[alive] for c in counters]
    return query, block, ~_beyond(counters, over, radius)


def _pairs_within(fps: np.ndarray, group: np.ndarray, side: np.ndarray, square: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) within ``radius`` of each other in one group.

    ``group`` is sorted. In a square group every row meets every other; in others rows of
    the first side meet those of the second.
    """
    targets = np.flatnonzero(square | ~side)
    queries = np.flatnonzero(square | side)
    if not len(targets) or not len(queries):
        return
    tg = group[targets]
    new = np.concatenate([[True], tg[1:] != tg[:-1]])
    starts = np.flatnonzero(new)
    place = np.arange(len(tg)) - np.repeat(starts, np.diff(np.append(starts, len(tg))))
    block_new = place % 64 == 0
    block = np.cumsum(block_new) - 1
    lane = (place % 64).astype(np.uint64)
    first = np.flatnonzero(block_new)
    planes = np.empty((len(first), 64), np.uint64)
    valid = np.bitwise_or.reduceat(np.uint64(1) << lane, first)
    for p in range(64):
        planes[:, p] = np.bitwise_or.reduceat((fps[targets] >> np.uint64(p) & np.uint64(1)) << lane, first)
    lo = np.searchsorted(tg, group[queries], "left")
    hi = np.searchsorted(tg, group[queries], "right")
    some = lo < hi
    queries, lo, hi = queries[some], lo[some], hi[some]
    if not len(queries):
        return
    b_lo, n = block[lo], block[hi - 1] - block[lo] + 1
    edges = np.concatenate([[0], np.cumsum(n)])
    at = 0
    while at < len(queries):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + SLICE, "right")) - 1)
        q = np.repeat(queries[at:to], n[at:to])
        b = np.arange(edges[at], edges[to]) - np.repeat(edges[at:to] - b_lo[at:to], n[at:to])
        q, b, lanes = _near(planes, fps, q, b, radius)
        lanes = lanes & valid[b]
        for w in range(0, len(q), 1 << 16):
            bits = np.unpackbits(lanes[w : w + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, c = np.nonzero(bits)
            i, j = q[w + r], targets[first[b[w + r]] + c]
            keep = fps[i] != fps[j]
            yield i[keep], j[keep]
        at = to


def _links(radius: int):
    """Links of the components within each run of whole cells: (fingerprint, smallest of its component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["key", "a", "b"]):
            key, a, b, side = (t.column(c).to_numpy(zero_copy_only=False) for c in ("key", "a", "b", "side"))
            fps = t.column("fp").to_numpy().view(np.uint64)
            change = np.concatenate([[True], (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            nodes, at = np.unique(fps, return_inverse=True)
            root = np.arange(len(nodes))
            for i, j in _pairs_within(fps, np.cumsum(change), side, a == b, radius):
                if len(i):
                    i, j = root[at[i]], root[at[j]]
                    root = local_components(i, j, len(nodes))[root]
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved].view(np.int64)), pa.array(nodes[root[moved]].view(np.int64))], names=["src", "dst"])

    return run


def near_links(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(src, dst) that connect the distinct fingerprints ``fp`` exactly as all links within ``radius`` do.

    Buckets come from ``block_keys``, so no link is missed. A bucket of more than ``chunk``
    fingerprints is compared in cells of two parts. A cell gives at most one link for each
    of its fingerprints, whatever the number of near pairs.
    """
    rows = distinct.select("fp", F.explode(block_keys("fp", radius)).alias("key"))
    cells = split_hot(rows, ["key"], chunk, "fp")
    dealt = cells.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return dealt.mapInArrow(lean(_links(radius)), "src long, dst long").distinct()


def near_duplicate_groups(docs: DataFrame, words: int = 4, radius: int = RADIUS) -> DataFrame:
    """doc_id, tag, fp, component_id (smallest doc_id reachable over links) and root of every row.

    Fingerprints link at ``radius`` or fewer differing bits. Equal fingerprints are one node,
    so copies are never paired. Texts that are null, empty or without words share the
    fingerprint zero. Repeated rows keep one row each; a group of null ids only has a null
    component; columns other than doc_id and text are ignored.
    """
    fps = materialise(fingerprints(docs, words), "fps")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = materialise(components(near_links(nodes.select("fp"), radius)), "roots")
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = rooted.join(lowest, "root").select("fp", "root", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "tag", "fp", "component_id", "root")


def representatives(docs: DataFrame, words: int = 4, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each group: the one with the smallest id, null ids last, then the smallest text hash.

    Of rows that agree in id and text one stays.
    """
    groups = near_duplicate_groups(docs, words, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "tag")).alias("first")
    chosen = materialise(groups.groupBy("root").agg(first), "chosen").select(F.col("first.doc_id").alias("_id"), F.col("first.tag").alias("_tag"))
    keyed = docs.withColumn("_tag", _tag())
    kept = keyed.join(chosen, keyed["doc_id"].eqNullSafe(chosen["_id"]) & (keyed["_tag"] == chosen["_tag"]), "left_semi")
    if groups.groupBy("doc_id", "tag").count().filter("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "_tag"])
    return kept.select(*docs.columns)

"""Near-duplicate vectors by iterative quantisation, multi-index tables and exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_components, materialise, sorted_groups, split_hot
from .components import components

COSINE = 0.93
#: Vectors that the rotation is learnt from, at most.
SAMPLE = 20_000
#: Vectors of one bucket that meet in one cell, at most twice this many.
CHUNK = 512
#: Wanted size of a bucket, and share of the pairs at the threshold that some table must hold.
BUCKET, RECALL = 16, 0.97
#: Pairs that recall is measured on, sample rows that one rotation is learnt from, and most rotations.
PROBES, LEARNT, MOST = 1_000, 5_000, 32


def learn_rotation(x: np.ndarray, rng: np.random.Generator, rounds: int = 40) -> np.ndarray:
    """Orthogonal directions whose signs are balanced binary codes of the centred rows ``x``.

    Principal directions first, then the rotation that brings the data nearest to the
    corners of a cube, found by turns of rounding and Procrustes alignment.
    """
    d = x.shape[1]
    _, axes = np.linalg.eigh(x.T @ x / max(len(x), 1) + 1e-9 * np.eye(d))
    v = x @ axes
    r, _ = np.linalg.qr(rng.normal(size=(d, d)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes @ r


def key_bits(largest: int, dim: int) -> int:
    """Signs of a table's key that keep its buckets small in groups of up to ``largest`` vectors."""
    wanted = math.ceil(math.log2(largest / BUCKET)) if largest > BUCKET else 8
    return min(dim, max(8, min(18, wanted)))


def plan_tables(x: np.ndarray, centre: np.ndarray, bits: int, cosine: float, rng: np.random.Generator) -> tuple[int, list[np.ndarray], float]:
    """(bits, rotations, measured recall) whose tables hold pairs at the threshold.

    Taking the centre away from the vectors widens the angle of a pair, so recall is
    measured where the keys are made: sample vectors against partners at just the
    threshold, in random directions. Rotations are added until the wanted share of the
    pairs meets in some table, and keys are cut shorter if very many would not do.
    """
    probe = x[rng.permutation(len(x))[:PROBES]]
    away = rng.normal(size=probe.shape)
    away -= (away * probe).sum(axis=1, keepdims=True) * probe
    away /= np.maximum(np.sqrt((away * away).sum(axis=1, keepdims=True)), 1e-12)
    partner = cosine * probe + math.sqrt(1 - cosine * cosine) * away
    while True:
        rotations: list[np.ndarray] = []
        met = np.zeros(len(probe), bool)
        while met.mean() < RECALL and len(rotations) < MOST:
            rotations.append(learn_rotation(x[:LEARNT] - centre, rng))
            met |= (_keys(probe, centre, rotations[-1:], bits) == _keys(partner, centre, rotations[-1:], bits)).any(axis=1)
        if met.mean() >= RECALL or bits == 1:
            return bits, rotations, float(met.mean())
        bits = max(1, bits - 2)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    # Scaled first, so that neither very large nor very small components lose the norm.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(x: np.ndarray, centre: np.ndarray, rotations: list[np.ndarray], bits: int) -> np.ndarray:
    """A table key for each row and table: ``bits`` signs of one rotation."""
    out = []
    power = 1 << np.arange(bits, dtype=np.int64)
    for r in rotations:
        signs = (x - centre) @ r >= 0
        out += [signs[:, i : i + bits] @ power for i in range(0, x.shape[1] - bits + 1, bits)]
    return np.stack(out, axis=1)


def _encode(dim: int, centre, rotations, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _keys(_unit(batch.column("embedding"), dim), centre, rotations, bits)
                n, t = keys.shape
                at = pa.ListArray.from_arrays(pa.array(np.arange(0, n * t + 1, t, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("rep", "label", "copies", "embedding")] + [at], names=["rep", "label", "copies", "embedding", "keys"])

    return run


def _compare(dim: int, cosine: float):
    """Links counted and connected within whole cells: (vector, linked vectors, smallest of its component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["g", "tab", "key", "a", "b"], 8000):
            t = t.combine_chunks()
            cols = {c: t.column(c).to_numpy() for c in ("g", "tab", "key", "a", "b", "rep", "copies")}
            side = t.column("side").to_numpy(zero_copy_only=False)
            x = _unit(t.column("embedding").combine_chunks(), dim)
            keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
            change = np.ones(len(x), bool)
            change[1:] = np.any([cols[c][1:] != cols[c][:-1] for c in ("g", "tab", "key", "a", "b")], axis=0)
            edges = np.append(np.flatnonzero(change), len(x))
            left, right = [], []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if hi - lo < 2:
                    continue
                square = cols["a"][lo] == cols["b"][lo]
                mine = np.arange(lo, hi)
                ours, theirs = (mine, mine) if square else (mine[side[lo:hi]], mine[~side[lo:hi]])
                if not len(ours) or not len(theirs):
                    continue
                i, j = np.nonzero(x[ours] @ x[theirs].T >= cosine)
                i, j = ours[i], theirs[j]
                if square:
                    i, j = i[i < j], j[i < j]
                # A pair counts in the first table that holds both.
                tab = int(cols["tab"][lo])
                if tab and len(i):
                    fresh = ~(keys[i, :tab] == keys[j, :tab]).any(axis=1)
                    i, j = i[fresh], j[fresh]
                left.append(i)
                right.append(j)
            i = np.concatenate(left) if left else np.zeros(0, np.int64)
            j = np.concatenate(right) if right else np.zeros(0, np.int64)
            nodes, at = np.unique(cols["rep"], return_inverse=True)
            links = np.bincount(at[i], cols["copies"][j], len(nodes)) + np.bincount(at[j], cols["copies"][i], len(nodes))
            root = local_components(at[i], at[j], len(nodes))
            some = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some].astype(np.int64)), pa.array(nodes[root[some]])], names=["rep", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, seed: int = 1) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Vectors are compared when their labels (any type) are equal and not null and they have
    one length. Vectors that are null, zero or empty, hold a null, NaN or infinity, or have a
    null id link with nothing and are kept, each its own component. Equal vectors of a label
    are one node with a count, so copies are never paired. Links are exact; which pairs are
    looked at depends on the tables (see ``plan_tables``). Other columns are ignored.
    """
    v = F.col("embedding")
    good = F.coalesce(v.isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0), F.lit(False))
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(good & finite & F.exists(v, lambda e: e != 0), F.lit(False)).alias("good"))
    use = rows.filter("good").select("vec_id", "label", "embedding")
    nodes = materialise(use.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    dims = nodes.groupBy(F.size("embedding").alias("dim"), "label").count().groupBy("dim").agg(F.max("count").alias("n")).collect()  # one row per length
    kind = vectors.schema["vec_id"].dataType.simpleString()
    found = None
    for dim, largest in sorted((r["dim"], r["n"]) for r in dims):
        of_dim = nodes.filter(F.size("embedding") == dim)
        some = of_dim.select("embedding").orderBy(F.xxhash64("embedding", "rep")).limit(sample).toArrow().column("embedding").combine_chunks()
        x = _unit(some, dim)
        centre = x.mean(axis=0)
        bits, rotations, _ = plan_tables(x, centre, key_bits(largest, dim), cosine, np.random.default_rng(seed))
        element = nodes.schema["embedding"].dataType.elementType.simpleString()
        label = nodes.schema["label"].dataType.simpleString()
        coded = of_dim.select("rep", "label", "copies", "embedding").mapInArrow(_encode(dim, centre, rotations, bits), f"rep {kind}, label {label}, copies long, embedding array<{element}>, keys array<long>")
        coded = materialise(coded, "codes")
        spread = coded.select("rep", F.xxhash64("label").alias("g"), "copies", "embedding", "keys", F.posexplode("keys").alias("tab", "key"))
        # Buckets of one vector have no pair.
        shared = spread.groupBy("g", "tab", "key").count().filter("count > 1").select("g", "tab", "key")
        cells = split_hot(spread.join(shared, ["g", "tab", "key"]), ["g", "tab", "key"], CHUNK, "rep")
        dealt = cells.repartition("g", "tab", "key", "a", "b").sortWithinPartitions("g", "tab", "key", "a", "b")
        part = dealt.mapInArrow(_compare(dim, cosine), f"rep {kind}, links long, root {kind}")
        found = part if found is None else found.unionAll(part)
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if found is None:
        return alone
    found = materialise(found, "links")
    roots = components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    linked = nodes.join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    linked = materialise(linked.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "linked")
    joined = use.join(linked, ["label", "embedding"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    others = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return joined.unionAll(others)

"""Whitening of vectors on leading principal components found by contour integration (FEAST)."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small_table

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Entries beyond this would not be exact as doubles once scaled.
LARGEST = 1 << 42
#: Points of the quadrature on half a contour.
NODES = 8
#: Eigenvalues that one contour encloses, unless they cannot be told apart.
ENCLOSED = 4
#: Part of the trace below which a variance counts as none.
NEGLIGIBLE = 1e-10
#: Residual, relative to the largest eigenvalue, at which an eigenvector is taken.
RESIDUAL = 1e-14
SEED = 5

_SUM = pa.decimal128(38, 0)


def scaled(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, x: the rows whose vector is whole, each entry c as floor(1024 c) + 100000.

    Null vectors, and those with null, non-finite or (beyond 2^42) unscalable entries, are
    left out. Lengths must agree to be compared, so vectors of another length than the
    commonest (the longer one on ties) are left out too, and so are empty ones. Ids may be
    null or repeat and are never compared. Other columns are ignored.
    """
    rows = vectors.select("vec_id", F.col(column).cast("array<double>").alias("c"))
    whole = rows.filter(F.forall("c", lambda e: e.isNotNull() & (F.abs(F.coalesce(e, F.lit(0.0))) < float(LARGEST)))).filter(F.size("c") > 0)
    length = whole.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    whole = whole.filter(F.size("c") == (length["d"] if length else 0))
    return whole.select("vec_id", F.transform("c", lambda e: F.floor(e * SCALE) + SHIFT).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of one task, by dimension."""
    total, n = None, 0
    for batch in batches:
        if batch.num_rows:
            # A batch has 2,000 rows at most, so it cannot overflow 64 bits.
            part = _matrix(batch).sum(axis=0).astype(object)
            total, n = part if total is None else total + part, n + batch.num_rows
    if n:
        cols = [pa.array(range(len(total)), pa.int32()), pa.array([Decimal(int(v)) for v in total], _SUM), pa.array([n] * len(total), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["dim", "total", "n"])


def _products(mean: np.ndarray):
    """Sums of products of one task's centred rows, the upper triangle by cell number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(mean)
        total = None
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch) - mean
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(i * d + j), pa.array(total[i, j])], names=["cell", "value"])

    return run


def moments(x: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """Rows, exact sums by dimension, and the covariance (divisor n, centred first) of the vectors ``x``.

    Each task adds up its own rows; what reaches the driver has the size of one covariance.
    """
    sums = x.mapInArrow(_sums, "dim int, total decimal(38,0), n long").groupBy("dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    rows = sorted(sums.collect())  # one row for each dimension
    if not rows:
        return 0, [], np.zeros((0, 0))
    n, s = rows[0]["n"], [int(r["total"]) for r in rows]
    d = len(s)
    mean = np.array([float(Fraction(v, n)) for v in s])
    cells = x.mapInArrow(_products(mean), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    v = np.zeros(d * d)
    v[cells.column("cell").to_numpy()] = cells.column("value").to_numpy() / n
    v = v.reshape(d, d)
    return n, s, v + np.triu(v, 1).T


def count_above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``v`` exceed ``shift``: the inertia of v - shift, by pivoted LDL'."""
    m = v - shift * np.eye(len(v))
    above = 0
    while len(m):
        k = int(np.argmax(np.abs(np.diag(m))))
        off = np.abs(m - np.diag(np.diag(m)))
        r, c = np.unravel_index(np.argmax(off), off.shape)
        largest = off[r, c]
        if not largest and not m[k, k]:
            return above
        # Bunch and Parlett: a single pivot where the diagonal is not too small, else a pair.
        if abs(m[k, k]) >= (1 + 17**0.5) / 8 * largest:
            at, rest = [k], np.delete(np.arange(len(m)), k)
            above += int(m[k, k] > 0)
        else:
            at, rest = [r, c], np.delete(np.arange(len(m)), [r, c])
            above += 1
        side = m[np.ix_(rest, at)]
        m = m[np.ix_(rest, rest)] - side @ np.linalg.solve(m[np.ix_(at, at)], side.T)
        m = (m + m.T) / 2
    return above


class _Spectrum:
    """What inertia counts tell about the eigenvalues of a covariance, numbered from 1 by falling size."""

    def __init__(self, v: np.ndarray):
        self.v = v
        self.floor = NEGLIGIBLE * float(np.trace(v))
        top = float(np.abs(v).sum(axis=1).max(initial=0.0)) * (1 + 1e-9)
        self.seen = {top: 0}
        self.total = self.above(self.floor) if self.floor > 0 else 0

    def above(self, shift: float) -> int:
        if shift not in self.seen:
            self.seen[shift] = count_above(self.v, shift)
        return self.seen[shift]

    def bracket(self, k: int, part: float) -> tuple[float, float]:
        """Bounds of eigenvalue ``k`` that differ by ``part`` of it at most."""
        low = max(s for s, n in self.seen.items() if n >= k)
        high = min(s for s, n in self.seen.items() if n < k)
        while high - low > part * high:
            mid = (low + high) / 2
            low, high = (mid, high) if self.above(mid) >= k else (low, mid)
        return low, high

    def gap(self, k: int) -> tuple[float, float] | None:
        """Bounds of the gap below eigenvalue ``k``; None where rounding hardly parts it from the next."""
        if k == self.total:
            return self.floor, self.bracket(k, 1e-2)[0]
        for part in (1e-2, 1e-4, 1e-7):
            low, high = self.bracket(k + 1, part)[1], self.bracket(k, part)[0]
            if high - low > part * high:
                return low, high
        return None


def contours(v: np.ndarray, want: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside), falling, that enclose the ``want`` largest eigenvalues and no others between them.

    A contour is a tight interval around neighbours of like size and ends in gaps, which
    inertia counts find. Eigenvalues that rounding can hardly part stay in one contour,
    which may bring in more than are wanted; negligible ones are not wanted.
    """
    spectrum = _Spectrum(v)
    want = min(want, spectrum.total)
    found: list[tuple[float, float, int]] = []
    first, above = 1, np.inf
    while first <= want:
        lead, k = spectrum.bracket(first, 1e-2)[1], first
        while True:
            gap = spectrum.gap(k)
            small = k == spectrum.total or spectrum.bracket(k + 1, 1e-2)[1] < lead / 2
            if gap and (k >= want or small or k - first + 1 >= ENCLOSED):
                break
            k += 1
        lead = spectrum.bracket(first, 1e-2)[1]
        room = max(lead - gap[1], lead / 20) / 2
        low, high = gap[1] - min((gap[1] - gap[0]) / 2, room), lead + min((above - lead) / 2, room)
        n = spectrum.above(low) - spectrum.above(high)
        if n != k - first + 1:
            raise RuntimeError(f"{n} eigenvalues between {low} and {high}, not {k - first + 1}")
        found.append((low, high, n))
        first, above = k + 1, gap[1]
    return found


def _filtered(v: np.ndarray, blocks: list[np.ndarray]):
    """Solve the shifted systems of quadrature points, rows (contour, shift, weight), for their contour's block of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, re, im, wre, wim in zip(*[batch.column(c).to_pylist() for c in ("contour", "re", "im", "wre", "wim")]):
                found = np.linalg.solve(complex(re, im) * np.eye(len(v)) - v, blocks[at].astype(complex))
                part = np.ascontiguousarray((complex(wre, wim) * found).real)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([part.tobytes()])], names=["contour", "part"])

    return run


def _quadrature(spark: SparkSession, at: list[tuple[float, float, int]], which: list[int]) -> DataFrame:
    """Gauss-Legendre points on the upper half of each contour; the lower half is their mirror image."""
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (1 - nodes))
    cols: dict[str, list] = {c: [] for c in ("contour", "re", "im", "wre", "wim")}
    for k in which:
        low, high, _ = at[k]
        radius = (high - low) / 2
        z, w = (low + high) / 2 + radius * turn, weights / 2 * radius * turn
        for c, values in zip(cols, ([k] * NODES, z.real, z.imag, w.real, w.imag)):
            cols[c].extend(np.asarray(values).tolist())
    kinds = {c: pa.float64() for c in cols} | {"contour": pa.int32()}
    return small_table(spark, cols, kinds).repartition(len(which) * NODES)


def leading_components(spark: SparkSession, v: np.ndarray, want: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues of the covariance ``v``, at most ``want``, and their unit eigenvectors as columns.

    For each contour a block of vectors is filtered by the quadrature of (z - v)^-1 around
    it, one Spark task for each point, and Rayleigh-Ritz takes the eigenpairs inside, until
    their residuals are at rounding level. A contour whose pairs are not as many as the
    inertia of its ends says starts again with a larger block, at last with all of space.
    The driver keeps matrices of the covariance's size and never rows.
    """
    d = len(v)
    at = contours(v, want)
    if not at:
        return np.zeros(0), np.zeros((d, 0))
    top = at[0][1]
    rng = np.random.default_rng(SEED)
    sizes = [min(d, n + max(3, n // 2)) for _, _, n in at]
    blocks = [rng.standard_normal((d, m)) for m in sizes]
    found: dict[int, np.ndarray] = {}
    last, tried = [np.inf] * len(at), [0] * len(at)
    for _ in range(rounds):
        open_ = [k for k in range(len(at)) if k not in found]
        if not open_:
            break
        parts = _quadrature(spark, at, open_).mapInArrow(_filtered(v, blocks), "contour int, part binary").collect()
        for k in open_:
            q = sum(np.frombuffer(r["part"]).reshape(d, -1) for r in parts if r["contour"] == k)
            q = np.linalg.qr(q)[0] if sizes[k] < d else np.eye(d)
            values, turn = np.linalg.eigh(q.T @ v @ q)
            vectors = q @ turn
            low, high, n = at[k]
            residual = np.abs(v @ vectors - vectors * values).max(axis=0) / top
            inside = np.flatnonzero((values > low) & (values < high))
            # Inertia says how many there are; directions of mere noise have large residuals.
            best = np.sort(inside[np.argsort(residual[inside])[:n]])
            worst = residual[best].max(initial=0.0) if len(best) == n else np.inf
            if worst <= RESIDUAL * d or worst < 1e-11 and worst >= last[k] / 2 or sizes[k] == d:
                found[k] = vectors[:, best]
            elif worst >= last[k] and tried[k] > 2:
                # Some are missed: search a larger space afresh.
                sizes[k], last[k], tried[k] = min(d, 2 * sizes[k]), np.inf, 0
                blocks[k] = rng.standard_normal((d, sizes[k]))
            else:
                last[k], blocks[k], tried[k] = worst, vectors, tried[k] + 1
    if len(found) < len(at):
        raise RuntimeError(f"eigenpairs not found after {rounds} rounds")
    # Once more over all contours, so that vectors from different ones are orthogonal too.
    q = np.linalg.qr(np.column_stack([found[k] for k in range(len(at))]))[0]
    values, turn = np.linalg.eigh(q.T @ v @ q)
    order = np.argsort(-values, kind="stable")[: min(want, len(values))]
    return values[order], (q @ turn)[:, order]


def _projected(n: int, s: list[int], mean: np.ndarray, axes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(s, object)
        narrow = max(map(abs, s)) < 1 << 62
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            if narrow and n * int(np.abs(x).max()) < 1 << 62 and (y := n * x - whole.astype(np.int64)).size and len(s) * int(np.abs(y).max()) ** 2 < 1 << 63:
                deviation = pa.array((y * y).sum(axis=1)).cast(_SUM)
            else:
                deviation = pa.array([Decimal(int(((n * r - whole) ** 2).sum())) for r in x.astype(object)], _SUM)
            w = (x - mean) @ axes
            offsets = pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)) if w.shape[1] else pa.array(np.zeros(len(x) + 1, np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, lists], names=["vec_id", "deviation", "whitened"])

    return run


def whitened(x: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every vector and component.

    ``x`` is (vec_id, x array<long>) of one length, as ``scaled`` gives it. Components are
    numbered from 1 by falling variance; those whose variance is below 1e-10 of the whole
    are left out, so vectors that are all alike, or one vector, give no rows, as does an
    empty table. ``deviation`` is exact; beyond what a long holds it is null.
    ``identity_error`` is measured on the written rows.
    """
    spark = x.sparkSession
    kind = x.schema["vec_id"].dataType.simpleString()
    n, s, v = moments(x)
    values, axes = leading_components(spark, v, components)
    k = len(values)
    mean = np.array([float(Fraction(t, n)) for t in s])
    empty = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return spark.createDataFrame([], empty)
    rows = x.mapInArrow(_projected(n, s, mean, axes / np.sqrt(values)), f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")
    rows = materialise(rows, "whitened")
    pairs = list(combinations_with_replacement(range(k), 2))
    covariances = rows.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(covariances, pairs))
    share = F.array(*[F.lit(float(e / np.trace(v))) for e in values])
    each = rows.select("vec_id", F.expr("try_cast(deviation as long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", share[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"),
    )

"""Whitened vectors against a dense eigendecomposition."""

import numpy as np
import pytest

from surgecast.llm import queries
from surgecast.llm import whitening as wh
from surgecast.llm.common import prepare, table


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def check(frame, ids, x, components=8):
    """Compare with numpy: exact deviations, eigenvalue shares, scores up to the sign of a component."""
    got = frame.toPandas().sort_values(["component", "vec_id"])
    n, s = len(x), x.sum(axis=0)
    mean = x.mean(axis=0)
    v = (x - mean).T @ (x - mean) / n
    values = np.linalg.eigvalsh(v)[::-1][:components]
    k = int((values > wh.NEGLIGIBLE * np.trace(v)).sum())
    assert sorted(set(got.component)) == list(range(1, k + 1)) and len(got) == n * k
    order = np.argsort(ids)
    deviation = [int(((n * r - s) ** 2).sum()) for r in x.astype(object)]
    for c, rows in got.groupby("component"):
        assert rows.vec_id.tolist() == [ids[i] for i in order] and set(rows.n) == {n}
        assert rows.deviation.tolist() == [deviation[i] for i in order]
        assert np.allclose(rows.explained, values[c - 1] / np.trace(v), rtol=1e-9)
    white = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(white.mean(axis=0)).max() < 1e-9
    assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-8 and (got.identity_error < 1e-8).all()
    # The scores give back the projections on the eigenspaces: their Gram matrix needs no signs.
    rebuilt = white * np.sqrt(values[:k]) @ (white * np.sqrt(values[:k])).T
    if k == x.shape[1]:
        assert np.allclose(rebuilt, ((x - mean) @ (x - mean).T)[np.ix_(order, order)], rtol=1e-8, atol=1e-6 * np.trace(v))
    return white, order


def frame_of(session, ids, c, kind="double"):
    rows = [(int(i), [float(e) for e in r], "clash", 1.0) for i, r in zip(ids, c)]
    return session.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, x string, whitened double").repartition(3)


def integers(c):
    return np.floor(c * 1024).astype(np.int64) + 100_000


def test_query_equals_a_dense_solver(session, sf_dir):
    e = table(session, sf_dir, "embeddings").toPandas()
    x = integers(np.stack(e.embedding).astype(float))
    white, order = check(queries.op11_whitening(session, sf_dir), e.vec_id.tolist(), x)
    values, vectors = np.linalg.eigh(np.cov(x.T, ddof=0))
    want = ((x - x.mean(axis=0)) @ vectors[:, ::-1][:, :8] / np.sqrt(values[::-1][:8]))[order]
    assert np.abs(white * np.sign((white * want).sum(axis=0)) - want).max() < 1e-9


def test_equal_eigenvalues(session):
    """Every direction has the same variance, so eight of ten equal components are as good as any."""
    c = np.concatenate([np.eye(10), -np.eye(10)]) * 3
    check(wh.whitened(wh.scaled(frame_of(session, range(20), c))), list(range(20)), integers(c))


@pytest.mark.parametrize("dims, rank", [(3, 3), (12, 4), (1, 1), (40, 40)])
def test_few_dimensions_and_low_rank(session, dims, rank):
    rng = np.random.default_rng(dims)
    c = rng.integers(-3, 4, (60, rank)) @ rng.choice([-2, -1, 1, 2], (rank, dims)) / 4.0 * np.arange(1, dims + 1) ** 2
    check(wh.whitened(wh.scaled(frame_of(session, range(60), c))), list(range(60)), integers(c))


def test_wide_and_clustered_spectrum(session):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    spread = np.array([900, 30, 30.001, 30.002, 5, 5, 5, 5, 5, 4.99] + [1] * 14)
    c = rng.normal(size=(400, 24)) * spread @ q
    check(wh.whitened(wh.scaled(frame_of(session, range(400), c))), list(range(400)), integers(c))


def test_odd_vectors(session):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, 1.0], [0.25, -1.0], [-2.0, 0.0]]
    rows = [(1, good[0]), (2, good[1]), (2, good[1]), (None, good[2]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [1e200, 0.0])]
    frame = session.createDataFrame(rows, "vec_id int, embedding array<double>")
    got = wh.whitened(wh.scaled(frame)).toPandas()
    assert sorted(got.vec_id.fillna(-1).astype(int)) == sorted([1, 2, 2, -1] * 2) and set(got.n) == {4}
    x = integers(np.array([good[0], good[1], good[1], good[2]]))
    assert sorted(set(got.deviation)) == sorted({int(((4 * r - x.sum(axis=0)) ** 2).sum()) for r in x})


def test_exact_beyond_64_bits(session):
    """Deviations are exact where they fit a long, and null beyond it."""
    c = np.array([[0.0, 1.0], [2.0**20, 3.0], [2.0**21, 0.5]])
    for factor in (1.0, 2.0, 2.0**19):
        x = integers(c * factor).astype(object)
        want = [int(((3 * r - x.sum(axis=0)) ** 2).sum()) for r in x]
        got = wh.whitened(wh.scaled(frame_of(session, range(3), c * factor)))
        first = {r["vec_id"]: r["deviation"] for r in got.collect() if r["component"] == 1}
        assert [first[i] for i in range(3)] == [w if w < 2**63 else None for w in want]
    assert None in first.values()


def test_no_variance(session):
    alike = frame_of(session, range(5), np.ones((5, 3)))
    assert wh.whitened(wh.scaled(alike)).collect() == []
    none = session.createDataFrame([], "vec_id long, embedding array<float>")
    found = wh.whitened(wh.scaled(none))
    assert found.collect() == [] and found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("spectrum", [[7, 7, 7, 7, 7, 7, 7, 7, 7, 3], [1e6, 900, 900.0001, 900, 4, 1e-3, 1e-3, 0, 0, 0], [5, 4, 3, 2, 1, 0.5, 0.25, 0.1, 0.05, 0.01], list(range(40, 0, -1))])
def test_contours_hold_the_wanted_eigenvalues(session, spectrum):
    d = len(spectrum)
    q = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))[0]
    v = q * spectrum @ q.T
    v = (v + v.T) / 2
    values, axes = wh.leading_components(session, v, 8)
    want = [e for e in spectrum if e > wh.NEGLIGIBLE * sum(spectrum)][:8]
    assert np.allclose(values, sorted(want, reverse=True), rtol=1e-9, atol=1e-12 * spectrum[0])
    assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-12
    assert np.abs(v @ axes - axes * values).max() < 1e-12 * spectrum[0]


def test_inertia_counts():
    rng = np.random.default_rng(8)
    for d in (1, 2, 5, 17):
        m = rng.normal(size=(d, d))
        m = m + m.T
        values = np.linalg.eigvalsh(m)
        for shift in rng.normal(scale=3, size=8):
            assert wh.count_above(m, shift) == (values > shift).sum()
    assert wh.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1

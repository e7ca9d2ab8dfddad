"""Near-duplicate vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from surgecast.llm import embeddings_dedup as ed
from surgecast.llm.common import local_components, prepare, table


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def brute(ids, x, labels, cosine):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= cosine) & (labels[:, None] == labels[None, :])
    i, j = np.nonzero(np.triu(near, 1))
    return near.sum(1) - 1, ids[local_components(i, j, len(ids))]


def test_whole_table(session, sf_dir):
    frame = table(session, sf_dir, "embeddings")
    got = ed.near_vectors(frame).toPandas().sort_values("vec_id")
    e = frame.toPandas().sort_values("vec_id")
    links, low = brute(e.vec_id.to_numpy(), np.stack(e.embedding).astype(float), e.label.to_numpy(), 0.93)
    assert (got.n_links.to_numpy() <= links).all() and got.n_links.sum() >= 0.9 * links.sum()
    assert (got.component_id.to_numpy() == low).mean() > 0.9


@pytest.mark.parametrize("chunk", [8, 512])
def test_hot_group_and_recall_at_the_threshold(session, monkeypatch, chunk):
    """One group holds most rows, and its links lie close above the threshold."""
    monkeypatch.setattr(ed, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 32))
    x = np.concatenate([np.repeat(centres, 5, axis=0), np.repeat(centres[:1], 80, axis=0)])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=x.shape)
    x = x + 0.19 * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    x = np.concatenate([x, x[:40], x[:40]]).astype(np.float32)
    labels = np.zeros(len(x), int)
    rows = [(i, [float(v) for v in r], 0, "clash", 1) for i, r in enumerate(x)]
    frame = session.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string, copies int").repartition(3)
    got = ed.near_vectors(frame).toPandas().sort_values("vec_id")
    links, _ = brute(np.arange(len(x)), x.astype(float), labels, 0.93)
    assert (got.n_links.to_numpy() <= links).all() and got.n_links.sum() >= 0.9 * links.sum()


def leaning(rng, n, dim, mean):
    """Unit vectors whose mean has about the given length."""
    x = rng.normal(size=(n, dim)) / np.sqrt(dim)
    x[:, 0] += mean / np.sqrt(1 - mean * mean)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def moved(rng, x, cosine):
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)


@pytest.mark.parametrize("mean", [0.0, 0.5, 0.8])
@pytest.mark.parametrize("largest", [4_000, 100_000])
def test_recall_with_a_common_direction(mean, largest):
    """Other pairs than those the plan was measured on meet in its tables, however long the common mean."""
    rng = np.random.default_rng(7)
    x = leaning(rng, 6_000, 64, mean)
    centre = x[:4_000].mean(axis=0)
    bits, rotations, measured = ed.plan_tables(x[:4_000], centre, ed.key_bits(largest, 64), 0.93, np.random.default_rng(1))
    a = x[4_000:]
    met = (ed._keys(a, centre, rotations, bits) == ed._keys(moved(rng, a, 0.94), centre, rotations, bits)).any(axis=1).mean()
    assert measured >= 0.97 and met >= 0.95


def test_links_with_a_common_direction(session):
    rng = np.random.default_rng(11)
    base = leaning(rng, 1_500, 32, 0.8)
    x = np.concatenate([base, moved(rng, base[:500], 0.94)]).astype(np.float32)
    frame = session.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(3)
    got = ed.near_vectors(frame).toPandas().sort_values("vec_id")
    links, _ = brute(np.arange(len(x)), x.astype(float), np.zeros(len(x), int), 0.93)
    assert links.sum() >= 1_000 and (got.n_links.to_numpy() <= links).all() and got.n_links.sum() >= 0.95 * links.sum()


def test_odd_vectors(session):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1),
        (9, [1.0, 0.0], None), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e-30, 0.0], 1), (13, [1.0, 0.0], 1), (13, [1.0, 0.0], 1), (None, [1.0, 0.0], 1),
    ]
    frame = session.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(((r["vec_id"] or -1), r["n_links"], r["component_id"] or -1, r["kept"]) for r in ed.near_vectors(frame).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted([(-1, 0, -1, True), (1, 4, 1, True), (2, 4, 1, False), (12, 4, 1, False), (13, 4, 1, False), (13, 4, 1, False), *alone])
    assert ed.near_vectors(frame.limit(0)).count() == 0
    assert ed.near_vectors(frame.filter(F.col("vec_id") == 5)).count() == 1


def test_rotation_is_orthogonal_and_balanced():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 16)) * np.linspace(0.1, 3, 16)
    r = ed.learn_rotation(x, rng)
    assert np.allclose(r.T @ r, np.eye(16), atol=1e-8)
    assert (np.abs(((x @ r) >= 0).mean(axis=0) - 0.5) < 0.1).all()

"""Fingerprints of a hot bucket are compared in bounded memory."""

import tracemalloc

import numpy as np

from surgecast.llm import simhash


def test_comparison_stays_small():
    n = 20_480
    fps = np.random.default_rng(3).integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64)
    fps[1::1000] = fps[::1000][: len(fps[1::1000])] ^ np.uint64(0b1111)
    group, ones = np.arange(n) // 2048, np.ones(n, bool)
    tracemalloc.start()
    found = {(min(a, b), max(a, b)) for i, j in simhash._pairs_within(fps, group, ones, ones, 4) for a, b in zip(i.tolist(), j.tolist())}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = {(k, k + 1) for k in range(0, n - 1, 1000) if k // 2048 == (k + 1) // 2048}
    assert found == want
    assert peak < 40e6

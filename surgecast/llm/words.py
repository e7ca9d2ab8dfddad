"""Word and window hashes of many whole texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed in one go; a longer text is taken alone.
SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _table(seed: int) -> np.ndarray:
    """A random 64-bit number per byte value, zero for white space."""
    t = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    t[_SPACE] = 0
    return t


_BYTES = {s: _table(s) for s in (1, 2)}
_BASE = {1: 0x9E3779B97F4A7C15, 2: 0xD1342543DE82EF95}


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def rolled(h: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hash of every ``size`` consecutive items; positions near the end wrap and mean nothing."""
    base, out, done = _BASE[seed] | 1, None, 0
    power, width, at = h, 1, 0
    while True:
        if size >> at & 1:
            factor = np.array([pow(base, done, 1 << 64)], np.uint64)
            out = power.copy() if out is None else out + np.roll(power, -done) * factor
            done += width
        at += 1
        if size >> at == 0:
            return mix(out)
        power = power + np.roll(power, -width) * np.array([pow(base, width, 1 << 64)], np.uint64)
        width *= 2


def sliding_min(g: np.ndarray, size: int) -> np.ndarray:
    """Smallest of every ``size`` consecutive items."""
    width = 1
    while width * 2 <= size:
        g = np.minimum(g, np.roll(g, -width))
        width *= 2
    return np.minimum(g, np.roll(g, -(size - width))) if size > width else g


def word_hashes(texts: pa.Array, seeds: tuple[int, ...] = (1,)) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """(first row, end row, word counts per row, hashes of all words for each seed) of slices of ``texts``."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        part = data[offsets[lo] : offsets[hi]]
        edges = offsets[lo : hi + 1] - offsets[lo]
        solid = ~_SPACE[part]
        cut = np.ones(len(part) + 1, bool)
        cut[1:-1] = ~solid[:-1]
        cut[edges] = True
        starts = np.flatnonzero(solid & cut[:-1])
        counts = np.diff(np.searchsorted(starts, edges))
        hashes = []
        if len(starts):
            run = np.diff(np.append(starts, len(part)))
            within = np.arange(starts[0], len(part)) - np.repeat(starts, run)
            for s in seeds:
                value = _BYTES[s][part[starts[0] :]] * powers(_BASE[s], int(run.max()))[within]
                hashes.append(mix(np.add.reduceat(value, starts - starts[0])))
        else:
            hashes = [np.zeros(0, np.uint64) for _ in seeds]
        yield lo, hi, counts, hashes
        lo = hi

"""Corners of the convex minorant, all chords at once, against the fold point by point; long samples."""

import time

import numpy as np

from levelscan.operators import indicators as I


def fold(v, f):
    keep = [0]
    for i in range(1, len(v)):
        while len(keep) > 1 and (f[keep[-1]] - f[keep[-2]]) * (v[i] - v[keep[-2]]) >= (f[i] - f[keep[-2]]) * (v[keep[-1]] - v[keep[-2]]):
            keep.pop()
        keep.append(i)
    return keep


def test_corners():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 4, 9, 50, 700):
        v = np.cumsum(rng.integers(1, 9, n)).astype(float)
        for f in (np.cumsum(rng.integers(0, 5, n)), v * 3, v**2, -(v**2), rng.integers(0, 3, n)):
            assert list(I._hull_points(v, np.asarray(f, float))) == fold(v, np.asarray(f, float))
    v = 2.0 ** np.arange(300)  # every point a corner, the deepest ones next to the end
    assert list(I._hull_points(v, v**1.5 / v[-1])) == list(range(300))


def test_dip_of_a_long_sample():
    x = np.sort(np.random.default_rng(6).random(300_000))
    start = time.perf_counter()
    dip = I.dip_of(x, np.ones(len(x)))
    assert 0 < dip < 0.002 and time.perf_counter() - start < 6  # about 0.6 s; point by point about 18 s


def test_dip_searches_few_points_again(monkeypatch):
    seen, whole = [], I._hull_points
    monkeypatch.setattr(I, "_hull_points", lambda v, *a: seen.append(len(v)) or whole(v, *a))
    x = np.unique(np.random.default_rng(7).exponential(50, 50_000))
    I.dip_of(x, np.ones(len(x)))
    assert sum(seen) < 4 * len(x)  # all points twice, then stretches; formerly about 17 times


def test_dip_by_stretches():
    rng = np.random.default_rng(8)
    for n in (2, 511, 512, 513, 1023, 1024, 1025, 1026, 1700):
        for x in (rng.random(n), np.round(rng.exponential(5, n), 2), rng.integers(0, 1 + n // 2, n), np.arange(n) ** 3.0):
            v, c = np.unique(x, return_counts=True)
            hi = np.cumsum(c) / c.sum()
            lo = hi - c / c.sum()

            def miss(at, f, g):  # half the largest gap of g to the minorant of f over the values ``at``
                keep = np.array(fold(v[at], f[at]))
                return (g[at] - np.interp(v[at], v[at][keep], f[at][keep])).max() / 2

            k = len(v)
            modes = np.arange(k) if k < 30 else np.unique(rng.integers(0, k, 12))
            place = np.arange(k)
            least = min(max(
                miss(place[: m + 1], lo, np.where(place == m, lo, hi)) if m else 0, miss(place[m:], -hi, np.where(place == m, -hi, -lo)) if m < k - 1 else 0) for m in modes)
            assert I.dip_of(v, c) <= least + 1e-12 and (k >= 30 or abs(I.dip_of(v, c) - least) < 1e-12)

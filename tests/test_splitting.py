"""Splitting against plain searches over small volumes."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable.operators import splitting as SP
from voxtable.operators.components import half_offsets
from voxtable.operators.stencils import gaussian_weights

REQUEST = "fish_id string, label int, n_splits int, sigma double, min_distance int"


def blobs(seed, shape=(12, 22, 30), n=5):
    rng = np.random.default_rng(seed)
    g = np.indices(shape)
    d = np.zeros(shape, dtype=int)
    for _ in range(n):
        c = [rng.integers(3, s - 3) for s in shape]
        d[sum((g[i] - c[i]) ** 2 for i in range(3)) <= rng.integers(8, 26)] = 4
    return d


def plain_heights(dense, sigma, margin):
    at = np.argwhere(dense)
    lo, hi = at.min(0), at.max(0)
    m = np.pad(dense[tuple(slice(a, b + 1) for a, b in zip(lo, hi))] > 0, margin)
    bg = np.argwhere(~m)
    out = np.zeros(m.shape)
    for v in np.argwhere(m):
        out[tuple(v)] = np.sqrt(((bg - v) ** 2).sum(1).min())
    k = gaussian_weights(sigma)
    r = len(k) // 2
    for axis in range(3):
        p = np.pad(out, [(r, r) if a == axis else (0, 0) for a in range(3)], mode="symmetric")
        out = sum(w * p.take(range(i, i + out.shape[axis]), axis) for i, w in enumerate(k))
    return {tuple(int(x) for x in v + lo - margin): out[tuple(v)] for v in np.argwhere(m)}


def best_ways(h, start, conn):
    """Highest level at which each voxel can be reached from ``start``."""
    offs = [tuple(s * v for v in o) for o in half_offsets(conn) for s in (1, -1)]
    best, heap = {}, [(-h[start], start)]
    while heap:
        v, p = heapq.heappop(heap)
        if p in best:
            continue
        best[p] = -v
        for o in offs:
            q = tuple(a + b for a, b in zip(p, o))
            if q in h and q not in best:
                heapq.heappush(heap, (max(v, -h[q]), q))
    return best


@pytest.mark.parametrize("seed,sigma", [(0, 0.5), (1, 1.0), (2, 0.0)])
def test_heights_peaks_and_parts(make, spark, seed, sigma):
    d = blobs(seed)
    asked = spark.createDataFrame([("f", 4, 2, sigma, 2)], REQUEST)
    labels = make({"f": d})
    rows = SP.heights(labels, asked, brick=(8, 8, 16)).collect()
    h = {(r["z"], r["y"], r["x"]): r["height"] for r in rows}
    want = plain_heights(d, sigma, int(sigma) + 2)
    assert h.keys() == want.keys() and max(abs(h[p] - want[p]) for p in h) < 1e-8

    scope = ["fish_id", "label"]
    sites = SP.basins(SP.heights(labels, asked))
    peaks = sites.filter("at = basin").select(*scope, "at", "height")
    pairs = SP.neighbours(sites, ["height", "basin"], scope, 26).filter("basin <> basin_b")
    saddles = pairs.groupBy(*scope, F.col("basin").alias("a"), F.col("basin_b").alias("b")).agg(F.max(F.least("height", "height_b")).alias("saddle"))
    got = {tuple(r["at"]): r["prominence"] for r in SP.prominences(peaks, saddles, scope).collect()}
    faces = [tuple(s * v for v in o) for o in half_offsets(6) for s in (1, -1)]
    rank = {p: (v, p) for p, v in h.items()}
    tops = {p for p in h if all(rank.get(tuple(a + b for a, b in zip(p, o)), (-1, p)) < rank[p] for o in faces)}
    assert got.keys() == tops
    for p in tops:
        ways = best_ways(h, p, 26)
        low = max((ways[q] for q in ways if q in tops and rank[q] > rank[p]), default=0.0)
        assert got[p] == pytest.approx(h[p] - low)

    parts, status = SP.split_parts(labels, asked)
    level = next((s * max(h.values()) for s in SP.levels() if sum(v >= s * max(h.values()) for v in got.values()) >= 2), None)
    assert (status.first()["status"] == "ok") == (level is not None)
    if level is None:
        return
    order = sorted((p for p in got if got[p] >= level), key=lambda p: (-h[p], p))
    first = order[0]
    second = next(p for p in order[1:] if sum((a - b) ** 2 for a, b in zip(p, first)) >= 4)
    ways = {1: best_ways(h, first, 6), 2: best_ways(h, second, 6)}
    part = {(r["z"], r["y"], r["x"]): r["part"] for r in parts.collect()}
    assert part.keys() == ways[1].keys() | ways[2].keys() and part[first] == 1 and part[second] == 2
    for p, k in part.items():  # nobody could reach another seed on a higher way
        assert ways[k][p] >= ways[3 - k].get(p, -1)


def test_wide_kernel_sees_the_mirrored_margin(make, spark):
    d = blobs(7, (9, 12, 14), 2)
    asked = spark.createDataFrame([("f", 4, 2, 4.0, 0)], REQUEST)
    h = {(r["z"], r["y"], r["x"]): r["height"] for r in SP.heights(make({"f": d}), asked, brick=(4, 8, 8)).collect()}
    want = plain_heights(d, 4.0, 6)
    assert h.keys() == want.keys() and max(abs(h[p] - want[p]) for p in h) < 1e-8


def test_no_requests_and_repeated_requests(make, spark):
    d = np.zeros((3, 3, 9), dtype=int)
    d[1, 1, 1:8] = 5
    labels = make({"f": d})
    out, status = SP.split_labels(labels, spark.createDataFrame([], REQUEST))
    assert out.count() == 7 and status.count() == 0
    twice = spark.createDataFrame([("f", 5, 3, 0.0, 1), ("f", 5, 2, 0.0, 1)], REQUEST)
    out, status = SP.split_labels(labels, twice)
    assert out.count() == 7 and [r["status"] for r in status.collect()] == ["only 1 prominent peaks"]

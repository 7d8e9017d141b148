"""Centroid clustering against all distances."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from plotloom.llm import elkan


def brute(rows, clusters=8, rounds=10, seed=3, dimensions=64):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v], v) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    centers = [r[1] for r in start[:clusters]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x: min((d2(x, c), k) for k, c in enumerate(centers))
    for _ in range(rounds):
        own = [near(x)[1] for _, x, _ in kept]
        for k in set(own):
            members = [x for (_, x, _), o in zip(kept, own, strict=True) if o == k]
            centers[k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    last = [near(x) for _, x, _ in kept]
    total = Counter()
    for d, k in last:
        total[k] += d
    size = Counter(k for _, k in last)
    fit = lambda n: n if n < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return Counter((i, k, fit(d), fit(total[k]), fit(sum(total.values())), sha[k], size[k]) for (i, _, _), (d, k) in zip(kept, last, strict=True))


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS cluster", "2 AS block", "3 AS state", "4 AS size")


def test_clusters(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(6, 64))
    rows = [(i, (middles[i % 6] + rng.normal(scale=0.1, size=64)).tolist()) for i in range(500)]
    rows += [(900 + i, [float(x) / 1024 for x in rng.integers(-1, 2, 64)]) for i in range(200)]  # many ties
    rows += [(5, rows[5][1]), (5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, rows[8][1])] + [(2000 + i, rows[9][1]) for i in range(300)]
    odd = [(1, None), (2, []), (3, [0.5] * 63), (4, [None] + [0.5] * 63), (6, [math.nan] * 64), (7, [math.inf] + [0.0] * 63), (8, [0.0] * 64), (9, [-0.0] * 64), (10, [0.5] * 65)]
    got = Counter(tuple(r) for r in elkan.cluster_vectors(frame(spark, rows + odd)).collect())
    assert got == brute(rows + odd)
    assert elkan.cluster_vectors(frame(spark, odd[:6])).count() == 0
    assert elkan.cluster_vectors(frame(spark, [])).count() == 0


@pytest.mark.parametrize("most", [3.0, 1e6, 1e200, 1e308])
def test_large_components_and_few_vectors(spark, most):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=64) * (most if i % 3 == 0 else 1.0) / 4).tolist()) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(3)]
    for own in (rows, rows[:3]):
        got = Counter(tuple(r) for r in elkan.cluster_vectors(frame(spark, own), rounds=4).collect())
        assert got == brute(own, rounds=4)


def test_bounds_skip_distances():
    rng = np.random.default_rng(6)
    middles = rng.integers(-900, 900, (8, 64))
    points = middles[rng.integers(0, 8, 2000)] + rng.integers(-40, 41, (2000, 64))
    centers = middles + rng.integers(-30, 31, (8, 64))
    bounds, own, first = elkan.assign(points, centers, elkan.Bounds.none(2000, 8))
    for _ in range(4):
        after = centers + rng.integers(-2, 3, (8, 64))
        drift = elkan.root(((after - centers) ** 2).sum(1), up=True)
        centers = after
        bounds, own, calculated = elkan.assign(points, centers, elkan._load(elkan._dump(elkan.moved(bounds, drift)), 8))
        every = np.stack([elkan.squared(points, c) for c in centers], 1)
        assert (every.argmin(1) == bounds.cluster).all()
        true = np.sqrt(every.astype(float))
        assert (bounds.upper >= true[np.arange(2000), bounds.cluster] * (1 - 1e-12)).all() and (bounds.lower <= true * (1 + 1e-12)).all()
        assert calculated < 0.2 * 2000 * 8 <= first

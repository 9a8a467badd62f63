"""Clustering with bounds against full scans."""

import hashlib
import math
import random

import numpy as np
import pytest

from sessionloom.llm import clustering
from sessionloom.llm.clustering import Bounds, cluster

SCHEMA = "vec_id long, embedding array<double>, label int, block string, state string, kind string, x string, ids string, moved string"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, None, *("bskxim")) for k, v in rows], SCHEMA)


def nearest(x, centroids):
    return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))


def brute(rows, width, k, rounds, seed="3", scale=1024):
    held = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in held if i is not None)
    centroids = [x for _, x in order[:k]]
    for _ in range(rounds):
        own = [nearest(x, centroids)[1] for _, x in held]
        for j in range(len(centroids)):
            mine = [x for (_, x), a in zip(held, own, strict=True) if a == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [(i, *nearest(x, centroids)) for i, x in held]
    spread = [sum(d for _, d, j in found if j == c) for c in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fit = lambda v: v if v < 1 << 63 else None
    return sorted([(i, j, fit(d), fit(spread[j]), fit(sum(spread)), digest[j]) for i, d, j in found], key=str)


def got(frame_, **kw):
    rows = cluster(frame_, **kw).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    return sorted((tuple(r) for r in rows), key=str)


def points(n, width, spread, seed):
    draw = random.Random(seed)
    centres = [[draw.uniform(-2, 2) for _ in range(width)] for _ in range(6)]
    return [(k, [c + draw.gauss(0, spread) for c in draw.choice(centres)]) for k in range(n)]


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_equals_full_scans(spark, monkeypatch, spread):
    monkeypatch.setattr(clustering, "BLOCK_ROWS", 37)
    monkeypatch.setattr(clustering, "BUCKET_BLOCKS", 2)
    rows = points(500, 5, spread, 3)
    rows += [(None, rows[3][1]), (7, rows[7][1]), (7, [0.5] * 5), (600, None), (601, [0.0] * 4), (602, [math.nan] * 5), (603, [None] * 5), (604, [])]
    assert got(frame(spark, rows), clusters=8, rounds=10, width=5) == brute(rows, 5, 8, 10)


def test_ties_empty_clusters_and_few_rows(spark):
    rows = [(k, [float(k % 2), 0.0]) for k in range(40)]  # copies: clusters of equal centroids stay empty
    assert got(frame(spark, rows), clusters=8, rounds=4, width=2) == brute(rows, 2, 8, 4)
    few = [(1, [0.0, 0.0]), (2, [5.0, 1.0])]
    assert got(frame(spark, few), width=2) == brute(few, 2, 8, 10)
    assert got(frame(spark, []), width=2) == []
    assert got(frame(spark, [(None, [1.0, 1.0])]), width=2) == []


def test_wide_components(spark):
    rows = [(k, [1e12 * (k % 5) + k, -3e11 * k]) for k in range(50)] + [(77, [1e30, -1e30])]
    limited = [(i, [max(-(2.0**50), min(2.0**50, c)) for c in v]) for i, v in rows]
    assert got(frame(spark, rows), width=2, clusters=4, rounds=6) == brute(limited, 2, 4, 6)


def test_bounds_are_right_and_save_work():
    draw = np.random.Generator(np.random.PCG64(8))
    centres = draw.integers(-4000, 4000, (8, 16))
    x = (centres[draw.integers(0, 8, 3000)] + draw.integers(-900, 900, (3000, 16))).astype(np.int64)
    history, known, evaluated = x[:8][None], Bounds(len(x), 8, None), []
    for _ in range(10):
        known = Bounds(len(x), 8, known.packed())  # as it is stored between rounds
        work, _ = known.assign(x, history)
        evaluated.append(work)
        squares = ((x[:, None, :] - history[-1][None]) ** 2).sum(axis=2)
        assert (known.cluster == squares.argmin(axis=1)).all()
        new = np.array([x[known.cluster == j].sum(axis=0) // max(1, (known.cluster == j).sum()) for j in range(8)])
        history = np.concatenate([history, new[None]])
    assert evaluated[0] == 8 * len(x)
    assert sum(evaluated[4:]) < 0.5 * 8 * len(x) * 6


def test_total_displacement_is_the_tighter_bound():
    """A centroid that goes and comes back loosens nothing."""
    x = np.array([[0], [10]], np.int64)
    known = Bounds(2, 2, None)
    known.assign(x, np.array([[[0], [10]]]))
    history = np.array([[[0], [10]], [[3], [10]], [[0], [10]]])
    work, _ = known.assign(x, history)
    assert work == 0

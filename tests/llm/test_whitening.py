"""Whitening against an eigendecomposition of the covariance as it is written down."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from sessionloom.llm import whitening
from sessionloom.llm.whitening import one_sided_jacobi, pivoted_cholesky, whiten

SCHEMA = "vec_id long, embedding array<double>, label int, x string, e string, n string, i string, j string"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, None, "x", "e", "n", "i", "j") for k, v in rows], SCHEMA)


def brute(rows, count):
    """{(id, component): (n, deviation, |whitened|, explained)}"""
    held = [(k, [math.floor(256 * c) for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in held})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit, strict=True)]
    mean = [Fraction(s, n) for s in sums]
    away = np.array([[float(c - m) for c, m in zip(x, mean, strict=True)] for x in fit])
    v = away.T @ away / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = []
    for k, x in held:
        y = np.array([float(c - m) for c, m in zip(x, mean, strict=True)])
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        for p in range(count):
            found.append((k, p + 1, n, deviation, abs(float(y @ vectors[:, p])) / math.sqrt(values[p]), values[p] / np.trace(v)))
    return found


def check(spark, rows, count=4):
    got = whiten(frame(spark, rows)).collect()
    want = sorted(brute(rows, count), key=str)
    have = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got), key=str)
    assert [h[:4] for h in have] == [w[:4] for w in want]
    np.testing.assert_allclose([h[4:] for h in have], [w[4:] for w in want], rtol=1e-7, atol=1e-9)
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9
    return got


def test_equals_brute_force(spark):
    draw = random.Random(2)
    scale = [3.0, 2.0, 1.4, 1.0, 0.6, 0.2, 0.05]
    rows = [(k, [draw.gauss(5, s) for s in scale]) for k in range(400)]
    rows += [(900, rows[0][1]), (0, rows[0][1]), (None, rows[1][1])]
    rows += [(901, None), (902, [1.0, None] + [0.0] * 5), (903, [math.nan] * 7), (904, [math.inf] + [0.0] * 6)]
    got = check(spark, rows)
    one = lambda key: sorted((r.component, r.whitened) for r in got if r.vec_id == key)
    assert one(0) == sorted(one(900) * 2)  # a repeated id has its rows twice
    assert one(None) == one(1)
    assert {r.vec_id for r in got}.isdisjoint({901, 902, 903, 904})


def test_one_hot_vector_counts_once(spark):
    draw = random.Random(5)
    rows = [(k, [draw.random() for _ in range(5)]) for k in range(60)] + [(k, [0.25] * 5) for k in range(100, 400)]
    assert {r.n for r in check(spark, rows)} == {61}


def test_far_from_the_origin(spark):
    draw = random.Random(6)
    rows = [(k, [1e9 + draw.gauss(0, s) for s in (4, 3, 2, 1, 0.5)]) for k in range(200)]
    check(spark, rows)


def test_lengths_ranks_and_empty_tables(spark):
    assert whiten(frame(spark, [])).collect() == []
    assert whiten(frame(spark, [(1, None), (2, []), (3, [])])).collect() == []
    assert whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # no spread, no component
    line = [(k, [float(k), 2.0 * k, 0.0]) for k in range(9)]
    got = check(spark, line, 1)
    assert {r.component for r in got} == {1} and max(r.explained for r in got) == pytest.approx(1.0)
    mixed = whiten(frame(spark, [*line, (50, [1.0]), (51, [])])).collect()
    assert {r.vec_id for r in mixed} == set(range(9))


def test_beyond_a_long(spark):
    got = whiten(frame(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])])).collect()
    assert {r.deviation for r in got if r.vec_id != 3} == {None}
    assert all(math.isfinite(r.whitened) for r in got)


@pytest.mark.parametrize("rank", [1, 5, 12])
def test_factor_and_rotation(rank):
    draw = np.random.Generator(np.random.PCG64(rank))
    a = draw.standard_normal((12, rank)) * np.logspace(0, -5, 12)[:, None]
    v = a @ a.T
    factor = pivoted_cholesky(v)
    assert factor.shape[1] <= 12 and np.abs(factor @ factor.T - v).max() < 1e-12
    values, parts = one_sided_jacobi(factor)
    np.testing.assert_allclose(values[:rank], np.linalg.eigvalsh(v)[::-1][: len(values)][:rank], rtol=1e-6, atol=1e-15)
    np.testing.assert_allclose(parts.T @ parts, np.eye(len(values)), atol=1e-10)
    assert (np.diff(values) <= 0).all()


def test_rounds_meet_every_pair_once():
    for k in (2, 5, 8):
        met = sorted((int(a), int(b)) for i, j in whitening._rounds(k) for a, b in zip(i, j, strict=True))
        assert met == [(a, b) for a in range(k) for b in range(a + 1, k)]

"""Whitening against exact fractions and numpy's own eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from fleetpulse.llm.whitening import above, characteristic_polynomial, gram, largest_roots, polynomial_mod, whiten


def exact_polynomial(a):
    """det(x - a) by Faddeev and LeVerrier, in fractions."""
    d = len(a)
    a = [[Fraction(int(v)) for v in row] for row in a]
    m, c = [[Fraction(0)] * d for _ in range(d)], [Fraction(0)] * d + [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (c[d - k + 1] if i == j else 0) for j in range(d)] for i in range(d)]
        am = [sum(a[i][t] * m[t][i] for t in range(d)) for i in range(d)]
        c[d - k] = -sum(am) / k
    return [int(v) for v in c]


def brute(vectors, most=4):
    """{row: deviation}, eigenvalues, |projections|, over lists of finite entries."""
    x = np.array([[math.floor(256 * float(c)) for c in v] for v in vectors], object)
    fit = np.array([list(t) for t in {tuple(v) for v in x.tolist()}], object)
    n, s = len(fit), fit.sum(0)
    cov = np.array((n * (fit.T @ fit) - np.outer(s, s)) / n / n, np.float64)
    values, axes = np.linalg.eigh(cov)
    order = [i for i in np.argsort(-values)[:most] if values[i] > 1e-9 * values.max()]
    white = (x.astype(np.float64) - np.array(s / n, np.float64)) @ axes[:, order] / np.sqrt(values[order])
    return n, [int(((n * v - s) ** 2).sum()) for v in x], values[order] / np.trace(cov), white


def collected(spark, rows, kind="array<float>"):
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id bigint, embedding {kind}, n int, x int")
    return whiten(table).collect()


def test_gram_is_exact():
    rng = np.random.default_rng(1)
    for top in (1 << 10, 1 << 19, 1 << 33, 1 << 62):
        x = rng.integers(-top, top, (50, 3))
        x[0] = [-(1 << 63), (1 << 63) - 1, 0] if top > 1 << 60 else x[0]
        o = x.astype(object)
        assert (gram(x) == o.T @ o).all()


def test_polynomial_and_roots(spark):
    rng = np.random.default_rng(2)
    for d, top in ((1, 9), (2, 50), (6, 10**6)):
        b = rng.integers(-top, top, (d, d)).astype(object)
        a = b.T @ b
        poly = characteristic_polynomial(spark, a)
        assert poly == exact_polynomial(a)
        want = sorted(np.linalg.eigvalsh(a.astype(np.float64)))[::-1]
        got = [r.low / 2**r.shift for r in largest_roots(poly, 4)]
        assert got == pytest.approx(want[:4], rel=1e-6)
    assert polynomial_mod(np.array([[0, 0, 1], [0, 0, 2], [0, 3, 0]], object), 7) == [0, 1, 0, 1]
    # (x - 3)^2 (x - 1) x: multiplicity, and a root that is zero
    poly = [0, -9, 15, -7, 1]
    assert above(poly, 2, 0) == 2 and above(poly, 1, 0) == 2 and above(poly, 1, 1) == 3
    assert [(round(r.low / 2**r.shift, 9), r.times) for r in largest_roots(poly, 4)] == [(3.0, 2), (1.0, 1)]


def test_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((900, 8)) * np.array([4, 3, 2, 1.5, 1, 1, 0.5, 0.1])).astype(np.float32)
    x[300:600] = x[300]
    x[7, 2] = -0.0
    odd = [(2000, None), (2001, [None] + [0.5] * 7), (2002, [float("nan")] * 8), (2003, [float("inf")] + [0.5] * 7), (2004, [1.0]), (2005, [])]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (None, x[6].tolist())]
    got = collected(spark, rows + odd)
    n, deviations, explained, white = brute([v for _, v in rows])
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} and {r.vec_id for r in got} == {None, *range(900)}
    signs = {r.component: np.sign(r.whitened * white[1][r.component - 1]) for r in got if r.vec_id == 1}
    for r in got:
        at = 6 if r.vec_id is None else r.vec_id
        assert r.deviation == deviations[at] and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.whitened == pytest.approx(signs[r.component] * white[at][r.component - 1], abs=1e-8)
        assert r.identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1


def test_equal_eigenvalues_few_vectors_and_none(spark):
    # the corners of a cube of three dimensions in five: one eigenvalue, three times
    corners = [[float(i & 1), float(i >> 1 & 1), float(i >> 2), 0.0, 0.0] for i in range(8)]
    got = collected(spark, list(enumerate(corners)))
    assert len(got) == 24 and max(r.identity_error for r in got) < 1e-12 and {round(r.explained, 12) for r in got} == {round(1 / 3, 12)}
    for r in range(8):
        assert sum(g.whitened**2 for g in got if g.vec_id == r) == pytest.approx(3)
    assert [r.component for r in collected(spark, [(1, [0.0, 1.0]), (2, [1.0, 0.0])])] == [1, 1]
    assert collected(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])]) == [] and collected(spark, []) == [] and collected(spark, [(1, [])]) == []


def test_huge_and_small_entries(spark):
    x = [[1e15, 1.0], [-1e15, 2.0], [3e14, 1e-200], [0.0, -1e-300]]
    got = collected(spark, list(enumerate(x)), "array<double>")
    assert len(got) == 8 and {r.deviation for r in got if r.vec_id < 2} == {None} and max(r.identity_error for r in got) < 1e-6
    # 1e300 becomes the largest long
    assert len(collected(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1.0, 5.0])], "array<double>")) == 6

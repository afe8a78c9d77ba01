"""Exact polynomials against another exact method, whole results against dense linear algebra."""

import random
from fractions import Fraction

import numpy as np
import pytest

from ostinato.llm.whitening import (
    FIXED_BITS,
    _null_vectors,
    characteristic_polynomial,
    fit_components,
    leading_roots,
    polynomial_modulo,
    primes_below,
    roots_above,
    whiten,
)


def scatter(d, k, seed=3, low=-300, high=300):
    pick = random.Random(seed)
    x = np.array([[pick.randint(low, high) for _ in range(d)] for _ in range(k)], object)
    s = x.sum(axis=0)
    return k * (x.T @ x) - np.outer(s, s)


def newton(a):
    """Coefficients, constant first, by Faddeev and LeVerrier in whole numbers."""
    d = len(a)
    m, c, out = np.zeros((d, d), object), 1, [1]
    for j in range(1, d + 1):
        m = a @ m + c * np.eye(d, dtype=int).astype(object)
        c = -(a @ m).trace() // j
        out.append(c)
    return out[::-1]


@pytest.mark.parametrize("d, k", [(1, 3), (2, 5), (5, 9), (6, 3), (9, 1)])
def test_polynomial(spark, d, k):
    a = scatter(d, k)
    assert characteristic_polynomial(spark, a.tolist()) == newton(a)


def test_modulo_with_zero_pivots():
    a = np.array([[0, 0, 0, 7], [0, 0, 5, 0], [0, 5, 0, 0], [7, 0, 0, 0]], object)
    for p in primes_below(2**31, 2**40):
        assert polynomial_modulo(a, p).tolist() == [c % p for c in newton(a)]


def test_primes():
    found = primes_below(100, 10**6)
    assert found == [97, 89, 83, 79]


def test_roots():
    # (x - 5) ** 2 (x - 2) x
    pol = [0, -50, 45, -12, 1]
    assert [roots_above(pol, a) for a in (-1, 0, 1, 2, 4, 5)] == [4, 3, 3, 2, 2, 0]
    got = [(Fraction(r, 2**s), m) for r, s, m in leading_roots(pol, 4)]
    assert got == [(5, 2), (2, 1)]
    (r, s, m), *_ = leading_roots([-2, 0, 1], 1)  # the square root of 2
    assert m == 1 and abs(Fraction(r, 2**s) ** 2 - 2) < Fraction(1, 2**120)


def test_components_of_near_roots():
    d = 12
    a = np.diag([10**12 + k for k in range(d)]).astype(object)
    a[0, 1] = a[1, 0] = 1
    pol = newton(a)
    vectors = [_null_vectors(a.tolist(), r, s, m)[0] for r, s, m in leading_roots(pol, 4)]
    for k, v in enumerate(vectors):
        v = np.array([x / (1 << FIXED_BITS) for x in v])
        assert abs(abs(v[d - 1 - k]) - 1) < 1e-15


def test_repeated_root_gives_a_basis():
    for count, root, matrix in ((2, 5, [[5, 0, 0], [0, 5, 0], [0, 0, 2]]), (3, 4, np.diag([4, 4, 4]).tolist())):
        v = np.array(_null_vectors(matrix, root, 0, count), object) / (1 << FIXED_BITS)
        v = v.astype(float)
        assert np.allclose(v @ v.T, np.eye(count), atol=1e-15)
        assert np.allclose(v @ np.array(matrix), root * v, atol=1e-14)


def frame(spark, vectors, **more):
    rows = [(k, v) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def expected(vectors, wanted=4):
    size = max(map(len, vectors))
    x = np.array([np.floor(256 * np.array([*v, *[0] * (size - len(v))], float)) for v in vectors]).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    w, v = np.linalg.eigh(np.cov(u.T.astype(float), bias=True).reshape(size, size))
    return x, n, s, w[::-1][:wanted], v[:, ::-1][:, :wanted].T, w.sum()


def test_whiten(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 9)) * [9, 8, 5, 3, 1, 1, 1, 0.5, 0.01]).tolist()
    vectors += vectors[:40] + [[-0.0] * 9, [], [1.0, 2.0]]
    bad = [None, [1.0, None], [float("nan")] * 9, [1.0, float("inf")], [float("-inf")] * 9]
    got = whiten(frame(spark, [*vectors, *bad])).collect()
    x, n, s, w, v, trace = expected(vectors)
    assert len(got) == 4 * len(vectors) and {r.n for r in got} == {n}
    for c in range(4):
        mine = {r.vec_id: r for r in got if r.component == c + 1}
        want = (x - s / n) @ v[c] / w[c] ** 0.5
        have = np.array([mine[k].whitened for k in range(len(vectors))])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-10
        assert abs(mine[0].explained - w[c] / trace) < 1e-12 and mine[0].identity_error < 1e-10
        assert [mine[k].deviation for k in range(len(vectors))] == ((n * x - s) ** 2).sum(axis=1).tolist()


def test_sums_beyond_doubles(spark):
    vectors = [[float(2**40 + k * k), float(-(2**38) * k)] for k in range(20)]
    with pytest.raises(Exception, match="does not fit a long"):
        whiten(frame(spark, vectors)).collect()
    small = whiten(frame(spark, [[2.0**21 + k * k, -(2.0**20) * k] for k in range(5)])).collect()
    assert len(small) == 10 and all(r.identity_error < 1e-9 for r in small)
    exact = [[256 * (2**21 + k * k), -256 * 2**20 * k] for k in range(5)]
    sums = [sum(col) for col in zip(*exact)]
    want = [sum((5 * a - b) ** 2 for a, b in zip(e, sums)) for e in exact]
    assert sorted({(r.vec_id, r.deviation) for r in small}) == list(enumerate(want))


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[], []], [[1.0, 2.0]], [[1.0], [1.0]]])
def test_nothing_to_whiten(spark, vectors):
    assert whiten(frame(spark, vectors)).collect() == []


def test_fewer_directions_and_clashing_columns(spark):
    rows = frame(spark, [[1.0, 1.0, 0.0], [2.0, 2.0, 0.0], [5.0, 5.0, 0.0]])
    clash = rows.selectExpr("vec_id", "embedding", "1 AS key", "2 AS w0", "3 AS component", "4 AS n")
    got = clash.transform(whiten).collect()
    assert [r.component for r in got] == [1, 1, 1] and all(abs(r.explained - 1) < 1e-12 for r in got)


def test_many_rows_of_one_vector(spark):
    rows = frame(spark, [[1.0, 2.0]] * 500 + [[3.0, 1.0], [0.0, 5.0]])
    got = whiten(rows).collect()
    assert {r.n for r in got} == {3} and len(got) == 2 * 502


def test_fit_components_without_spread(spark):
    model = fit_components(spark, 2, [4, 6], [[8, 12], [12, 18]], 4, 256)
    assert model.eigenvalues == [] and model.components.shape == (0, 2)

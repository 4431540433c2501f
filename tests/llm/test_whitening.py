"""Exact whitening against numpy's eigenvectors, exact arithmetic, and in edge cases."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from docloom.llm import whitening as W


def test_polynomial_by_remainders_is_the_exact_one(spark):
    rng = random.Random(5)
    for d in (1, 2, 3, 6):
        b = [[rng.randint(-50, 50) for _ in range(d + 1)] for _ in range(d)]
        m = np.array([[sum(x * y for x, y in zip(r, s, strict=True)) for s in b] for r in b], dtype=object)
        # Faddeev and LeVerrier, in fractions.
        c, acc = [Fraction(1)], np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], dtype=object)
        for k in range(1, d + 1):
            prod = m.dot(acc)
            c.append(-sum(prod[i, i] for i in range(d)) / k)
            acc = prod + c[-1] * np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], dtype=object)
        assert W.polynomial(spark, m) == [int(x) for x in reversed(c)]


def test_roots_with_multiplicity_are_isolated():
    poly = [1]
    for root in (7, 7, 7, 1000, 1001, 3, 0, 0):
        poly = [a - root * b for a, b in zip([0, *poly], [*poly, 0], strict=True)]
    found = [(Fraction(at, 1 << bits), k) for at, bits, k in W.largest_roots(poly, 10)]
    assert [k for _, k in found] == [1, 1, 3, 1]
    assert all(abs(x / y - 1) < Fraction(1, 1 << 150) for (x, _), y in zip(found, (1001, 1000, 7, 3), strict=True))
    # x^2 - 2, narrowed far beyond a double.
    (at, bits, _), = W.largest_roots([-2, 0, 1], 1)
    assert abs(Fraction(at, 1 << bits) ** 2 - 2) < Fraction(1, 1 << 150)


def rows_of(spark, vectors):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")


def brute(vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    deviation = [sum(int(v) ** 2 for v in n * r - s) for r in x]
    about = x - s / n
    e, v = np.linalg.eigh(about.T @ about / n)
    return n, deviation, about, e[::-1], v[:, ::-1].T


def test_against_numpy(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(300, 40)) * np.linspace(0.2, 9, 40)).tolist()
    found, own = W.whitened(rows_of(spark, vectors))
    rows = {r["vec_id"]: r for r in found.collect()}
    n, deviation, about, e, v = brute(vectors)
    assert own.n == n and [rows[i]["deviation"] for i in range(n)] == deviation
    assert np.allclose(own.eigenvalues, e[:32], rtol=1e-10) and np.allclose(own.explained, e[:32] / e.sum(), rtol=1e-10)
    assert np.allclose(own.vectors @ own.vectors.T, np.eye(32), atol=1e-14)
    signs = np.sign((own.vectors * v[:32]).sum(axis=1))
    assert np.allclose(own.vectors, v[:32] * signs[:, None], atol=1e-9)
    w = np.array([rows[i]["whitened"] for i in range(n)])
    assert np.allclose(w, about @ own.vectors.T / np.sqrt(e[:32]), atol=1e-8)
    assert W.identity_error(W.usable(rows_of(spark, vectors), "embedding"), own) < 1e-10


def test_equal_and_dependent_eigenvalues(spark):
    # Plus and minus the axes: three equal eigenvalues, one dimension that never changes and one that repeats another.
    axes = [[a * (i == j) for j in range(3)] for i in range(3) for a in (1.0, -1.0)]
    vectors = [[*v, 0.5, v[0]] for v in axes]
    found, own = W.whitened(rows_of(spark, vectors))
    assert len(own.eigenvalues) == 3 and own.eigenvalues[1] == own.eigenvalues[2]
    assert np.allclose(own.vectors @ own.vectors.T, np.eye(3), atol=1e-15)
    assert W.identity_error(W.usable(rows_of(spark, vectors), "embedding"), own) < 1e-12
    assert abs(sum(own.explained) - 1) < 1e-15


def test_large_entries(spark):
    """Entries whose sums no long holds are still summed exactly."""
    rng = np.random.default_rng(8)
    vectors = [[float(np.float32(v)) for v in r] for r in rng.normal(size=(40, 3)) * [1.0, 1e9, 3e15]]
    df = rows_of(spark, vectors)
    n, sums, products = W.moments(W.usable(df, "embedding"))
    x = [[math.floor(64 * v) for v in r] for r in vectors]
    assert n == 40 and sums == [sum(r[i] for r in x) for i in range(3)] and products.tolist() == [[sum(r[i] * r[j] for r in x) for j in range(3)] for i in range(3)]
    found, own = W.whitened(df)
    assert len(own.vectors) == 3 and W.identity_error(W.usable(df, "embedding"), own) < 1e-6
    assert all(r["deviation"] is None for r in found.collect())


def test_exact_products_of_large_entries():
    rng = random.Random(2)
    for most in (10, 1 << 19, 1 << 25, 1 << 39):
        x = np.array([[rng.randint(-most, most) for _ in range(3)] for _ in range(50)])
        assert W.exact_product(x).tolist() == (x.T.astype(object) @ x.astype(object)).tolist()


@pytest.mark.parametrize("rows", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_without_a_component(spark, rows):
    found, own = W.whitened(rows_of(spark, rows))
    kept = [r for r in rows if r]
    assert [r["whitened"] for r in found.collect()] == [[]] * len(kept) and len(own.vectors) == 0 and own.n == len(kept)
    assert W.identity_error(W.usable(rows_of(spark, rows), "embedding"), own) == 0.0


def test_edge_cases(spark):
    good = [[1.0, 2.0], [2.0, 1.0], [2.0, 1.0], [-3.0, 0.5], [0.0, 0.0]]
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0], [1e30, 0.0]]
    data = [(i if i != 1 else None, v, "mine", "mine") for i, v in enumerate(good + bad)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, x string, whitened string")
    found, own = W.whitened(df)
    rows = found.collect()
    assert own.n == 5 and sorted(-1 if r["vec_id"] is None else r["vec_id"] for r in rows) == [-1, 0, 2, 3, 4] and {r["x"] for r in rows} == {"mine"}
    _, deviation, *_ = brute(good)
    assert sorted(r["deviation"] for r in rows) == sorted(deviation)
    assert W.whitened(df.limit(0))[0].count() == 0


def test_query(spark):
    found = W.op11_exact_whitening(spark, "/root/testdata/sf0.001").collect()
    n = {r["n"] for r in found}.pop()
    assert len(found) == 32 * n and {r["component"] for r in found} == set(range(1, 33)) and found[0]["identity_error"] < 1e-4

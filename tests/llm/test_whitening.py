"""Characteristic polynomials, roots and vectors against plain arithmetic; whitening against numpy."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from linelift.llm import charpoly, whitening
from linelift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def exact_polynomial(matrix):
    """Faddeev-LeVerrier in fractions, lowest power first."""
    d = len(matrix)
    a = [[Fraction(v) for v in row] for row in matrix]
    m, out = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][x] * m[x][j] for x in range(d)) + (out[-1] if i == j else 0) for j in range(d)]
             for i in range(d)]
        out.append(-sum(a[i][x] * m[x][i] for i in range(d) for x in range(d)) / k)
    return [int(v) for v in reversed(out)]


@pytest.mark.parametrize("d", [1, 2, 3, 5, 9])
def test_polynomial_is_exact(spark, d):
    rng = random.Random(d)
    for shape in ("full", "sparse", "rank one", "zero"):
        rows = [[{"full": rng.randrange(-10**9, 10**9), "sparse": rng.choice([0, 0, 0, 3]), "zero": 0,
                  "rank one": 2 * (i + 1)}[shape] for i in range(d)] for _ in range(d + 2)]
        matrix = [[sum(r[i] * r[j] for r in rows) for j in range(d)] for i in range(d)]
        assert whitening.characteristic_polynomial(spark, matrix) == exact_polynomial(matrix)


def test_residues_need_other_pivots_modulo_small_primes():
    rng = random.Random(1)
    for _ in range(40):
        m = [[rng.randrange(-6, 7) for _ in range(6)] for _ in range(6)]
        primes = [3, 5, 7, 11]
        want = exact_polynomial(m)
        assert charpoly.residues(m, primes).tolist() == [[v % p for v in want] for p in primes]


def polynomial_of(roots):
    out = [1]
    for r in roots:
        out = [(out[i - 1] if i else 0) - r * (out[i] if i < len(out) else 0) for i in range(len(out) + 1)]
    return out


def test_roots_near_multiple_and_zero():
    big = 10**30
    roots = [0, 0, 3, 3, 3, 7, 1000, big, big + 1, big + 1]
    found = charpoly.largest_roots(polynomial_of(roots), 8)
    assert [(round(r), m) for r, m in found] == [(big + 1, 2), (big, 1), (1000, 1), (7, 1), (3, 3)]
    assert charpoly.largest_roots(polynomial_of([0, 0]), 3) == []
    found = charpoly.largest_roots([1, -3, 1], 2)  # (3 +- sqrt 5) / 2
    for (root, m), sign in zip(found, (1, -1)):
        assert m == 1 and abs((2 * root - 3) ** 2 - 5) < Fraction(1, 1 << 200) and (2 * root - 3 > 0) == (sign > 0)


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for most in (10, 1 << 20, 1 << 30, 1 << 61):
        rows = rng.integers(-most, most, (5000, 3))
        want = [[sum(a * b for a, b in zip(x, y)) for y in rows.T.tolist()] for x in rows.T.tolist()]
        assert whitening.products(rows).tolist() == want
        assert whitening._square_sums(rows >> 2) == [sum(v * v for v in r) for r in (rows >> 2).tolist()]


def brute(vectors, components):
    """{(row, component): (deviation, |whitened|, explained)} by numpy in double precision."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors], np.int64)
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    values, columns = np.linalg.eigh(c.T @ c / n)
    values, columns = values[::-1][:components], columns[:, ::-1][:, :components]
    white = c @ columns / np.sqrt(values)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return deviation, white, values / np.trace(c.T @ c / n)


def check(rows, vectors, components):
    deviation, white, explained = brute([v for _, v in vectors], components)
    place = {i: k for k, (i, _) in enumerate(vectors)}
    assert sorted((r["vec_id"], r["component"]) for r in rows) == sorted(
        (i, k + 1) for i, _ in vectors for k in range(components))
    for k in range(components):
        mine = {r["vec_id"]: r for r in rows if r["component"] == k + 1}
        got = np.array([mine[i]["whitened"] for i, _ in vectors])
        sign = np.sign(got @ white[:, k])
        assert np.abs(got - sign * white[:, k]).max() < 1e-7
        for i, r in mine.items():
            assert r["n"] == len(vectors) and r["deviation"] == deviation[place[i]]
            assert abs(r["explained"] / explained[k] - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    vectors = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in rows]
    check(QUERIES["op12_whitening"](spark, SF).collect(), vectors, 8)


def test_odd_rows(spark):
    rng = random.Random(3)
    good = [(i, [rng.gauss(0, 1), rng.gauss(0, 3) + 1, rng.gauss(0, 0.2)]) for i in range(60)]
    nan, inf = float("nan"), float("inf")
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 1.0, 1.0]), (104, [inf, 1.0, 1.0]),
           (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0])]
    schema = "vec_id long, embedding array<double>, whitened string, n string, i string, deviation string"
    given = spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in good + odd], schema)
    check(whitening.whiten(given).collect(), good, 3)
    assert whitening.whiten(given.limit(0)).collect() == []
    assert whitening.whiten(given.where("vec_id > 100")).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).collect() == []


def test_repeated_eigenvalue_and_repeated_rows(spark):
    corners = [(None, [a, b, 0.0]) for a in (-1.0, 1.0) for b in (-1.0, 1.0)] * 3
    rows = whitening.whiten(spark.createDataFrame(corners, "vec_id long, embedding array<double>")).collect()
    assert len(rows) == 24 and {r["component"] for r in rows} == {1, 2}
    assert all(abs(r["explained"] - 0.5) < 1e-12 and r["identity_error"] < 1e-12 for r in rows)


def test_large_entries(spark):
    rng = random.Random(5)
    vectors = [(i, [rng.uniform(-1, 1) * 2.0**40, rng.uniform(-1, 1) * 2.0**45]) for i in range(50)]
    given = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    check(whitening.whiten(given).collect(), vectors, 2)

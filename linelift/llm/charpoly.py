"""Eigenvalues and eigenvectors of an integer scatter matrix from its exact characteristic polynomial.

- ``residues``: the polynomial modulo many 31-bit primes, by reduction to Hessenberg form,
  for all primes of a call at once.
- ``combine``: the integer coefficients, by Chinese remaindering. A scatter matrix has no
  negative eigenvalue, so each coefficient's size is bounded by its trace.
- ``largest_roots``: isolation in dyadic intervals. All roots are real, so the sign changes of the
  polynomial moved by a count the roots above a exactly; then bisection by the polynomial's
  exact sign.
- ``null_vectors``: inverse iteration at the root in decimal arithmetic of many digits.

All work here is bounded by the matrix's dimension.
"""

from __future__ import annotations

import math
import random
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np

ROOT_BITS = 240
"""Relative precision of a root, as a power of 2."""
SAME_BITS = 200
"""Roots nearer than this (relative, as a power of 2) count as one multiple root."""
DIGITS = 140
"""Decimal digits of the inverse iteration."""


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all n below 2^32."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for base in (2, 3, 5, 7):
        x = pow(base, d, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """The largest primes below 2^31 whose product exceeds ``bound``."""
    out, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def coefficient_bound(trace: int, dimension: int) -> int:
    """No coefficient of the characteristic polynomial of a positive semidefinite matrix exceeds
    this: the k-th elementary symmetric function is at most C(d, k) (trace / d)^k."""
    return max(math.comb(dimension, k) * trace ** k // dimension ** k + 1 for k in range(dimension + 1))


def residues(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo each prime, lowest power first."""
    d, q = len(matrix), np.array(primes, np.int64)
    h = np.array([[[v % p for v in row] for row in matrix] for p in primes], np.int64).reshape(-1, d, d)
    each, p1, p2 = np.arange(len(primes)), q[:, None], q[:, None, None]
    for j in range(d - 2):
        below = h[:, j + 1:, j] != 0
        pivot = below.argmax(axis=1) + j + 1
        top, other = h[each, j + 1].copy(), h[each, pivot].copy()
        h[each, j + 1], h[each, pivot] = other, top
        left, right = h[each, :, j + 1].copy(), h[each, :, pivot].copy()
        h[each, :, j + 1], h[each, :, pivot] = right, left
        inverse = np.array([pow(int(v), -1, p) if v else 0 for v, p in zip(h[:, j + 1, j], primes)], np.int64)
        factor = h[:, j + 2:, j] * inverse[:, None] % p1
        h[:, j + 2:, j:] = (h[:, j + 2:, j:] - factor[:, :, None] * h[:, None, j + 1, j:] % p2) % p2
        h[:, :, j + 1] = (h[:, :, j + 1] + (factor[:, None, :] * h[:, :, j + 2:] % p2).sum(axis=2)) % p1
    poly = np.zeros((d + 1, len(primes), d + 1), np.int64)  # of the leading blocks
    poly[0, :, 0] = 1
    for m in range(1, d + 1):
        new = np.zeros((len(primes), d + 1), np.int64)
        new[:, 1:] = poly[m - 1, :, :-1]
        new -= h[:, m - 1, m - 1, None] * poly[m - 1] % p1
        chain = np.ones(len(primes), np.int64)
        for i in range(1, m):
            chain = chain * h[:, m - i, m - i - 1] % q
            new -= (h[:, m - i - 1, m - 1] * chain % q)[:, None] * poly[m - i - 1] % p1
        poly[m] = new % p1
    return poly[d]


def combine(primes: list[int], rows: list[list[int]]) -> list[int]:
    """The integers of least size with these residues (one row per prime), by a tree of pairs."""
    parts = [(p, list(map(int, r))) for p, r in zip(primes, rows)]
    while len(parts) > 1:
        joined = []
        for (m, a), (n, b) in zip(parts[::2], parts[1::2]):
            inverse = pow(m, -1, n)
            joined.append((m * n, [x + m * ((y - x) * inverse % n) for x, y in zip(a, b)]))
        parts = joined + parts[len(parts) - len(parts) % 2:]
    m, values = parts[0]
    return [v - m if 2 * v > m else v for v in values]


def _above(poly: list[int], at: int) -> int:
    """Roots above the integer ``at``, of a polynomial whose roots are all real."""
    c = list(poly)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _scaled(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2^bits times as large."""
    d = len(poly) - 1
    return [v << bits * (d - k) for k, v in enumerate(poly)]


def _sign(poly: list[int], at: int) -> int:
    value = 0
    for v in reversed(poly):
        value = value * at + v
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], count: int) -> list[tuple[Fraction, int]]:
    """The largest positive roots with their multiplicities, largest first, until ``count`` are
    covered (fewer, if there are fewer). ``poly``: integer coefficients, lowest power first; all
    roots are real and none is negative."""
    zeros = next(k for k, v in enumerate(poly) if v)
    poly = poly[zeros:]
    if len(poly) == 1 or count <= 0:
        return []
    top = 1
    while _above(poly, top):
        top *= 2
    # intervals (low, high] / 2^bits with the roots above each end, upper ones first
    found: list[tuple[Fraction, int]] = []
    stack = [(0, top, 0, len(poly) - 1, 0)]
    scaled: dict[int, list[int]] = {0: poly}
    while stack and sum(m for _, m in found) < count:
        low, high, bits, above_low, above_high = stack.pop()
        inside = above_low - above_high
        if not inside:
            continue
        if bits not in scaled:
            scaled[bits] = _scaled(poly, bits)
        if inside == 1 and low > 0:
            found.append((_refine(poly, low, high, bits), 1))
            continue
        if low > 0 and (high - low) << SAME_BITS <= low:
            found.append((Fraction(low + high, 2 << bits), inside))
            continue
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
            scaled.setdefault(bits, _scaled(poly, bits))
        middle = (low + high) // 2
        above = _above(scaled[bits], middle)
        stack += [(low, middle, bits, above_low, above), (middle, high, bits, above, above_high)]
    return found


def _refine(poly: list[int], low: int, high: int, bits: int) -> Fraction:
    """The single root in (low, high] / 2^bits, by the sign of exact values."""
    more = max(0, ROOT_BITS - low.bit_length())
    low, high, bits = low << more, high << more, bits + more
    p = _scaled(poly, bits)
    if not (upper := _sign(p, high)):
        return Fraction(high, 1 << bits)
    while high - low > 1 and (high - low) << ROOT_BITS > low:
        middle = (low + high) // 2
        sign = _sign(p, middle)
        if not sign:
            return Fraction(middle, 1 << bits)
        low, high = (low, middle) if sign == upper else (middle, high)
    return Fraction(low + high, 2 << bits)


def null_vectors(matrix: list[list[int]], root: Fraction, count: int) -> list[list[Decimal]]:
    """``count`` orthonormal vectors that the matrix multiplies by ``root``."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        value = Decimal(root.numerator) / Decimal(root.denominator)
        a = [[Decimal(v) - value if i == j else Decimal(v) for j, v in enumerate(row)]
             for i, row in enumerate(matrix)]
        tiny = value.scaleb(-DIGITS // 2 - DIGITS // 4)
        order = list(range(d))
        for k in range(d):
            best = max(range(k, d), key=lambda i: abs(a[i][k]))
            a[k], a[best], order[k], order[best] = a[best], a[k], order[best], order[k]
            if abs(a[k][k]) < tiny:
                a[k][k] = tiny
            pivot, row = a[k][k], a[k]
            for i in range(k + 1, d):
                if f := a[i][k]:
                    f = a[i][k] = f / pivot
                    target = a[i]
                    for j in range(k + 1, d):
                        target[j] -= f * row[j]
        rng = random.Random(d)
        vectors = [[Decimal(rng.randrange(1, 1 << 30)) for _ in range(d)] for _ in range(count)]
        for _ in range(4):
            for at, b in enumerate(vectors):
                y: list[Decimal] = []
                for i in range(d):
                    y.append(b[order[i]] - sum((f * v for f, v in zip(a[i], y)), Decimal(0)))
                for i in range(d - 1, -1, -1):
                    y[i] = (y[i] - sum((a[i][j] * y[j] for j in range(i + 1, d)), Decimal(0))) / a[i][i]
                for other in vectors[:at]:
                    dot = sum(u * v for u, v in zip(y, other))
                    y = [u - dot * v for u, v in zip(y, other)]
                size = sum(u * u for u in y).sqrt()
                vectors[at] = [u / size for u in y]
        return vectors

"""Eigenvalues and eigenvectors of a symmetric positive semidefinite integer matrix from its exact characteristic polynomial.

1. The polynomial modulo many 31-bit primes: reduction to Hessenberg form, then its recurrence (``modular``, numpy over a
   batch of primes at once). Batches of primes are tasks of a Spark job (``polynomial``).
2. Chinese remaindering gives its integer coefficients; enough primes are used for Maclaurin's bound on them.
3. All roots are real, so the number of roots above x is exactly the number of sign changes of the polynomial shifted by x
   (Descartes' rule). Bisection on that count isolates every root, multiple ones too, and then refines it (``roots``).
4. Inverse iteration with fixed-point integers of ``FRACTION`` bits next to a root gives the null space of A - root * I
   (``null_space``), for a multiple root an orthonormal basis of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, isqrt

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

#: Relative precision of a root and precision of the elimination, in bits.
PRECISION = 110
FRACTION = 480
BATCH = 16


def _is_prime(n: int) -> bool:
    """Miller-Rabin; these bases decide every n below 3 * 10^9."""
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The largest primes below 2^31, as many as their product needs to exceed ``bound``."""
    found, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def _inverse(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """a^(p-2) modulo p for each prime; 0 for 0."""
    result, e = np.ones_like(a), p - 2
    while e.any():
        result = np.where(e & 1, result * a % p, result)
        a, e = a * a % p, e >> 1
    return result


def modular(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients of det(x I - A) modulo each prime, from x^0 to x^d; one row per prime."""
    d, p = len(matrix), np.array(primes, np.int64)
    m = np.array([[[x % q for x in row] for row in matrix] for q in primes], np.int64).reshape(len(primes), d, d)
    at, one, two = np.arange(len(p)), p[:, None], p[:, None, None]
    for c in range(d - 2):
        r = c + 1
        pivot = r + np.argmax(m[:, r:, c] != 0, axis=1)
        m[at, r], m[at, pivot] = m[at, pivot], m[at, r].copy()
        m[at, :, r], m[at, :, pivot] = m[at, :, pivot], m[at, :, r].copy()
        u = m[:, r + 1 :, c] * _inverse(m[:, r, c], p)[:, None] % one
        m[:, r + 1 :] = (m[:, r + 1 :] - u[:, :, None] * m[:, r, None, :] % two) % two
        m[:, :, r] = (m[:, :, r] + (m[:, :, r + 1 :] * u[:, None, :] % two).sum(axis=2)) % one
    polys = np.zeros((len(p), d + 1, d + 1), np.int64)  # of the leading blocks
    polys[:, 0, 0] = 1
    for k in range(1, d + 1):
        below, product = np.zeros((len(p), k), np.int64), np.ones(len(p), np.int64)
        for i in range(k - 1, -1, -1):  # entry (i, k-1) times the subdiagonal between
            below[:, i] = m[:, i, k - 1] * product % p
            if i:
                product = product * m[:, i, i - 1] % p
        taken = (below[:, :, None] * polys[:, :k] % two).sum(axis=1)
        polys[:, k, 1:] = polys[:, k - 1, :-1]
        polys[:, k] = (polys[:, k] - taken) % one
    return polys[:, d]


def polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x I - A) from x^d down, for A symmetric and positive semidefinite."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # the k-th one is at most C(d, k) * (trace / d)^k in size
    bound = max(comb(d, k) * (trace**k // d**k + 1) for k in range(d + 1))
    primes = primes_beyond(bound)
    shared, parts = spark.sparkContext.broadcast((matrix, primes)), -(-len(primes) // BATCH)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, every = shared.value
        for frame in frames:
            for part in frame["id"].tolist():
                some = every[part * BATCH : (part + 1) * BATCH]
                yield pd.DataFrame({"prime": some, "rest": list(modular(rows, some))})

    got = {r["prime"]: r["rest"] for r in spark.range(0, parts, 1, parts).mapInPandas(run, "prime long, rest array<long>").collect()}
    whole = 1
    for p in primes:
        whole *= p
    weights = [(p, whole // p * pow(whole // p, -1, p)) for p in primes]
    # coefficients have alternating signs; their sizes lie in 0 .. bound
    return [(-1) ** k * ((-1) ** k * sum(got[p][d - k] * w for p, w in weights) % whole) for k in range(d + 1)]


class _Scaled:
    """The polynomial whose roots are 2^bits times those of ``coefficients``."""

    def __init__(self, coefficients: list[int], bits: int):
        self.c = [x << (bits * k) for k, x in enumerate(coefficients)]

    def above(self, x: int) -> int:
        """Number of roots above x: sign changes after a shift by x."""
        c = list(self.c)
        for stop in range(len(c) - 1, 0, -1):
            for i in range(1, stop + 1):
                c[i] += x * c[i - 1]
        signs = [v > 0 for v in c if v]
        return sum(a != b for a, b in zip(signs, signs[1:]))

    def sign(self, x: int) -> int:
        value = 0
        for v in self.c:
            value = value * x + v
        return (value > 0) - (value < 0)


def roots(coefficients: list[int], wanted: int, precision: int = PRECISION) -> list[tuple[int, int]]:
    """The largest positive roots, falling, each as (a, bits): it lies in (a, a + 1] / 2^bits. Multiple roots repeat."""
    d = len(coefficients) - 1
    positive = max(k for k, c in enumerate(coefficients) if c)  # roots that are not 0
    top = -coefficients[1] if d else 0
    scaled = {0: _Scaled(coefficients, 0)}
    counted: dict[int, int] = {0: positive, top: 0}
    found: list[tuple[int, int]] = []
    while len(found) < min(wanted, positive):
        j = len(found) + 1
        low = max(x for x, n in counted.items() if n >= j)
        high = min(x for x, n in counted.items() if n < j)
        bits, n_low, n_high = 0, counted[low], counted[high]
        while high - low > 1 or low.bit_length() <= precision:
            if high - low == 1:
                bits += 32
                low, high = low << 32, high << 32
            if bits not in scaled:
                scaled[bits] = _Scaled(coefficients, bits)
            middle = (low + high) // 2
            if n_low - n_high == 1:  # one root inside: the sign alone tells the side
                sign = scaled[bits].sign(middle)
                n = n_high if sign == 0 or (sign > 0) == (n_high % 2 == 0) else n_low
            else:
                n = scaled[bits].above(middle)
            if not bits:
                counted[middle] = n
            if n >= j:
                low, n_low = middle, n
            else:
                high, n_high = middle, n
        found += [(low, bits)] * min(n_low - n_high, wanted - len(found))
    return found


def null_space(matrix: list[list[int]], root: tuple[int, int], size: int) -> list[list[float]]:
    """Orthonormal vectors, ``size`` of them, that A maps to root times themselves."""
    d, (a, bits) = len(matrix), root
    unit = max(1, max(abs(x) for row in matrix for x in row))
    e = np.array([[((x << bits) - (a if i == j else 0)) * (1 << FRACTION) // (unit << bits) for j, x in enumerate(row)] for i, row in enumerate(matrix)], object).reshape(d, d)
    order = np.arange(d)
    for k in range(d):
        pivot = k + int(np.argmax(np.abs(e[k:, k])))
        if pivot != k:
            e[[k, pivot]], order[[k, pivot]] = e[[pivot, k]], order[[pivot, k]]
        if not e[k, k]:
            e[k, k] = 1
        if k + 1 < d:
            e[k + 1 :, k] = (e[k + 1 :, k] << FRACTION) // e[k, k]
            e[k + 1 :, k + 1 :] -= (e[k + 1 :, k][:, None] * e[k, k + 1 :][None, :]) >> FRACTION

    def solve(b: np.ndarray) -> np.ndarray:
        b = b[order].copy()
        for k in range(d - 1):
            b[k + 1 :] -= (e[k + 1 :, k] * b[k]) >> FRACTION
        for k in range(d - 1, -1, -1):
            b[k] = (b[k] << FRACTION) // e[k, k]
            if k:
                b[:k] -= (e[:k, k] * b[k]) >> FRACTION
        return b

    def unit_length(v: np.ndarray) -> np.ndarray:
        return (v << FRACTION) // max(1, isqrt(int((v * v).sum())))

    rng = np.random.default_rng(11)
    basis = [np.array([int(x) << FRACTION for x in rng.integers(-999, 1000, d)], object) for _ in range(size)]
    for _ in range(4):
        done: list[np.ndarray] = []
        for v in basis:
            v = unit_length(solve(v))
            for _ in range(2):
                for w in done:
                    v = v - ((w * (int((v * w).sum()) >> FRACTION)) >> FRACTION)
                v = unit_length(v)
            done.append(v)
        basis = done
    result = []
    for v in basis:
        lead = max(range(d), key=lambda i: (abs(v[i]), -i))
        result.append([int(x) * (1 if v[lead] > 0 else -1) / (1 << FRACTION) for x in v])
    return result


def largest(spark: SparkSession, matrix: list[list[int]], wanted: int) -> list[tuple[tuple[int, int], list[float]]]:
    """(root, unit vector) of the largest positive eigenvalues, falling."""
    if not any(matrix[i][i] for i in range(len(matrix))):
        return []
    found = roots(polynomial(spark, matrix), wanted)
    result = []
    for root in dict.fromkeys(found):
        result += [(root, v) for v in null_space(matrix, root, found.count(root))]
    return result

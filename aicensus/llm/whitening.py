"""Embedding whitening from the exact characteristic polynomial of the integer scatter.

Entries become integers x = floor(256 c). The distinct vectors, their number n, sums S and products are counted exactly
by the tasks, so the scatter n * sum(x x') - S S' is an exact integer matrix (n^2 times the covariance). Its characteristic
polynomial comes from Hessenberg reduction modulo enough primes below 2^31, spread over tasks, and Chinese remaindering;
the number of primes follows from a bound on the coefficients that holds for every such matrix. All roots are real, so the
sign variations of the shifted polynomial count the roots above a point exactly, multiplicities included; bisection with
integers isolates the largest roots to ``BITS`` bits. A component is found by inverse iteration with the shifted matrix in
fixed-point numbers of that precision; roots of multiplicity m give m orthonormal vectors.

The driver holds the matrix, the residues and ``count`` components: their size depends on the dimension only, which must
not exceed ``max_dim``. Vectors stay in Spark.

Defined results: rows whose vector is null or has null or non-finite entries are dropped, and so are rows whose length is not
the most frequent one (the larger of two equally frequent ones); repeated rows and repeated vectors stay, the fit counts a
vector once; entries beyond the range of long are cut to it; a null id is kept. Only components of positive variance exist,
so fewer than ``count`` may be returned and none for a single distinct vector. ``deviation`` is null beyond the range of long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import stored

BITS = 128
DIGIT = 20  # products of two digits, 4096 of them added, are exact in a double
LIMBS = 7


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * 256) + F.lit(0).cast("long"))


def usable(vector: Column) -> Column:
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def clean_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x of the rows that stay."""
    return rows.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), quantised(F.col(vector_col)).alias("x"))


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def digits_of(x: np.ndarray) -> list[np.ndarray]:
    """Signed digits to the base 2^DIGIT, lowest first, as doubles."""
    out = []
    while True:
        if not x.size or (x.max() < 1 << DIGIT and x.min() > -(1 << DIGIT)):
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << DIGIT) - 1)).astype(np.float64))
        x = x >> DIGIT


def gram(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers; ``x`` has 4096 rows at most."""
    digits = digits_of(x)
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for i, a in enumerate(digits):
        for j, b in enumerate(digits):
            total += (a.T @ b).astype(np.int64).astype(object) << DIGIT * (i + j)
    return total


def exact_moments(fit: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """n, S and the sums of products over the fit list."""
    pairs = [(i, j) for i in range(dim + 1) for j in range(i, dim + 1)]
    names = [f"l{k}" for k in range(LIMBS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1), object)
        for batch in batches:  # a column of ones in front gives the count and the sums as well
            x = matrix_of(batch.column(0), dim)
            x = np.hstack([np.ones((len(x), 1), np.int64), x])
            for k in range(0, len(x), 4096):
                total += gram(x[k:k + 4096])
        limbs = [[], *([] for _ in names)]
        for at, (i, j) in enumerate(pairs):
            value = int(total[i, j])
            limbs[0].append(at)
            for k in range(LIMBS):  # the last limb carries the sign
                limbs[k + 1].append(value & 0xFFFFFFFF if k < LIMBS - 1 else value)
                value >>= 32
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in limbs], names=["at", *names])

    summed = fit.select("x").mapInArrow(run, "at long, " + ", ".join(f"{k} long" for k in names)).groupBy("at").agg(
        *(F.sum(k).alias(k) for k in names)).collect()
    whole = np.zeros((dim + 1, dim + 1), object)
    for r in summed:
        i, j = pairs[r["at"]]
        whole[i, j] = whole[j, i] = sum(r[k] << 32 * e for e, k in enumerate(names))
    return int(whole[0, 0]), [int(v) for v in whole[0, 1:]], whole[1:, 1:]


def is_prime(n: int) -> bool:
    """Exact below 3.4e14 with these bases."""
    for p in (2, 3, 5, 7, 11, 13, 17):
        if n % p == 0:
            return n == p
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13, 17):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """Primes downwards from 2^31 whose product exceeds ``bound``."""
    found, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(y I - matrix) modulo p, lowest first, by Hessenberg reduction."""
    d = len(matrix)
    h = np.array(matrix % p, np.int64)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factor = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - factor[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * factor % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - h[k - 1, k - 1] * polys[k - 1]) % p
        step = 1
        for i in range(k - 2, -1, -1):
            step = step * int(h[i + 1, i]) % p
            if not step:
                break
            polys[k] = (polys[k] - step * int(h[i, k - 1]) % p * polys[i]) % p
    return polys[d]


def characteristic_polynomial(spark, matrix: np.ndarray) -> list[int]:
    """Coefficients of det(y I - matrix), lowest first, of a positive semidefinite integer matrix; primes are tasks."""
    d, trace = len(matrix), int(sum(matrix.diagonal()))
    # The k-th coefficient is a symmetric function of roots >= 0 with a known sum: binom(d, k) (trace / d)^k at most.
    bound = max(math.comb(d, k) * trace ** k // d ** k + 1 for k in range(d + 1))
    primes = primes_for(2 * bound + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([polynomial_modulo(matrix, primes[i]) for i in at], pa.list_(pa.int64()))],
                names=["id", "residues"])

    tasks = spark.range(0, len(primes), 1, min(len(primes), 4 * spark.sparkContext.defaultParallelism))
    residues = dict(tuple(r) for r in tasks.mapInArrow(run, "id long, residues array<long>").collect())
    product = math.prod(primes)
    out = [0] * (d + 1)
    for i, p in enumerate(primes):
        rest = product // p
        unit = rest * pow(rest % p, -1, p)
        for k, r in enumerate(residues[i]):
            out[k] += r * unit
    return [v % product if v % product <= product // 2 else v % product - product for v in out]


def roots_above(poly: list[int], point: int) -> int:
    """The number of roots above a point, with multiplicity; exact as all roots are real."""
    shifted = list(poly)
    for i in range(len(poly) - 1):
        for j in range(len(poly) - 2, i - 1, -1):
            shifted[j] += point * shifted[j + 1]
    signs = [v > 0 for v in shifted if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def value_at(poly: list[int], point: int) -> int:
    total = 0
    for c in reversed(poly):
        total = total * point + c
    return total


def largest_roots(poly: list[int], count: int) -> list[tuple[int, int, int]]:
    """(numerator, scale, multiplicity) of the largest positive roots, numerator / 2^scale from above, largest first."""
    degree = len(poly) - 1
    zero = next(i for i, c in enumerate(poly) if c)
    found, taken, scale = [], 0, BITS
    while taken < min(count, degree - zero):
        scaled = [c << scale * (degree - k) for k, c in enumerate(poly)]
        # Newton's sum: the roots are not negative, so none exceeds their sum.
        low, high, at_low, at_high = 0, 1 - scaled[-2], degree - zero, 0
        while high - low > 1:
            middle = (low + high) // 2
            if at_low - at_high == 1:  # one root left: the sign tells on which side it is
                value = value_at(scaled, middle)
                above = at_high + (value != 0 and (value < 0) != (at_high % 2 == 1))
            else:
                above = roots_above(scaled, middle)
            if above > taken:
                low, at_low = middle, above
            else:
                high, at_high = middle, above
        if high.bit_length() < BITS:  # a small root: more bits behind the point
            scale += BITS
            continue
        found.append((high, scale, at_low - at_high))
        taken = at_low
    return found


def null_vectors(matrix: np.ndarray, numerator: int, scale: int, count: int) -> list[list[int]]:
    """Orthogonal integer vectors (fixed-point) that span the null space of ``matrix - numerator / 2^scale``."""
    d = len(matrix)
    point = max(int(abs(v)).bit_length() for v in matrix.flat) + 2 * BITS  # binary places of all numbers below
    u = (matrix << point) - (np.eye(d, dtype=object) * (numerator << point >> scale))
    order, lower = list(range(d)), np.zeros((d, d), object)
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(u[i, k]))
        for a in (u, lower):
            a[[k, best]] = a[[best, k]]
        order[k], order[best] = order[best], order[k]
        if not u[k, k]:
            u[k, k] = 1  # an exact null space: the smallest number instead of zero
        if k + 1 < d:
            lower[k + 1:, k] = (u[k + 1:, k] << point) // u[k, k]
            u[k + 1:, k:] -= (lower[k + 1:, k][:, None] * u[k, k:][None, :]) >> point

    def solve(b: np.ndarray) -> np.ndarray:
        y = b[order].copy()
        for k in range(d):
            y[k + 1:] -= (lower[k + 1:, k] * y[k]) >> point
        for k in range(d - 1, -1, -1):
            y[k] = (y[k] << point) // u[k, k]
            y[:k] -= (u[:k, k] * y[k]) >> point
        return y

    def scaled(v: np.ndarray) -> np.ndarray:
        length = math.isqrt(int((v * v).sum())) or 1
        return (v << point) // length

    found: list[np.ndarray] = []
    for m in range(count):
        v = scaled(np.array([((i + 1) * (2 * m + 3) * 7919 + i * i * 104729) % 1009 - 504 for i in range(d)], object) << point)
        for _ in range(4):
            v = scaled(solve(v))
            for w in found:
                v = v - w * int((v * w).sum() >> point) // (1 << point)
            v = scaled(v)
        found.append(v)
    return [[int(x) for x in v] for v in found]


def components(spark, matrix: np.ndarray, count: int) -> list[tuple[Fraction, np.ndarray]]:
    """(eigenvalue, unit vector) of the largest positive eigenvalues of an exact integer scatter, largest first."""
    shrink = math.gcd(*(int(v) for v in matrix.flat))
    if not shrink:
        return []
    small = matrix // shrink
    found = []
    for numerator, scale, multiplicity in largest_roots(characteristic_polynomial(spark, small), count):
        for v in null_vectors(small, numerator, scale, min(multiplicity, count - len(found))):
            length = math.isqrt(sum(x * x for x in v))
            found.append((Fraction(numerator * shrink, 1 << scale), np.array([float(Fraction(x, length)) for x in v])))
    return found


def projected(rows: DataFrame, dim: int, n: int, sums: list[int], weights: np.ndarray) -> DataFrame:
    """The rows (vec_id, x) with deviation and whitened, one entry a component."""
    mean = np.array([float(Fraction(s, n)) for s in sums])
    kind = rows.schema["vec_id"].dataType.simpleString()

    def deviations(x: np.ndarray) -> list[int | None]:
        reach = n * max(int(x.max()), -int(x.min()), 0) + max(map(abs, sums))
        if dim * reach * reach < 1 << 63:
            return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(1), dim)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(deviations(x), pa.int64()), pa.array(list((x - mean) @ weights.T), pa.list_(pa.float64()))],
                    names=["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, count: int = 4, max_dim: int = 1024) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every row and component."""
    spark = rows.sparkSession
    ship_package(spark)
    clean = clean_vectors(rows, id_col, vector_col)
    kind = clean.schema["vec_id"].dataType.simpleString()
    nothing = spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, "
                                        "explained double, identity_error double")
    usual = clean.groupBy(F.size("x").alias("dim")).count().agg(F.max(F.struct("count", "dim"))["dim"]).first()[0]
    if not usual:
        return nothing
    if usual > max_dim:
        raise ValueError(f"vectors of {usual} entries; max_dim is {max_dim}")
    clean = clean.filter(F.size("x") == usual)
    fit = stored(clean.groupBy("x").agg(F.lit(0).alias("vec_id")), "whitening-fit")
    n, sums, products = exact_moments(fit, usual)
    scatter = n * products - np.outer(np.array(sums, object), np.array(sums, object))
    found = components(spark, scatter, count)
    if not found:
        return nothing
    trace = int(sum(scatter.diagonal()))
    weights = np.array([v / math.sqrt(e / n ** 2) for e, v in found])
    explained = [float(e / trace) for e, _ in found]
    size = len(found)
    each = projected(fit, usual, n, sums, weights).select(*(F.col("whitened")[k].alias(f"w{k}") for k in range(size)))
    cells = [F.abs(F.covar_pop(f"w{i}", f"w{j}") - int(i == j)) for i in range(size) for j in range(i, size)]
    error = max(each.agg(*cells).first())
    return projected(clean, usual, n, sums, weights).select(
        "vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*map(F.lit, explained))[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"))

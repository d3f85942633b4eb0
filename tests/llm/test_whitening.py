import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from aicensus.llm.whitening import characteristic_polynomial, components, gram, largest_roots, polynomial_modulo, roots_above, whiten
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def frame(spark, rows):
    rows = [(i, v if v is None else [c if c is None else float(c) for c in v]) for i, v in rows]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return data.withColumns({c: F.lit(1) for c in ("x", "n", "component", "label", "whitened")})


def direct(rows):
    """x of every good row, n, S and the covariance of the distinct vectors with integers."""
    good = [(i, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({x for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    scatter = [[n * sum(x[i] * x[j] for x in fit) - sums[i] * sums[j] for j in range(len(sums))] for i in range(len(sums))]
    return good, n, sums, np.array(scatter, object)


def test_against_a_direct_solution(spark):
    rng = np.random.default_rng(1)
    spread = np.array([3.0, 2.0, 1.5, 1.0, 0.5, 0.25])
    rows = [(i, (rng.normal(size=6) * spread).tolist()) for i in range(400)]
    rows += rows[:50] + [(None, rows[3][1]), (900, None), (901, [1.0, None, 0, 0, 0, 0]), (902, [NAN] * 6), (903, [INF, 0, 0, 0, 0, 0]),
                         (904, [1.0, 2.0]), (905, [])]
    got = whiten(frame(spark, rows)).collect()
    good, n, sums, scatter = direct([r for r in rows if r[0] not in (904, 905)])
    assert Counter((r["vec_id"], r["component"], r["deviation"]) for r in got) == Counter(
        (i, k, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in good for k in (1, 2, 3, 4))
    values, vectors = np.linalg.eigh(scatter.astype(float) / n ** 2)
    by = {(r["vec_id"], r["component"]): r for r in got}
    for k in range(4):
        e, v = values[-1 - k], vectors[:, -1 - k]
        want = np.array([(np.array(x) - np.array(sums) / n) @ v / np.sqrt(e) for _, x in good[:400]])
        have = np.array([by[i, k + 1]["whitened"] for i, _ in good[:400]])
        assert min(abs(want - have).max(), abs(want + have).max()) < 1e-9
        assert by[0, k + 1]["explained"] == pytest.approx(e / values.sum(), rel=1e-10)
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-10


def test_multiple_and_zero_roots(spark):
    """Equal variances in three directions, none in the others."""
    unit = np.eye(5)
    rows = [(i, (s * unit[i]).tolist()) for i in range(3) for s in (1.0, -1.0)]
    got = whiten(frame(spark, rows)).collect()
    assert {r["component"] for r in got} == {1, 2, 3} and max(r["identity_error"] for r in got) < 1e-10
    assert {round(r["explained"], 12) for r in got} == {round(1 / 3, 12)}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    assert whiten(frame(spark, rows)).count() == 0


def test_huge_entries(spark):
    rows = [(1, [3e38, 1.0]), (2, [-3e38, 0.0]), (3, [0.0, 1e30])]
    got = whiten(frame(spark, rows)).collect()
    assert {r["deviation"] for r in got} == {None} and max(r["identity_error"] for r in got) < 1e-6


def test_wide_vectors_are_refused(spark):
    with pytest.raises(ValueError):
        whiten(frame(spark, [(1, [0.0] * 5)]), max_dim=4)


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for reach in (5, 1 << 19, 1 << 33, 1 << 62):
        x = rng.integers(-reach, reach, (50, 3))
        assert (gram(x) == x.astype(object).T @ x.astype(object)).all()


def test_polynomial_and_roots(spark):
    random.seed(1)
    a = np.array([[random.randrange(-9, 9) for _ in range(7)] for _ in range(5)], object)
    square = a.T @ a  # rank 5 of 7
    poly = characteristic_polynomial(spark, square)
    values = np.linalg.eigvalsh(square.astype(float))[::-1]
    assert np.allclose([float(c) for c in poly], np.poly(values)[::-1], rtol=1e-6, atol=0.01) and poly[:2] == [0, 0]
    assert [roots_above(poly, k) for k in range(0, 200, 7)] == [int((values > k + 1e-9).sum()) for k in range(0, 200, 7)]
    assert [m for *_, m in largest_roots(poly, 9)] == [1] * 5
    p = 10007
    assert polynomial_modulo(square, p).tolist() == [c % p for c in poly]
    # (y - 5)^2 (y - 3) (y - 1/2^0): exact multiplicities
    exact = [1]
    for root in (5, 5, 3, 1):
        exact = [a - root * b for a, b in zip([0, *exact], [*exact, 0])]
    assert [(Fraction(n, 1 << s), m) for n, s, m in largest_roots(exact, 4)] == [(5, 2), (3, 1), (1, 1)]


def test_close_roots(spark):
    """Eigenvalues that doubles cannot tell apart still give the right vectors."""
    big = 10 ** 20
    matrix = np.array([[big, 1, 0], [1, big, 0], [0, 0, 5]], object)
    (e1, v1), (e2, v2), (e3, v3) = components(spark, matrix, 3)
    assert round(e1) == big + 1 and round(e2) == big - 1 and round(e3) == 5
    r = 0.5 ** 0.5
    assert np.allclose(abs(v1), [r, r, 0]) and np.allclose(abs(v2), [r, r, 0]) and abs(v1 @ v2) < 1e-15
    assert np.allclose(abs(v3), [0, 0, 1])

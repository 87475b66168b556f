import math

import numpy as np
import pytest

from scoretide.llm.whitening import bidiagonal, singular_values, twisted_vectors, whiten


def matrices():
    rng = np.random.default_rng(3)
    for k in range(60):
        d = int(rng.integers(1, 40))
        m = rng.normal(size=(d + 5, d))
        if k % 6 == 1:
            m *= np.exp(5 * rng.normal(size=d))
        elif k % 6 == 2:
            m[:, rng.integers(d)] = 0
        elif k % 6 == 3:
            m = np.diag(rng.integers(1, 3, size=d).astype(float))
        elif k % 6 == 4:
            m = np.linalg.qr(m)[0]
        elif k % 6 == 5:
            m[:, : d // 2] = m[:, d // 2 : d // 2 + 1] if d > 1 else m
        yield m


def test_solver_against_dense_decomposition():
    for m in matrices():
        a, b, v = bidiagonal(np.linalg.qr(m, mode="r"))
        values, exact = singular_values(a, b), np.linalg.svd(m, compute_uv=False)
        top = max(exact[0], 1e-300)
        assert np.abs(values - exact).max() <= 1e-13 * top * math.sqrt(len(a))
        k = min(4, int((exact > 1e-10 * top).sum()))
        z = v @ twisted_vectors(a, b, values[:k])
        assert np.abs(z.T @ z - np.eye(k)).max(initial=0) < 1e-12
        assert np.abs(m.T @ m @ z - z * values[:k] ** 2).max(initial=0) < 1e-12 * top**2


def test_small_values_are_relatively_exact():
    a = np.array([1.0, 1e-6, 1e-12, 1e-18])
    b = np.array([1.0, 1e-6, 1e-12])
    product = np.prod(singular_values(a, b))  # the determinant
    assert product == pytest.approx(np.prod(a), rel=1e-12)


def expected(rows, k=4):
    from fractions import Fraction

    ok = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in ok})
    n, d = len(fit), len(fit[0])
    total = [sum(x[j] for x in fit) for j in range(d)]
    far = np.array([[float(Fraction(n * x[j] - total[j], n)) for j in range(d)] for x in fit])
    e, v = np.linalg.eigh(far.T @ far / n)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for i, x in ok:
        c = np.array([(n * x[j] - total[j]) / n for j in range(d)])
        deviation = sum((n * x[j] - total[j]) ** 2 for j in range(d))
        out.setdefault((i, deviation), c @ v[:, :k] / np.sqrt(e[:k]))
    return out, n, e


def check(got, rows, k=4):
    out, n, e = expected(rows, k)
    signs = {}
    assert {(r.vec_id, r.deviation) for r in got} == set(out)
    for r in got:
        want = out[r.vec_id, r.deviation][r.component - 1]
        if abs(want) > 1e-6:
            assert signs.setdefault(r.component, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert abs(abs(r.whitened) - abs(want)) < 1e-8
        assert r.n == n and r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
        assert r.identity_error < 1e-9


def test_query_equals_dense_solution(spark, sf):
    from scoretide.llm.queries import QUERIES

    got = QUERIES["op11_whitening"](spark, sf)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = got.collect()
    assert len(got) == 4 * len(rows)
    check(got, rows)


def test_many_partitions_and_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(300)] + [(None, rows[4][1]), (7, rows[7][1])]
    odd = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [math.nan] * 6), (904, [math.inf] + [0.0] * 5), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(40)
    for c in ("id", "x", "n", "white", "place"):
        df = df.withColumn(c, df["vec_id"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = whiten(df).collect()  # 40 triangles: two levels of the tree
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 4 * len(rows)
    check(got, rows)


def test_few_vectors_and_large_numbers(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whiten(make([])).count() == 0 and whiten(make([(1, None)])).count() == 0
    assert whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    two = whiten(make([(1, [1.0, 2.0]), (2, [3.0, 2.5])])).collect()
    assert [(r.component, round(abs(r.whitened), 9)) for r in two] == [(1, 1.0), (1, 1.0)]
    rows = [(k, [float(2**12 * (k % 5) + k), float(-(2**12) * (k % 3))]) for k in range(30)]
    check(whiten(make(rows)).collect(), rows, 2)
    minus = whiten(make([(1, [-0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])])).collect()
    assert {r.n for r in minus} == {2}
    with pytest.raises(Exception, match="large|bits|overflow|convert"):
        whiten(make([(1, [1e13, 2.0]), (2, [-1e13, 2.5]), (3, [0.0, 1.0])])).collect()

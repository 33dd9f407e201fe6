"""Matrices against NumPy, plastic states and codebooks against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import hdc, learning, linalg


def cells(spark, matrices, first="matrix"):
    rows = [(m, int(i), int(j), float(a[i, j])) for m, a in enumerate(matrices) for i, j in np.ndindex(*a.shape)]
    df = spark.createDataFrame(rows, f"{first} long, i long, j long, v double").repartition(3)
    return df if len(matrices) > 1 else df.drop(first)


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.i, r.j] = r.v
    return out


def part(df, name, m, shape):
    return dense(df.where((F.col("part") == name) & (F.col("matrix") == m)), shape)


def test_products(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(7, 5)), rng.normal(size=(5, 6))
    left, right = cells(spark, [a]), cells(spark, [b])
    for grid in (1, 3):
        assert np.allclose(dense(linalg.gemm(left, right, 2.0, grid=grid), (7, 6)), 2 * a @ b)
    c = rng.normal(size=(7, 6))
    assert np.allclose(dense(linalg.gemm(left, right, 1.0, -0.5, cells(spark, [c])), (7, 6)), a @ b - 0.5 * c)
    assert np.allclose(dense(linalg.mirror(linalg.syrk(left)), (7, 7)), a @ a.T)
    s = a.T @ a
    assert np.allclose(dense(linalg.symm(cells(spark, [np.triu(s)]).where("i <= j"), right), (5, 6)), s @ b)


def test_factors_and_solutions(spark):
    rng = np.random.default_rng(2)
    a = [rng.normal(size=(6, 6)) for _ in range(2)]
    spd = [x @ x.T + np.eye(6) for x in a] + [-np.eye(6)]
    low = linalg.cholesky(cells(spark, spd)).cache()
    for m in (0, 1):
        assert np.allclose(part(low, "l", m, (6, 6)), np.linalg.cholesky(spd[m]))
    assert {(r.info, r.v) for r in low.where("matrix = 2").collect()} == {(1, None)}
    qr = linalg.qr(cells(spark, a)).cache()
    for m in (0, 1):
        q, r = part(qr, "q", m, (6, 6)), part(qr, "r", m, (6, 6))
        assert np.allclose(q @ r, a[m]) and np.allclose(q.T @ q, np.eye(6)) and np.allclose(r, np.triu(r))
    rhs = [rng.normal(size=(6, 2)) for _ in a]
    both = cells(spark, [np.hstack([x, y]) for x, y in zip(a, rhs, strict=True)])
    x = linalg.solve(both, 2).cache()
    tri = linalg.solve_triangular(cells(spark, [np.hstack([np.tril(x_), y]) for x_, y in zip(a, rhs, strict=True)]), 2).cache()
    for m in (0, 1):
        assert np.allclose(part(x, "x", m, (6, 2)), np.linalg.solve(a[m], rhs[m]))
        assert np.allclose(part(tri, "x", m, (6, 2)), np.linalg.solve(np.tril(a[m]), rhs[m]))


def test_tall_tables(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5)) @ np.diag([1, 2, 3, 4, 50.0])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, x array<double>").repartition(4)
    q, r = linalg.tall_qr(df, "x", 5, "k")
    q = np.array([row.q for row in q.orderBy("id").collect()])
    assert np.allclose(q @ r, x) and np.allclose(q.T @ q, np.eye(5), atol=1e-12)
    assert abs(linalg.condition_number(df, "x", 5) / np.linalg.cond(x) - 1) < 1e-6
    flat = df.withColumn("x", F.transform("x", lambda v: F.lit(1.0)))
    with pytest.raises(np.linalg.LinAlgError):
        linalg.tall_qr(flat, "x", 5, "k")


def soak(evidence, theta):
    """The rule again, in integers."""
    e, t, m = 0, theta, 0
    for v in evidence:
        if v == 0:
            continue
        size = abs(e)
        phi = v
        if t // 2 < size <= t:
            phi = -((e > 0) - (e < 0)) * max(1, abs(v) // 2)
        delta = int(phi * (16 - m) / 16)
        e, t = max(-128, min(127, e + delta)), max(0, min(255, t + max(-2, min(2, size - t))))
        m += delta != 0 and m < 15
    return e, t, m


def test_plastic_states(spark):
    rng = random.Random(4)
    rows = [(i, [rng.randrange(-128, 128) for _ in range(rng.randrange(0, 40))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<int>")
    for theta in (0, 20):
        got = {r.id: (r.s.efficacy, r.s.theta, r.s.maturity) for r in df.select("id", learning.soak(F.col("v"), theta).alias("s")).collect()}
        assert got == {i: soak(v, theta) for i, v in rows}


def test_nearest_entry(spark):
    rng = random.Random(6)
    book = [(f"e{i:03}", [rng.getrandbits(62), -rng.getrandbits(62)]) for i in range(150)]
    book.append(("e000b", book[7][1]))  # a tie: the smaller name wins
    probes = [(i, [rng.getrandbits(62), rng.getrandbits(62)]) for i in range(40)] + [(99, book[7][1])]
    d = lambda a, b: sum(((x ^ y) & ((1 << 64) - 1)).bit_count() for x, y in zip(a, b, strict=True))
    codes = spark.createDataFrame(book, "entry string, fp array<bigint>")
    got = {r.id: (r.d, r.entry) for r in hdc.nearest_entry(spark.createDataFrame(probes, "id long, fp array<bigint>"), codes, 2).collect()}
    assert got == {i: min((d(p, fp), name) for name, fp in book) for i, p in probes}
    none = hdc.nearest_entry(spark.createDataFrame(probes, "id long, fp array<bigint>"), codes.limit(0), 2).first()
    assert none.entry is None and none.d is None
    with pytest.raises(ValueError, match="codebook"):
        hdc.nearest_entry(codes.withColumnRenamed("entry", "id"), codes, 2, max_entries=3)

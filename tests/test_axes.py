"""Leading axes against a dense decomposition."""

import os

import numpy as np
import pytest

from tessella.operators import axes


def cells(spark, m):
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m)) if m[i, j]], "i int, j int, w double").repartition(3)


def check(found, m, k, limit=1e-6):
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-np.abs(values), kind="stable")[:k]
    assert np.abs(np.array(found.values) - values[order]).max() < limit
    rows = {r.i: r for r in found.vectors.collect()}
    for n, o in enumerate(order):
        mine = np.array([rows[i][f"a{n}"] if i in rows else 0.0 for i in range(len(m))])
        want = vectors[:, o] * np.sign(vectors[:, o] @ mine)
        assert np.abs(mine - want).max() < limit and mine[np.argmax(np.abs(mine))] > 0


def test_planted_axes_of_both_signs(spark):
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    m = q @ np.diag([9, -7, 5, *rng.uniform(-1, 1, 61)]) @ q.T
    found = axes.crystallize(cells(spark, m))
    assert found.rounds < 40 and max(found.errors) < 1e-6
    check(found, m, 3)


def test_low_rank_and_empty(spark):
    v = np.array([3.0, 0, 4, 0, 0])
    found = axes.crystallize(cells(spark, np.outer(v, v)))
    assert len(found.values) == 1 and abs(found.values[0] - 25) < 1e-9
    check(found, np.outer(v, v), 1)
    none = axes.crystallize(cells(spark, np.zeros((2, 2))))
    assert none.values == [] and none.vectors.collect() == [] and axes.grid(cells(spark, np.zeros((2, 2))), none).collect() == []


def test_correlation_and_grid(spark):
    rng = np.random.default_rng(4)
    n = rng.integers(0, 9, (12, 12))
    n = n + n.T
    w = axes.correlation(spark.createDataFrame([(i, j, int(n[i, j])) for i in range(12) for j in range(12) if n[i, j]], "i int, j int, n long"))
    t = n.sum(axis=1)
    m = n / np.sqrt(np.outer(t, t))
    found = axes.crystallize(w, k=2, tolerance=1e-10)
    check(found, m, 2)
    placed = {r.i: (r.c0, r.c1) for r in axes.grid(w, found, 100).collect()}
    vectors = {r.i: r for r in found.vectors.collect()}
    for c in (0, 1):
        p = m @ np.array([vectors[i][f"a{c}"] for i in range(12)])
        want = np.floor((p - p.min()) / (p.max() - p.min()) * 99 + 0.5)
        assert all(abs(placed[i][c] - want[i]) <= (abs((p[i] - p.min()) / (p.max() - p.min()) * 99 % 1 - 0.5) < 1e-6) for i in range(12))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_errors_are_honest_on_the_table(spark):
    """Random vectors have hardly a gap: few rounds leave an error, and it is the one that is told."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = np.array([r.embedding for r in df.select("embedding").collect()], float)
    m = x.T @ x / len(x)
    found = axes.crystallize(axes.second_moments(df, "embedding", 64), k=2, spare=4, max_rounds=5)
    rows = {r.i: r for r in found.vectors.collect()}
    for n, (value, error) in enumerate(zip(found.values, found.errors, strict=True)):
        v = np.array([rows[i][f"a{n}"] for i in range(64)])
        assert abs(np.linalg.norm(v) - 1) < 1e-9 and abs(np.linalg.norm(m @ v - value * v) - error) < 1e-9
        assert np.abs(np.linalg.eigvalsh(m) - value).min() <= error + 1e-12

"""Top-k ghosts against all pairs."""

import random

import pytest

from tessella.operators import ghosts


def brute(a, b, edges, weights, k, directed=True):
    known = set(edges) | (set() if directed else {(y, x) for x, y in edges})
    rows = [(abs(s := sum(x * y * w for x, y, w in zip(u, v, weights, strict=True))), i, j, s) for i, u in a for j, v in b if (i, j) not in known and (directed or i < j)]
    return [(i, j, s) for _, i, j, s in sorted(rows, key=lambda r: (-r[0], r[1], r[2]))[:k]]


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "node long, v array<double>").repartition(3)


def run(spark, a, b, edges, weights, k, directed=True, **how):
    e = spark.createDataFrame(edges, "src long, dst long")
    found = ghosts.top_ghosts(frame(spark, a), frame(spark, b), e, weights, k, directed=directed, **how)
    return [tuple(r) for r in found.pairs.orderBy("src", "dst").collect()], found


@pytest.mark.parametrize("k,block", [(1, 8), (20, 8), (37, 64), (5000, 16)])
def test_against_all_pairs(spark, k, block):
    rng = random.Random(k)
    a = [(i, [rng.randrange(-9, 10) * rng.choice([0, 1, 1, 8]) for _ in range(6)]) for i in range(70)]
    b = [(1000 + i, [rng.randrange(-9, 10) for _ in range(6)]) for i in range(50)]
    edges = [(rng.randrange(70), 1000 + rng.randrange(50)) for _ in range(900)] + [(5, 77), (None, 1001)]
    weights = [3, -1, 0, 2, 1, -4]
    got, _ = run(spark, a, b, edges, weights, k, block_rows=block)
    assert got == sorted(brute(a, b, edges, weights, k))


def test_pairs_of_blocks_are_skipped(spark):
    """Norms that fall fast: the first blocks hold the answer, most pairs of blocks are never made."""
    rng = random.Random(1)
    a = [(i, [rng.random() / (1 + i) for _ in range(4)]) for i in range(400)]
    b = [(1000 + i, [rng.random() / (1 + i) for _ in range(4)]) for i in range(400)]
    edges = [(i, 1000 + j) for i in range(3) for j in range(3)]
    got, found = run(spark, a, b, edges, [1.0] * 4, 10, block_rows=20)
    want = sorted(brute(a, b, edges, [1.0] * 4, 10))
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 1e-12 for g, w in zip(got, want, strict=True))
    assert found.blocks_all == 400 and found.blocks_seen < 40


def test_blocks_about_a_mean_are_skipped(spark):
    """Long vectors that differ little from their mean, which the weights nearly cancel: norms alone part nothing."""
    rng = random.Random(2)
    a = [(i, [rng.randrange(20) for _ in range(6)]) for i in range(400)]
    b = [(1000 + i, [1000 + rng.randrange(-3, 4) for _ in range(6)]) for i in range(400)]
    weights = [3, -1, -2, 4, -5, 1]
    edges = [(rng.randrange(400), 1000 + rng.randrange(400)) for _ in range(3000)]
    got, found = run(spark, a, b, edges, weights, 15, block_rows=20)
    assert got == sorted(brute(a, b, edges, weights, 15))
    assert found.blocks_all == 400 and found.blocks_seen < 60


def test_one_set_of_nodes_and_ties(spark):
    rng = random.Random(4)
    a = [(i, [rng.choice([-1, 0, 1]) for _ in range(3)]) for i in range(60)]
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(300)]
    got, _ = run(spark, a, a, edges, [1, 1, 1], 100, directed=False, block_rows=7)
    assert got == sorted(brute(a, a, edges, [1, 1, 1], 100, directed=False))


def test_all_zero_all_known_and_empty(spark):
    a = [(i, [0, 0]) for i in range(9)]
    assert run(spark, a, a, [], [1, 1], 5, block_rows=2)[0] == [(0, j, 0.0) for j in range(5)]
    every = [(i, j) for i in range(9) for j in range(9)]
    assert run(spark, a, a, every, [1, 1], 5)[0] == [] and run(spark, [], a, [], [1, 1], 5)[0] == [] and run(spark, a, [], every, [1, 1], 5)[0] == []
    with pytest.raises(ValueError):
        run(spark, a, a, [], [1, 1], 0)

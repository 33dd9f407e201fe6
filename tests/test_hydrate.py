"""Hydration and frontier fan-out against plain loops; votes of wide fingerprints."""

import random
import time

import numpy as np

from tessella.operators import hdc, hydrate, sweeps
from tessella.operators.graph import fanout_round


def nodes_frame(spark, nodes):
    return spark.createDataFrame(list(nodes.items()), "node long, fp array<long>").repartition(3)


def test_hydrate_against_a_loop(spark):
    rng = random.Random(1)
    nodes = {i: [rng.getrandbits(63), rng.getrandbits(63)] for i in range(30)}
    rels = {"CAUSES": [3, 5], "SEES": [rng.getrandbits(63), 9], "UNDOES": [1, 1]}
    edges = [(rng.randrange(33), rng.randrange(33), rng.choice([*rels])) for _ in range(150)] + [(1, 2, "SEES"), (1, 2, "SEES")]
    edges = [e for e in edges if e[0] != 29 and e[1] != 29]
    e = spark.createDataFrame(edges, "src long, dst long, rel string")
    r = spark.createDataFrame(list(rels.items()), "rel string, fp array<long>")
    got = {x.node: x for x in hydrate.hydrate(nodes_frame(spark, nodes), e, 2, 63, r, ("CAUSES",), ("UNDOES",)).collect()}
    assert got.keys() == nodes.keys()
    for i in nodes:
        sigs, s, o, c = [], 0, 0, 0
        for a, b, rel in edges:
            if a in nodes and b in nodes:
                way = {"CAUSES": 1, "UNDOES": -1}.get(rel, 0)
                for mine, sub in ((a == i, 1), (b == i, 0)):
                    if mine:
                        sigs.append([x ^ y for x, y in zip(nodes[a], rels[rel], strict=True)])
                        s, o, c = s + sub, o + 1 - sub, c + (way if sub else -way)
        count = [[sum(x[w] >> k & 1 for x in sigs) for k in range(63)] for w in range(2)]
        sure, n = max(1, len(sigs) * 3 // 4), len(sigs)
        assert list(got[i].awareness) == [sum(1 << k for k in range(63) if lane[k] > n // 2) for lane in count]
        assert (got[i].edge_count, got[i].subject_count, got[i].object_count, got[i].causal_sign) == (n, s, o, c)
        agreed = sum(x > sure or x < n - sure for lane in count for x in lane) if n else 0
        assert abs(got[i].crystallization - agreed / 126) < 1e-12
    by = {(x.node, x.rel): list(x.fp) for x in hydrate.relation_awareness(nodes_frame(spark, nodes), e, 2, 63, r).collect()}
    want = {}
    for a, b, rel in edges:
        if a in nodes and b in nodes:
            old = want.get((a, rel), [0, 0])
            want[a, rel] = [x ^ y ^ z for x, y, z in zip(old, nodes[a], rels[rel], strict=True)]
    assert by == want


def test_relations_without_a_vector_have_a_hash(spark):
    nodes = nodes_frame(spark, {1: [0, 0], 2: [7, 7]})
    e = spark.createDataFrame([(1, 2, "NEW"), (1, 2, None)], "src long, dst long, rel string")
    got = {r.rel: r.fp for r in hydrate.relation_awareness(nodes, e, 2, 10).collect()}
    assert got.keys() == {"NEW", None} and got["NEW"] != got[None] and all(0 <= x < 1024 for v in got.values() for x in v)


def plain(nodes, edges, rounds):
    near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in nodes}
    near = {i: {j for j in js if j in nodes and j != i} for i, js in near.items()}
    told, now, changed = [], {i: list(v) for i, v in nodes.items()}, {i for i, v in nodes.items() if any(v)}
    for k in range(rounds):
        after = {i: [x ^ y for x, y in zip(v, [__import__("functools").reduce(lambda a, b: a ^ b, (now[j][w] for j in near[i]), 0) for w in range(2)], strict=True)] for i, v in now.items()}
        messages = sum(len(near[i]) for i in changed)
        changed = {i for i in nodes if after[i] != now[i]}
        told.append({"round": k, "changed": len(changed), "bits": sum(bin(x ^ y).count("1") for i in nodes for x, y in zip(after[i], now[i], strict=True)), "messages": messages})
        now = after
        if not changed:
            break
    return now, told


def test_fanout_counts_and_vectors(spark):
    rng = random.Random(7)
    for edges, rounds in (
        ([(2 * i, 2 * i + 1) for i in range(12)] + [(3, 3), (4, 99)], 9),  # pairs settle after three rounds
        ([(rng.randrange(25), rng.randrange(25)) for _ in range(40)] + [(1, 2), (2, 1)], 5),
        ([(0, i) for i in range(1, 20)], 4),
        ([], 3),
    ):
        nodes = {i: [rng.getrandbits(50), rng.getrandbits(50)] if i % 4 else [0, 0] for i in range(25)}
        e = spark.createDataFrame(edges, "src long, dst long")
        out, told = hydrate.frontier_fanout(nodes_frame(spark, nodes), e, 2, rounds)
        want, counts = plain(nodes, edges, rounds)
        assert {r.node: list(r.fp) for r in out.collect()} == want and told == counts
        if len(edges) == 14:
            assert told[-1]["changed"] == 0 and len(told) == 3 and told[0]["messages"] < 2 * 12


def test_first_round_is_the_old_operator(spark):
    nodes = nodes_frame(spark, {i: [i * 77, i] for i in range(9)})
    e = spark.createDataFrame([(i, (i * 2 + 1) % 9) for i in range(9)], "src long, dst long").where("src <> dst")
    one, _ = hydrate.frontier_fanout(nodes, e, 2, 1)
    assert sorted(map(str, one.collect())) == sorted(map(str, fanout_round(nodes, e, 2).collect()))


def test_votes_of_sixteen_thousand_bits(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(i % 3) if i % 10 else None, rng.integers(-(1 << 63), 1 << 63, 256, np.int64).tolist()) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, g int, fp array<long>").repartition(5)
    began = time.perf_counter()
    made = hdc.bundle_majority(df, ["g"], 256, 64)
    made.explain()
    assert time.perf_counter() - began < 2
    got = {r.g: (r.n, r.fp) for r in made.collect()}
    for g in (0, 1, 2, None):
        mine = np.array([v for _, x, v in rows if x == g], np.int64)
        ones = np.unpackbits(mine.view(np.uint8).reshape(len(mine), -1), axis=1, bitorder="little").sum(axis=0)
        want = np.packbits(ones > len(mine) // 2, bitorder="little").view("<i8").tolist()
        assert got[g] == (len(mine), want)
    # Narrow ones by the same votes, and with partial vectors handed on at once.
    for by in (["g"], []):
        few = df.selectExpr("g", "slice(fp, 1, 2) AS fp")
        assert sorted(map(str, hdc.votes(few, by, 2, 64, state_bytes=1).drop("agreed").collect())) == sorted(map(str, hdc.bundle_majority(few, by, 2, 64).collect()))


def test_sweep_of_sixteen_thousand_bits(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 63), 1 << 63, 256, np.int64)
    rows = [(i, (base ^ (rng.integers(0, 2, 256) * (i % 5 > 0)).astype(np.int64)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, fp array<long>")
    began = time.perf_counter()
    swept = sweeps.horizontal_sweep(df, [int(x) % (1 << 64) for x in base], 130)
    swept.explain()
    assert time.perf_counter() - began < 2
    want = {i: sum(bin((a ^ int(b)) & (1 << 64) - 1).count("1") for a, b in zip(v, base, strict=True)) for i, v in rows}
    assert {r.vec_id: r.d for r in swept.collect()} == {i: d for i, d in want.items() if d <= 130}


def test_tree_of_sixteen_thousand_bits(spark):
    """The cluster tree and its radius search at 2 KB a fingerprint, against brute force."""
    from tessella.operators import clusters

    rng = np.random.default_rng(6)
    hearts = rng.integers(-(1 << 63), 1 << 63, (3, 256), np.int64)
    rows = [(i, (hearts[i % 3] ^ np.where(rng.random(256) < 0.1, np.int64(255), np.int64(0))).tolist()) for i in range(60)]
    c, m = clusters.build(spark.createDataFrame(rows, "id long, fp array<long>"), 256, min_size=8, max_depth=3)
    q = [x % (1 << 64) for x in rows[4][1]]
    want = {i: sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(q, v, strict=True)) for i, v in rows}
    for rho in (0, 300, 9000):
        assert {r.id: r.d for r in clusters.within(c, m, q, rho, 256).select("id", "d").collect()} == {i: d for i, d in want.items() if d <= rho}

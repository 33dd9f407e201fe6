"""A tree that changes, version by version, against brute force."""

import random

from tessella.operators import clusters, commands, livetree


def word(x):
    return x - (1 << 64) if x >> 63 else x


def frame(spark, rows):
    return spark.createDataFrame([(i, [word(x) for x in v]) for i, v in rows.items()], "id long, fp array<long>").repartition(3)


def d(a, b):
    return sum(bin(x ^ y).count("1") for x, y in zip(a, b, strict=True))


def near(rng, v, n):
    v = list(v)
    for bit in rng.sample(range(128), n):
        v[bit // 64] ^= 1 << bit % 64
    return v


def check(spark, path, rows, rng, leaf_size, max_depth, version=None):
    c, m = livetree.snapshot(spark, path, version)
    c, m = c.cache(), m.cache()
    assert {r.id: list(r.fp) for r in m.collect()} == {i: [word(x) for x in v] for i, v in rows.items()}
    for q in (list(rows.values())[0], near(rng, rng.choice(list(rows.values())), 9), [0, 0]):
        for rho in (0, 12, 40, 70):
            assert sorted((r.id, r.d) for r in clusters.within(c, m, q, rho, 2).collect()) == sorted((i, d(v, q)) for i, v in rows.items() if d(v, q) <= rho)
        want = sorted((d(v, q), i) for i, v in rows.items())[:7]
        assert [(r.d, r.id) for r in clusters.nearest(c, m, q, 7, 2).collect()] == want
    # Every node's count and radius hold for what is under it; leaves are small where they can be.
    nodes, members = {(r.node, r.depth): r for r in c.collect()}, m.collect()
    for (node, depth), r in nodes.items():
        under = [x for x in members if x.depth >= depth and x.node >> (16 - depth) == node >> (16 - depth)]
        center = [x % (1 << 64) for x in r.center]
        assert r.n == len(under) > 0 and max(d([w % (1 << 64) for w in x.fp], center) for x in under) <= r.radius
        assert not r.leaf or r.n <= leaf_size or r.radius == 0 or depth == max_depth
    assert {(x.node, x.depth) for x in members} == {k for k, r in nodes.items() if r.leaf}
    return nodes


def test_sets_and_dels_equal_brute_force(spark, tmp_path):
    rng, path = random.Random(6), f"{tmp_path}/tree"
    hearts = [[rng.getrandbits(64), rng.getrandbits(64)] for _ in range(5)]
    rows = {i: near(rng, hearts[i % 5], rng.randrange(20)) for i in range(150)}
    assert livetree.create(frame(spark, rows), path, 2, leaf_size=20, max_depth=5) == 1
    states = {1: dict(rows)}
    before = check(spark, path, rows, rng, 20, 5)

    # New rows close to one heart: its leaves split where they stand, the others' leaves are not written.
    new = {200 + i: near(rng, hearts[0], rng.randrange(12)) for i in range(40)}
    rows |= new
    assert livetree.change(spark, path, add=frame(spark, new)) == 2
    states[2] = dict(rows)
    after = check(spark, path, rows, rng, 20, 5)
    written = {(r.node, r.depth) for r in livetree.touched_nodes(spark, path).collect()}
    assert (0, 0) in written and len(written) < len(after) and after.keys() - before.keys() <= written
    assert all(after[k] == before[k] for k in after.keys() - written)

    # Replaced and dropped rows; ids that are not there; an id that is dropped and set.
    change = {0: near(rng, hearts[3], 60), 201: hearts[1], 500: [1, 2]}
    gone = [*range(5, 150, 5), 9999, 201]
    livetree.change(spark, path, add=frame(spark, change), drop=spark.createDataFrame([(i,) for i in gone], "id long"))
    rows = {i: v for i, v in rows.items() if i not in gone} | change
    states[3] = dict(rows)
    check(spark, path, rows, rng, 20, 5)

    assert livetree.compact(spark, path) == 4
    for version, state in states.items():  # snapshots stay as they were
        check(spark, path, state, rng, 20, 5, version)
    check(spark, path, rows, rng, 20, 5)


def test_a_tree_that_is_emptied_and_filled_again(spark, tmp_path):
    path, rng = f"{tmp_path}/tree", random.Random(2)
    rows = {i: [rng.getrandbits(64), i] for i in range(30)}
    livetree.create(frame(spark, rows), path, 2, leaf_size=8, max_depth=4)
    livetree.change(spark, path, drop=frame(spark, rows).select("id"))
    c, m = livetree.snapshot(spark, path)
    assert c.count() == 0 and m.count() == 0
    more = {i: [rng.getrandbits(64), 1] for i in range(40)} | {50: [7, 7], 51: [7, 7]}
    livetree.change(spark, path, add=frame(spark, more))
    check(spark, path, more, rng, 8, 4)
    livetree.change(spark, path)  # nothing to do is a version too
    check(spark, path, more, rng, 8, 4)


def test_commands_set_and_del(spark, tmp_path):
    path, rng = f"{tmp_path}/tree", random.Random(3)
    rows = {i: [rng.getrandbits(64), rng.getrandbits(64)] for i in range(60)}
    livetree.create(frame(spark, rows), path, 2, leaf_size=10, max_depth=4)
    told = commands.execute_on(spark, "SET ada:clam:0 77 " + "".join(f"{x:016x}" for x in rows[3]), path).collect()
    assert [r.version for r in told] == [2] and told[0].gate in ("flow", "hold", "block") and 0 <= told[0].anomaly <= 1
    _, m = livetree.snapshot(spark, path)
    stored = {r.id: list(r.fp) for r in m.collect()}
    assert (stored.get(77) == [word(x) for x in rows[3]]) == (told[0].gate == "flow")
    nibble = next(r.node >> 12 for r in m.orderBy("id").collect() if r.depth == 4)
    told = commands.execute_on(spark, f"DEL ada:clam:{nibble:x}", path).collect()
    c, m = livetree.snapshot(spark, path)
    left = {r.id for r in m.collect()}
    assert told[0].removed == len(stored) - len(left) > 0 and c.where(f"node = {nibble << 12} and depth = 4").count() == 0
    assert commands.execute_on(spark, "SCAN ada:clam:8", path).count() >= 0

import random

from pyspark.sql import functions as F

from tessella.operators import clusters, commands, stats


def test_searches_diffs_and_commands(spark):
    rng = random.Random(3)
    words = [[rng.getrandbits(31) for _ in range(2)] for _ in range(60)]
    words += [list(words[0]), [words[0][0] ^ 1, words[0][1]]]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id long, fp array<bigint>")
    c, m = clusters.build(df, 2, 32, min_size=12, max_depth=3)
    c, m = c.cache(), m.cache()
    dist = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))
    query = words[5]
    order = sorted((dist(w, query), i) for i, w in enumerate(words))
    assert m.count() == len(words)
    assert {(r.d, r.id) for r in clusters.within(c, m, query, 24, 2).collect()} == {x for x in order if x[0] <= 24}
    assert [(r.d, r.id) for r in clusters.nearest(c, m, query, 7, 2).collect()] == order[:7]
    assert [(r.d, r.id) for r in clusters.nearest_by_radius(c, m, query, 7, 2).collect()] == order[:7]
    assert [(r.d, r.id) for r in clusters.lod_nearest(c, m, clusters.lod_masks(m, 2), query, 7, 2).collect()] == order[:7]
    assert {(r.d, r.id) for r in clusters.diff_distances(c, clusters.xor_diffs(c, m, 2), query, 2).collect()} == set(order)
    back = clusters.undo_diffs(c, clusters.xor_diffs(c, m, 2), 2)
    assert {r.id: r.fp for r in back.collect()} == dict(enumerate(words))
    # What lies under a path of four steps has them and is as deep; a member's score is its leaf's.
    deeper, inside = clusters.build(df, 2, 32, min_size=2, max_depth=6)
    under = {(r.node, r.depth, r.n) for r in deeper.collect() if r.depth >= 4 and r.node >> 12 == 0}
    assert under and {(r.node, r.depth, r.n) for r in commands.execute("SCAN ada:clam:0", deeper, inside).collect()} == under
    leaves = {(r.node, r.depth): r for r in c.where("leaf").collect()}
    deep = max(r.depth for r in leaves.values())
    for r in clusters.anomaly(c, m).collect():
        leaf = leaves[r.node, r.depth]
        score = r.depth / max(1, deep) * (1 - leaf.n / len(words)) * min(leaf.lfd / 3, 1)
        assert abs(r.score - score) < 1e-9 and r.band == ("anomalous" if score >= 0.7 else "unusual" if score >= 0.4 else "normal")
    got = commands.execute("MGET ada:clam:0 ada:clam:f", c, m).collect()
    assert len(got) == 2 and all(r.gate in ("flow", "hold", "block") for r in got)
    top = c.where("depth = 0").first()
    assert top.n == len(words) and commands.execute("CRP ada:clam:0", c, m).select(F.sum("n")).first()[0] <= len(words)


def test_parse():
    assert commands.parse("get ada:clam:a:b") == commands.Command("GET", ((0xAB00, 8),))
    for bad in ("", "FLY ada:clam:a", "GET", "GET ada:clam:1010:1", "GET ada:x"):
        try:
            commands.parse(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_values_at_ranks(spark):
    """Hot groups, ties, nulls and a group of one value, against sorting."""
    rng = random.Random(8)
    rows = [("a", rng.choice([0.5, 1.0, 1.0, 2.0, rng.random() * 10, None])) for _ in range(3000)] + [("b", 7.0)] * 5 + [("c", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r for r in stats.quantiles(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p100": 1.0}).collect()}
    for k in "abc":
        v = sorted(x for g, x in rows if g == k and x is not None)
        for name, p in (("p10", 0.1), ("p50", 0.5), ("p100", 1.0)):
            at = (len(v) - 1) * p
            low, high = v[int(at)], v[-int(-at // 1)]
            assert abs(got[k][name] - (low + (high - low) * (at - int(at)))) < 1e-9
    assert stats.quantiles(df.limit(0), ["k"], "v", {"p50": 0.5}).collect() == []

from collections import defaultdict

import pytest
import xxhash

from tessella.llm import simhash
from tessella.llm.components import connected_components


def brute_print(text):
    words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hs) * 2 > len(hs))


def brute_components(items):
    root = {i: i for i, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if (x ^ y).bit_count() <= 2:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i, _ in items}


def test_documents_against_brute_force(spark):
    texts = ["One two three four five", "one TWO three four  five", "", None, " \t", "x", "x y", "Ünï Öre the", "Ünï öre the", "z " * 5000, "one two three four six", "é b c d"]
    docs = spark.createDataFrame([(i + 5, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [(i + 5, brute_print(t)) for i, t in enumerate(texts)]
    roots = brute_components(prints)
    assert {i: got[i].fingerprint for i, _ in prints} == {i: f"{p:016x}" for i, p in prints}
    assert {i: got[i].component_id for i, _ in prints} == roots


@pytest.mark.parametrize("limit", [2, 32])
def test_links_keep_components(spark, limit):
    import random

    rng, fps = random.Random(limit), set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = simhash.close_pairs(df, bucket_limit=limit)
    rows = [(r.a % 2**64, r.b % 2**64) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in rows)
    want = brute_components([(x, x) for x in sorted(fps)])
    got = defaultdict(set)
    for r in connected_components(links).collect():
        got[r.root].add(r.node % 2**64)
    groups = defaultdict(set)
    for x, r in want.items():
        groups[r].add(x)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, "q r s t")], "doc_id long, text string")
    assert sorted(r.component_id for r in simhash.near_duplicates(twice).collect()) == [1, 1, 1, 3]
    assert sorted(r.doc_id for r in simhash.keep_one(twice).collect()) == [1, 1, 3]


def test_long_chain_has_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(300, 301), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 301: 300}


@pytest.mark.parametrize("how", [{}, {"similarity": 0.8}])
def test_repeated_id_on_two_texts_loses_only_the_copy(spark, how):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "q r s t u v")], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.keep_one(docs, **how).collect()) == [(1, "a b c d e f"), (2, "q r s t u v")]

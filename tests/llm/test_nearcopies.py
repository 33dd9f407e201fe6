import os
import random

import numpy as np
import pytest

import corpus_pipeline
from tessella.llm import nearcopies


def jaccard(x, y):
    grams = [{tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (x, y)]
    return len(grams[0] & grams[1]) / len(grams[0] | grams[1])


def test_stage_drops_copies_of_similarity_four_fifths(spark):
    rng = random.Random(5)
    rows, kept = [], []
    for k in range(40):
        words = [f"w{rng.randrange(50_000)}" for _ in range(200)]
        other = list(words)
        for i in rng.sample(range(200), 1 + k % 8):
            other[i] = f"n{rng.randrange(50_000)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        kept += [2 * k] + [2 * k + 1] * (jaccard(rows[-2][1], rows[-1][1]) < 0.8)
    assert 45 < len(kept) < 70  # both sides of the limit occur
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies_out(spark, docs, "").collect()) == kept


def test_chain_and_bucket_of_several_groups(spark):
    words = [f"w{i}" for i in range(300)]
    # A chain: each text is close to the next one only; the ends are far apart.
    chain = [" ".join(f"c{i}" if i < 30 * k and i % 6 == 0 else w for i, w in enumerate(words)) for k in range(10)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*chain, None, "", "a b", "A  b"])], "doc_id long, text string")
    sets = [nearcopies.shingles(t) for t in chain]
    close = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.8
    root = list(range(10))
    for i in range(10):
        for j in range(i):
            if close(sets[i], sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    want = sorted({*root}) + [10, 12]
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies_out(spark, docs, "").collect()) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    sets = {i: nearcopies.shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if j < i and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root = {k: min(root[i], root[j]) if r in (root[i], root[j]) else r for k, r in root.items()}
    got = corpus_pipeline.near_copies_out(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(i, t) for i, t in rows if root[i] == i]


def test_parity_bound_refuses_no_similar_pair():
    """Differing parity bits never outnumber the shingles that only one set has."""
    rng = np.random.default_rng(7)
    for size in (0, 1, 40, 300, 5000):
        x = np.unique(rng.integers(0, 1 << 64, size, np.uint64))
        for change in (0, 1, 7, 60):
            y = np.unique(np.concatenate([x[change:], rng.integers(0, 1 << 64, change // 2, np.uint64)]))
            apart = int(np.bitwise_count((nearcopies.parity(x) ^ nearcopies.parity(y)).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(x, y)) and (apart - len(np.setxor1d(x, y))) % 2 == 0


def test_large_group_about_the_limit(spark):
    """Copies of one text with so many changes that pairs stand on both sides of the limit."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(160)]
    texts = []
    for _ in range(70):
        words = list(base)
        for i in rng.sample(range(160), rng.randrange(1, 7)):
            words[i] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    root = list(range(70))
    for i in range(70):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies_out(spark, docs, "").collect()) == sorted({*root})

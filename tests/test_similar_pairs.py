import random

import pytest

from tessella.operators import search


@pytest.mark.parametrize("limit, words, width", [(6, 1, 32), (6, 2, 32), (4, 1, 64), (1, 1, 32), (9, 1, 8)])
def test_all_close_pairs(spark, limit, words, width):
    rng = random.Random(limit)
    base, prints = [rng.getrandbits(words * width) for _ in range(6)], []
    for _ in range(90):
        x = rng.choice(base)
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(words * width)
        prints.append(x)
    cut = lambda x: [y - (1 << 64) if y >> 63 else y for y in (x >> width * w & (1 << width) - 1 for w in range(words))]
    df = spark.createDataFrame([(i, cut(x)) for i, x in enumerate(prints)] + [(999, None)], "vec_id long, fp array<long>")
    want = [(i, j, d) for j, y in enumerate(prints) for i, x in enumerate(prints[:j]) if (d := (x ^ y).bit_count()) < limit]
    assert sorted(tuple(r) for r in search.similar_pairs(df, limit, words, width=width).collect()) == sorted(want)


def test_blocks_part_fingerprints(spark):
    # Of 4,096 spread prints, few meet; a band of pivot distances held most of them.
    rng = random.Random(7)
    masks, meetings = search.block_masks(5, 1), 0
    prints = [rng.getrandbits(32) for _ in range(4096)]
    for m in masks:
        sizes = {}
        for x in prints:
            sizes[x & m[0]] = sizes.get(x & m[0], 0) + 1
        meetings += sum(n * (n - 1) // 2 for n in sizes.values())
    assert meetings < 0.02 * 4096 * 4095 / 2


@pytest.mark.parametrize("limit", [1, 2, 4])
def test_classes_and_links(spark, limit):
    rng = random.Random(limit)
    base = [rng.getrandbits(16) for _ in range(25)]
    rows = [(i, [b ^ (1 << rng.randrange(16) if i % 3 else 0)]) for i, b in enumerate(rng.choices(base, k=160))] + [(900, None), (901, None)]
    df = spark.createDataFrame(rows, "vec_id long, fp array<long>").repartition(3)
    want = []
    for i, v in rows:
        if v is None:
            want.append((i, i, 0))
            continue
        others = [(j, w) for j, w in rows if w is not None and j != i]
        want.append((i, min([i, *(j for j, w in others if w == v)]), sum(bin(v[0] ^ w[0]).count("1") < limit for _, w in others)))
    assert sorted(tuple(r) for r in search.similar_classes(df, limit, 1, width=16).collect()) == sorted(want)


def test_rows_of_all_masks_are_not_broadcast(spark):
    """They are many times the table, however small Spark's estimate of it is."""
    df = spark.range(400).selectExpr("id AS vec_id", "array(id * 7919 % 65536) AS fp")
    near = search._near_prints(df.select("fp"), 4, 1, 16)
    assert near.count() > 0
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()


def test_rows_of_all_masks_are_made_in_all_tasks(spark):
    """Adaptive execution puts few fingerprints in one task, unless their number of tasks is given."""
    one = spark.range(400).selectExpr("array(id * 7919 % 65536) AS fp").distinct()
    near = search._near_prints(one, 4, 1, 16)
    assert near.count() > 0
    assert "REPARTITION_BY_NUM" in near._jdf.queryExecution().executedPlan().toString()

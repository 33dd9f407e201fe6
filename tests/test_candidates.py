"""The hashed candidate index: windows, runs, recall."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import candidates as cam
from tessella.plans._registry import prints


def table(spark, rows, lanes=4):
    return spark.createDataFrame([(i, [int(x) for x in v]) for i, v in rows], "id long, fp array<long>").repartition(3)


def planted(rng, n=400, lanes=4):
    """n random fingerprints, each with three near ones (8 of 256 bits)."""
    base, out = rng.integers(-(1 << 63), 1 << 63, (n, lanes), np.int64), []
    for i, v in enumerate(base):
        out.append((4 * i, v))
        for k in range(1, 4):
            w = v.copy()
            for bit in rng.choice(lanes * 64, 8, replace=False):
                w[bit // 64] ^= np.int64(1) << np.int64(bit % 64) if bit % 64 < 63 else np.int64(-(1 << 63))
            out.append((4 * i + k, w))
    return out


def distance(a, b):
    return sum(bin((int(x) ^ int(y)) & (1 << 64) - 1).count("1") for x, y in zip(a, b, strict=True))


def test_planted_neighbours_inserts_and_compaction(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows, path = planted(rng), f"{tmp_path}/index"
    first, second = rows[: 3 * len(rows) // 4], rows[3 * len(rows) // 4 :]
    assert cam.build(table(spark, first), path, 4, tables=12, sample=2, block=16) == 1
    assert cam.insert(table(spark, second), path) == 2
    with pytest.raises(ValueError):
        cam.insert(table(spark, rows[:1]), path)
    asked = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in rows if i % 100 == 0], "q long, fp array<long>")
    found = {}
    for r in cam.search(asked, path, 4).collect():
        found.setdefault(r.q, []).append((r.d, r.id))
    by = dict(rows)
    for q, hits in found.items():
        assert sorted(hits)[0] == (0, q) and all(distance(by[q], by[i]) == d for d, i in hits)
    near = sum(4 * (q // 4) <= i < 4 * (q // 4) + 4 for q, hits in found.items() for _, i in hits)
    assert len(found) == 16 and near >= 0.9 * 4 * len(found)
    # One run holds the same rows; the versions before stay readable.
    assert cam.compact(spark, path) == 3 and cam.rebuild(spark, path, tables=14) == 4
    for version in (2, 3, 4):
        assert cam.entries(spark, path, version).count() == len(rows)
    assert cam.entries(spark, path, 1).count() == len(first)
    assert cam.search(asked, path, 1).where("d = 0 and q = id").count() == 16


def test_one_key_on_most_rows_is_met_by_a_window_only(spark, tmp_path):
    same, rng = [5, 6, 7, 8], np.random.default_rng(3)
    rows = [(i, same) for i in range(900)] + [(900 + i, v) for i, v in enumerate(rng.integers(-(1 << 62), 1 << 62, (100, 4)))]
    path = f"{tmp_path}/index"
    cam.build(table(spark, rows), path, 4, tables=3, block=8)
    asked = spark.createDataFrame([(0, same), (1, [int(x) for x in rows[950][1]])], "q long, fp array<long>")
    pairs = cam.candidates(asked, path)
    counts = {r.q: r["count"] for r in pairs.groupBy("q").count().collect()}
    assert max(counts.values()) <= 3 * 3 * 8 and pairs.count() == pairs.distinct().count()
    assert cam.search(asked, path, 5).where("q = 0 and d = 0").count() == 5 and cam.search(asked, path, 1).where("q = 1").first().id == 950


def test_empty_and_null(spark, tmp_path):
    path = f"{tmp_path}/index"
    none = spark.createDataFrame([(None, None), (1, None)], "id long, fp array<long>").where("id = 1")
    cam.build(none, path, 4)
    asked = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, None)], "q long, fp array<long>")
    assert cam.search(asked, path, 3).collect() == []
    cam.insert(table(spark, [(7, [1, 2, 3, 4])]), path)
    assert [tuple(r) for r in cam.search(asked, path, 3).collect()] == [(1, 7, 0)]


def test_two_writers_from_one_version(spark, tmp_path):
    from tessella.operators import _versions

    path = f"{tmp_path}/index"
    cam.build(table(spark, [(1, [1, 1, 1, 1])]), path, 4)
    _, manifest = _versions.read(spark, path)
    _versions.commit(spark, path, 1, manifest)
    with pytest.raises(RuntimeError):
        _versions.commit(spark, path, 1, manifest)
    with pytest.raises(ValueError):
        _versions.read(spark, path, 9)


def test_wide_fingerprints(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows, path = planted(rng, 40, 256), f"{tmp_path}/index"
    cam.build(table(spark, rows), path, 256, tables=4, sample=8, block=16)
    asked = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in rows[::4]], "q long, fp array<long>")
    found = cam.search(asked, path, 4)
    assert found.where("floor(id / 4) = floor(q / 4)").count() >= 0.9 * 160


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_recall_over_the_whole_table(spark, tmp_path):
    """Every id divisible by 100 against all rows: 0.9 and over of the ten nearest by brute force."""
    rows = prints(spark, "/root/testdata/sf0.1").select(F.col("vec_id").alias("id"), "fp")
    path = f"{tmp_path}/index"
    cam.build(rows, path, 2, 32, tables=16, sample=1, block=48)
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("q"), "fp")
    all_rows = [(r.id, r.fp) for r in rows.collect()]
    exact = [(q.q, d) for q in asked.collect() for d, _ in sorted((distance(q.fp, v), i) for i, v in all_rows)[:10]]
    found = cam.search(asked, path, 10)
    assert cam.recall(found, spark.createDataFrame(exact, "q long, d long")) >= 0.9
    assert cam.candidates(asked, path).count() < len(all_rows) * asked.count()

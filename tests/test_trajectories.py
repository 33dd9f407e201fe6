"""Trajectories from a shuffled, late stream against the whole table and a plain loop; restarts."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.streaming import trajectories

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LANES = 12


def walk(rng, kind, n):
    planes, out = [[rng.getrandbits(62) for _ in range(LANES)] for _ in range(3)], []
    old = [list(p) for p in planes]
    for i in range(n):
        out.append([list(p) for p in planes])
        if kind == "settles":
            for p in planes:
                for w in range(LANES if i < n // 2 - planes.index(p) else 0):
                    p[w] = rng.getrandbits(62)
        elif kind == "swings":
            planes, old = [[x ^ 0x3FFFFFFFFFFF for x in p] for p in planes], planes
        else:
            planes[i % 3][0] ^= rng.getrandbits(62)
            if rng.random() < 0.5:
                planes[rng.randrange(3)] = [rng.getrandbits(62) for _ in range(LANES)]
    return out


def plain(states):
    n, sup, und, level, back = len(states), 0, 0, None, [0, 0, 0]
    for t in range(1, n):
        now = sum(sum(bin(a ^ b).count("1") for a, b in zip(x, y, strict=True)) <= trajectories.SETTLED for x, y in zip(states[t], states[t - 1], strict=True))
        sup, und, level = sup + (level is not None and now > level), und + (level is not None and now < level), now
        for i in range(3):
            if t > 1:
                back[i] += sum(a == c and a != b for a, b, c in zip(states[t][i], states[t - 1][i], states[t - 2][i], strict=True))
    con = sum(x > trajectories.CONTESTED for x in back)
    return n, sup, und, con, "flow" if level == 3 and sup > und + con else "block" if con > sup else "hold"


def tables(rng):
    walks = {f"{kind}{k}": walk(rng, kind, rng.randrange(1, 14)) for kind in ("settles", "swings", "wanders") for k in range(4)}
    rows = [(k, i, f"2024-01-01 00:{i:02d}:{rng.randrange(60):02d}", *s) for k, states in walks.items() for i, s in enumerate(states)]
    return walks, rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, iter long, at string, s array<long>, p array<long>, o array<long>").withColumn("ts", F.to_timestamp("at")).drop("at")


def test_whole_table_against_a_loop(spark):
    walks, rows = tables(random.Random(5))
    got = trajectories.gates(frame(spark, [*rows, rows[0], rows[0], (None, 1, None, *rows[0][3:])]), LANES).collect()
    assert {r.key: tuple(r)[1:] for r in got} == {k: plain(s) for k, s in walks.items()}
    assert len({r.gate for r in got}) == 3 and trajectories.gates(frame(spark, rows).limit(0), LANES).collect() == []


def feed(spark, folder, rows, k):
    frame(spark, rows).coalesce(1).write.mode("append").parquet(folder)


def test_shuffled_and_late_stream_with_restarts(spark, tmp_path):
    rng = random.Random(8)
    walks, rows = tables(rng)
    # Within the delay of 6 minutes anything may be out of order; batches follow time by and large.
    rows.sort(key=lambda r: int(r[2][14:16]) + rng.random() * 5)
    size = -(-len(rows) // 4)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    folder, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        ends = [[("~", 0, f"2024-01-01 0{h}:00:00", *rows[0][3:])] for h in (3, 5)]
        for k, part in enumerate([*parts, *ends]):
            feed(spark, folder, part, k)
            # Each batch is a run of its own, which starts from the checkpoint of the one before.
            stream = spark.readStream.schema(frame(spark, rows).schema).parquet(folder)
            query = trajectories.record(stream, "6 minutes", "20 minutes").writeStream.format("parquet").option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start(out)
            query.awaitTermination(300)
            assert query.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    told = spark.read.parquet(out).where("key <> '~'").collect()
    assert len(told) == len(walks) and {r.key: tuple(r)[1:] for r in told} == {k: plain(s) for k, s in walks.items()}
    whole = {r.key: tuple(r)[1:] for r in trajectories.gates(frame(spark, rows), LANES).collect()}
    assert whole == {r.key: tuple(r)[1:] for r in told}

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import qualia
from tessella.operators import waves


def test_carriers_come_back(spark):
    df = spark.range(2).select(F.col("id").alias("k"), F.array_repeat(F.lit(0), waves.SAMPLES).alias("c"))
    got = waves.read(waves.write(df, "k", "c", [(4, 1.0, 7.0), (10, 3.0, 7.0)]), "id", "container").collect()
    by = {(r.id, r.carrier): r for r in got}
    assert abs(by[0, 4].phase - 1.0) < 0.05 and abs(by[1, 10].phase - 3.0) < 0.05
    assert by[0, 4].amplitude > 20 and by[0, 6].amplitude < 1


def test_saturating_sum_keeps_order(spark):
    row = spark.range(1).select(waves.saturating_sum(F.array(*(F.array(F.lit(x)) for x in (100, 100, -50)))).alias("s")).first()
    assert row.s == [77]


def test_qualia_and_focus(spark):
    one = spark.range(1)
    x = F.array(*(F.lit(float(v)) for v in (1.0, -2.0, 0.5)))
    p = one.select(qualia.compress(x).alias("p")).select("p", qualia.hydrate(F.col("p")).alias("h"), qualia.dot(F.col("p"), qualia.invert(F.col("p"))).alias("d")).first()
    assert p.p.resonance == [64, -127, 32] and np.allclose(p.h, [1.0, -2.0, 0.5], atol=0.02) and p.d < 0
    zero = one.select(qualia.compress(F.array(F.lit(0.0))).alias("p")).first().p
    assert (zero.resonance, zero.magnitude) == ([0], 0.0)
    rng = np.random.default_rng(1)
    a, b, mask = rng.integers(0, 256, 2048), rng.integers(0, 256, 2048), (0b11, 0b101, 0xF000000F)
    inside = np.array([(mask[0] >> i // 256 & 1) and (mask[1] >> i // 32 % 8 & 1) and (mask[2] >> i % 32 & 1) for i in range(2048)], bool)
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<int>, b array<int>")
    r = df.select(qualia.focus("a", "b", mask, "xor").alias("x"), qualia.focus("a", "b", mask, "read").alias("r"), qualia.focus_distance("a", "b", mask).alias("d")).first()
    assert r.x == np.where(inside, a ^ b, a).tolist() and r.r == np.where(inside, a, 0).tolist()
    assert (r.d.l1, r.d.size) == (int(np.abs(a - b)[inside].sum()), int(inside.sum())) and r.d.size == qualia.mask_overlap(mask, mask)

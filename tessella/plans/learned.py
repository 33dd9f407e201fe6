"""Awareness, states, layers, binary neurons and binding cubes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import qualia
from ..operators import learning, recognition, waves
from ..functions.vectors import rounded
from ._registry import FP2, INT8, first_row, ham, lane, prints, query, signed8, table
from .fingerprints import _LANES, _lanes

_X = "xor(t[1], t[2])"
_STATE = f"CASE WHEN ({_X} & 32768) <> 0 THEN 'tensioned' WHEN bit_count(({_X} >> 7) & 255) > 2 THEN 'uncertain' WHEN bit_count({_X} & 127) > 1 AND (({_X} >> 7) & 255) = 0 THEN 'noise' ELSE 'crystallized' END"


@query(f"WITH l AS (SELECT vec_id, {_LANES} AS l FROM embeddings), s AS (SELECT p.vec_id, unnest(list_transform(list_zip(p.l, q.l), lambda t: {_STATE})) AS s FROM l p, l q WHERE q.vec_id = 0) SELECT vec_id, round(count_if(s = 'crystallized') / 64.0, 6)::DOUBLE AS crystallized, round(count_if(s = 'tensioned') / 64.0, 6)::DOUBLE AS tensioned, round(count_if(s = 'uncertain') / 64.0, 6)::DOUBLE AS uncertain, round(count_if(s = 'noise') / 64.0, 6)::DOUBLE AS noise FROM s GROUP BY vec_id")
def superposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _lanes(table(spark, sf_dir, "embeddings"))
    q = F.array(*(F.lit(x) for x in first_row(df, "lanes")))
    states = df.withColumn("s", learning.superposition([F.col("lanes"), q]))
    f = states.withColumn("f", learning.fractions(F.col("s")))
    return f.select("vec_id", *(rounded(f"f.{n}", 6).alias(n) for n in ("crystallized", "tensioned", "uncertain", "noise")))


@query()
def plastic_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signed8(spark, sf_dir).withColumn("state", learning.soak(F.col("v"), 8))
    return s.select("vec_id", "state.*", learning.five_state(F.col("state")).alias("five"))


@query(f"WITH {INT8}, d AS (SELECT p.vec_id, list_sum(list_transform(list_zip(p.v, q.v), lambda t: t[1] * t[2])) / 64.0 AS d FROM int8 p, int8 q WHERE q.vec_id = 0) SELECT vec_id, round(d, 5)::DOUBLE AS projection, CASE WHEN d > 10 THEN 'resonance' WHEN d < -10 THEN 'conflict' ELSE 'novel' END AS kind FROM d")
def attention_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = signed8(spark, sf_dir)
    mask = F.array(*(F.lit(x) for x in first_row(df, "v")))
    a = df.withColumn("a", learning.attention(mask, "v", 64, 10.0))
    return a.select("vec_id", rounded("a.projection", 5).alias("projection"), "a.kind")


@query(f"WITH {FP2}, g AS (SELECT vec_id // 4 AS g, vec_id, a, b FROM fp2), c AS (SELECT x.g, max(bit_count(x.a & y.a) + bit_count(x.b & y.b)) AS m FROM g x JOIN g y ON x.g = y.g AND x.vec_id < y.vec_id GROUP BY x.g) SELECT g.g, CAST(coalesce(max(c.m), 0) AS BIGINT) AS conflict, CASE WHEN coalesce(max(c.m), 0) > 24 THEN 'block' WHEN sum(bit_count(a) + bit_count(b)) = 0 THEN 'hold' ELSE 'flow' END AS gate FROM g LEFT JOIN c ON c.g = g.g GROUP BY g.g")
def layer_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four writers a stack."""
    stacks = prints(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 4).alias("g")).agg(F.collect_list("fp").alias("deltas"))
    return stacks.select("g", learning.max_conflict(F.col("deltas"), 2).alias("conflict"), learning.layer_gate(F.col("deltas"), 2, 24).alias("gate"))


@query(f"WITH {FP2}, w AS (SELECT vec_id AS i, a, b FROM fp2 WHERE vec_id < 8) SELECT p.vec_id, CAST(arg_min(q.i, {ham('p', 'q')} * 100 + q.i) AS INTEGER) AS winner, round(2 * (64 - min({ham('p', 'q')})) / 64.0 - 1, 6)::DOUBLE AS score FROM fp2 p, w q GROUP BY p.vec_id")
def bnn_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prints(spark, sf_dir)
    weights = [list(r.fp) for r in df.where("vec_id < 8").orderBy("vec_id").collect()]
    return learning.bnn_winner(df, weights, 64, 2).select("vec_id", "winner", rounded("score", 6).alias("score"))


@query(f"WITH {FP2} SELECT p.vec_id, round(2 * (64 - {ham('p', 'q')}) / 64.0 - 1, 6)::DOUBLE AS score FROM fp2 p, fp2 q WHERE q.vec_id = 0 AND p.vec_id % 3 = 0")
def bnn_conv1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stride 3: the positions are the feature."""
    df = prints(spark, sf_dir)
    return learning.bnn_conv1d(df, first_row(df, "fp"), 3, 64, "vec_id").select("vec_id", rounded("score", 6).alias("score"))


def _turn(v: str, k: str) -> str:
    return f"(CASE WHEN {k} = 0 THEN {v}.w ELSE (({v}.w << (4 * {k})) | ({v}.w >> (32 - 4 * {k}))) & 4294967295 END)"


@query(f"WITH f AS (SELECT vec_id, {lane(0)} AS w FROM embeddings), r AS (SELECT CAST(range AS INTEGER) AS k FROM range(8)) SELECT i.k AS i, j.k AS j, k.k AS k, CAST(bit_count(xor(xor({_turn('x', 'i.k')}, {_turn('y', 'j.k')}), {_turn('z', 'k.k')})) AS BIGINT) AS popcount FROM r i, r j, r k, f x, f y, f z WHERE x.vec_id = 0 AND y.vec_id = 1 AND z.vec_id = 2")
def binding_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prints(spark, sf_dir, 1, 32)
    x, y, z = (list(r.fp) for r in df.where("vec_id < 3").orderBy("vec_id").collect())
    return learning.binding_cube(spark, x, y, z, 8, 32)


def _templates(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """A class's template: its vector of least id."""
    rows = signed8(spark, sf_dir).groupBy("label").agg(F.min_by("v", "vec_id").alias("v")).orderBy("label").collect()
    return np.array([r.v for r in rows], float)


@query()
def sign_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = recognition.uniform_planes(64, 256, 42)
    return recognition.project(table(spark, sf_dir, "embeddings"), planes, "vec_id", "embedding", msb_first=True)


@query()
def recognize_orthogonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.recognize_orthogonal(signed8(spark, sf_dir), _templates(spark, sf_dir), "vec_id", "v")


@query()
def recognize_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes, templates = recognition.gaussian_planes(64, 512, 7), _templates(spark, sf_dir)
    prints_ = recognition.project(signed8(spark, sf_dir), planes, "vec_id", "v", msb_first=True)
    codes = [np.packbits(t.astype(np.float32) @ planes >= 0).tobytes() for t in templates]
    return recognition.recognize_hamming(prints_, codes)


@query("WITH e AS (SELECT vec_id, list_transform(list_slice(embedding, 1, 16), lambda x: x::DOUBLE) AS x FROM embeddings), m AS (SELECT *, list_max(list_transform(x, lambda v: abs(v))) AS t FROM e) SELECT vec_id, list_transform(x, lambda v: CAST(round(v * 127 / t) AS INTEGER)) AS resonance, round(t / 127, 8)::DOUBLE AS magnitude FROM m")
def qualia_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 16).alias("x"))
    p = e.withColumn("p", qualia.compress("x"))
    return p.select("vec_id", "p.resonance", rounded("p.magnitude", 8).alias("magnitude"))


@query("WITH b AS (SELECT i, min(v) AS lo, max(v) AS hi FROM (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings) WHERE i < 4 GROUP BY i), x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings) SELECT vec_id, list(CAST(least(15, greatest(0, round((v - lo) / (hi - lo) * 15))) AS INTEGER) ORDER BY i) AS nib FROM x JOIN b USING (i) GROUP BY vec_id")
def nibble_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualia.nibbles(table(spark, sf_dir, "embeddings"), "embedding", 4).select("vec_id", "nib")


@query()
def carrier_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three carriers written into empty containers and read back."""
    empty = table(spark, sf_dir, "embeddings").select("vec_id", F.array_repeat(F.lit(0), waves.SAMPLES).alias("c"))
    return waves.read(waves.write(empty, "vec_id", "c", [(3, 0.5, 7.0), (7, 2.0, 5.0), (9, 4.0, 3.0)]), "id", "container")

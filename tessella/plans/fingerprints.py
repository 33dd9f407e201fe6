"""Fingerprints: distances, scans, cascades, scores, hypervector algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.bits import slice_gate
from ..functions.register import register_all
from ..operators import hdc, search
from ..operators._cut import stored
from ..functions.vectors import rounded
from ._registry import CH4, FP2, INT8, channels, first_row, ham, lane, prints, query, signed8, table

GATE = slice_gate(64, probe0=32, probe1=64)


@query(f"WITH {FP2} SELECT p.vec_id, {ham('p', 'q')} AS d FROM fp2 p, fp2 q WHERE q.vec_id = 0 AND {ham('p', 'q')} <= 26")
def hamming_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prints(spark, sf_dir)
    return search.hamming_scan(df, first_row(df, "fp"), 26).select("vec_id", "d")


@query(f"WITH {FP2} SELECT p.vec_id, {ham('p', 'q')} AS d FROM fp2 p, fp2 q WHERE q.vec_id = 0 ORDER BY d, p.vec_id LIMIT 20")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prints(spark, sf_dir)
    return search.hamming_top_k(df, first_row(df, "fp"), 20).select("vec_id", "d")


@query(f"WITH {FP2} SELECT p.vec_id, {ham('p', 'q')} AS d FROM fp2 p, fp2 q WHERE q.vec_id = 0 AND {ham('p', 'q')} < 30 ORDER BY p.vec_id LIMIT 10")
def scan_first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prints(spark, sf_dir)
    return search.scan_first(df, first_row(df, "fp"), 30, 10).select("vec_id", "d")


@query(f"WITH {FP2} SELECT p.vec_id, round(1.0 - {ham('p', 'q')} / 64.0, 6)::DOUBLE AS similarity, CAST(bit_count(p.a) + bit_count(p.b) AS BIGINT) AS popcount FROM fp2 p, fp2 q WHERE q.vec_id = 0")
def similarity_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prints(spark, sf_dir)
    q = bits.literal(first_row(df, "fp"))
    return df.select("vec_id", rounded(bits.similarity("fp", q, 64, 2), 6).alias("similarity"), bits.popcount("fp", 2).alias("popcount"))


@query(f"WITH {FP2} SELECT p.vec_id, CAST(xor(p.a, q.a) AS BIGINT) AS x0, CAST(xor(p.b, q.b) AS BIGINT) AS x1, CAST(p.a & q.a AS BIGINT) AS and0, CAST(p.b | q.b AS BIGINT) AS or1 FROM fp2 p, fp2 q WHERE q.vec_id = 0")
def xor_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prints(spark, sf_dir)
    q = bits.literal(first_row(df, "fp"))
    return df.select("vec_id", bits.xor_bind("fp", q)[0].alias("x0"), bits.xor_bind("fp", q)[1].alias("x1"), bits.both("fp", q)[0].alias("and0"), bits.either("fp", q)[1].alias("or1"))


@query(f"WITH {FP2} SELECT p.vec_id, {ham('p', 'q')} AS d, round(1.0 - {ham('p', 'q')} / 128.0, 6)::DOUBLE AS s, CAST(bit_count(p.a) + bit_count(p.b) AS BIGINT) AS n FROM fp2 p, fp2 q WHERE q.vec_id = 1")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered SQL names; similarity counts whole 64-bit words."""
    register_all(spark)
    df = prints(spark, sf_dir)
    q = ", ".join(f"{w}L" for w in first_row(df, "fp", 1))
    return df.select("vec_id", F.expr(f"hamming(fp, array({q}))").alias("d"), F.expr(f"round(similarity(fp, array({q})), 6)").alias("s"), F.expr("popcount(fp)").alias("n"))


_CH = ("meta", "cam", "btree", "embed")
_D = {c: f"CAST(bit_count(xor(p.{c}, q.{c})) AS BIGINT)" for c in _CH}


@query(f"WITH {CH4} SELECT p.vec_id, {', '.join(f'{d} AS d_{c}' for c, d in _D.items())} FROM ch4 p, ch4 q WHERE q.vec_id = 0 AND {' AND '.join(f'{d} <= 8' for d in _D.values())}")
def cascade_4ch(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = channels(spark, sf_dir)
    q = df.where("vec_id = 0").first()
    return search.cascade(df, {c: list(q[c]) for c in _CH}, dict.fromkeys(_CH, 8)).select("vec_id", *(f"d_{c}" for c in _CH))


_E = f"{ham('p', 'q')} AS conflict, CAST(bit_count(p.a) + bit_count(p.b) AS BIGINT) AS energy_a, CAST(bit_count(q.a) + bit_count(q.b) AS BIGINT) AS energy_b, CAST(bit_count(p.a & q.a) + bit_count(p.b & q.b) AS BIGINT) AS agreement"


@query(f"WITH {FP2}, e AS (SELECT p.vec_id, {_E} FROM fp2 p, fp2 q WHERE q.vec_id = 0) SELECT *, round(coalesce(agreement / nullif(least(energy_a, energy_b), 0), 0), 6)::DOUBLE AS ratio, round(conflict / 64.0, 6)::DOUBLE AS density FROM e")
def energy_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prints(spark, sf_dir)
    e = df.withColumn("e", bits.energy("fp", bits.literal(first_row(df, "fp")), 2))
    return e.select("vec_id", "e.*", rounded(bits.agreement_ratio(F.col("e")), 6).alias("ratio"), rounded(bits.conflict_density(F.col("e"), 64), 6).alias("density"))


_HDR = f"(CASE WHEN conflict < {GATE.hot} THEN 3 ELSE 0 END + CASE WHEN conflict < {GATE.mid} THEN 2 ELSE 0 END + CASE WHEN conflict < {GATE.cold} THEN 1 ELSE 0 END)"
_SIGMA = "CASE WHEN conflict < 20 THEN 'discovery' WHEN conflict < 22 THEN 'strong' WHEN conflict < 24 THEN 'evidence' WHEN conflict < 26 THEN 'hint' ELSE 'noise' END"


@query(f"WITH {FP2}, e AS (SELECT p.vec_id, {_E} FROM fp2 p, fp2 q WHERE q.vec_id = 0) SELECT vec_id, CAST({_HDR} AS INTEGER) AS hdr, round((32 - conflict) / 4.0, 6)::DOUBLE AS z, {_SIGMA} AS tier FROM e")
def hdr_sigma_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prints(spark, sf_dir)
    d = bits.hamming("fp", bits.literal(first_row(df, "fp")), 2)
    s = df.withColumn("s", bits.sigma_score(d, 64))
    return s.select("vec_id", bits.hdr_score(d, GATE).alias("hdr"), rounded("s.z", 6).alias("z"), "s.tier")


@query(f"WITH {FP2}, e AS (SELECT p.vec_id, CAST(bit_count(xor(p.a, q.a)) AS BIGINT) AS d0, {_E} FROM fp2 p, fp2 q WHERE q.vec_id = 0) SELECT vec_id, conflict, agreement, CAST({_HDR} AS INTEGER) AS hdr FROM e WHERE d0 <= {GATE.k0} AND conflict <= {GATE.k1} AND {_HDR} > 0")
def kernel_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stored(prints(spark, sf_dir), "prints")
    return search.kernel_pipeline(df, first_row(df, "fp"), GATE).select("vec_id", "energy.conflict", "energy.agreement", "hdr")


@query(f"WITH {FP2}, e AS (SELECT CAST(bit_count(xor(p.a, q.a)) AS BIGINT) AS d0, {ham('p', 'q')} AS d FROM fp2 p, fp2 q WHERE q.vec_id = 0) SELECT count(*) AS n, CAST(count_if(d0 > 18) AS BIGINT) AS k0_rejected, CAST(count_if(d0 <= 18 AND d > {GATE.k1}) AS BIGINT) AS k1_rejected FROM e")
def pipeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prints(spark, sf_dir)
    gate = slice_gate(64, probe0=24, probe1=64)
    return search.pipeline_stats(df, first_row(df, "fp"), gate).select("n", "k0_rejected", "k1_rejected")


#: Lanes for the float distance by integer arithmetic: 16 bits of |x| * 2^14 with the sign on top.
_LANES = "list_transform(embedding, lambda x: CAST(CASE WHEN x < 0 THEN 32768 ELSE 0 END + floor(abs(x::DOUBLE) * 16384) AS BIGINT))"


def _lanes(df: DataFrame) -> DataFrame:
    lane_of = lambda x: (F.when(x < 0, 32768).otherwise(0) + F.floor(F.abs(x.cast("double")) * 16384)).cast("int")
    return df.select("vec_id", F.transform("embedding", lane_of).alias("lanes"))


_LANE_D = "CAST(list_sum(list_transform(list_zip(p.l, q.l), lambda t: (xor(t[1], t[2]) >> 15) * 256 + bit_count((xor(t[1], t[2]) >> 7) & 255) * 16 + bit_count(xor(t[1], t[2]) & 127))) AS BIGINT)"


@query(f"WITH l AS (SELECT vec_id, {_LANES} AS l FROM embeddings) SELECT p.vec_id, {_LANE_D} AS lane_d FROM l p, l q WHERE q.vec_id = 0")
def lane_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _lanes(table(spark, sf_dir, "embeddings"))
    q = F.array(*(F.lit(x) for x in first_row(df, "lanes")))
    return df.select("vec_id", bits.lane_distance("lanes", q).alias("lane_d"))


@query(f"WITH l AS (SELECT vec_id, {_LANES} AS l FROM embeddings), x AS (SELECT p.vec_id, unnest(list_transform(list_zip(p.l, q.l), lambda t: xor(t[1], t[2]))) AS x FROM l p, l q WHERE q.vec_id = 0) SELECT vec_id, CAST(sum(x >> 15) AS BIGINT) AS sign_flips, CAST(sum(bit_count((x >> 7) & 255)) AS BIGINT) AS exponent_bits, CAST(sum(bit_count(x & 127)) AS BIGINT) AS mantissa_bits, CAST(count_if(bit_count((x >> 7) & 255) >= 2) AS BIGINT) AS wide FROM x GROUP BY vec_id")
def structural_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _lanes(table(spark, sf_dir, "embeddings"))
    q = F.array(*(F.lit(x) for x in first_row(df, "lanes")))
    d = df.withColumn("d", bits.structural_diff("lanes", q))
    return d.select("vec_id", "d.sign_flips", "d.exponent_bits", "d.mantissa_bits", F.size("d.wide_dims").cast("long").alias("wide"))


@query(f"WITH {FP2}, l AS (SELECT vec_id, {_LANES} AS l FROM embeddings), e AS (SELECT p.vec_id, CAST(bit_count(xor(p.a, q.a)) AS BIGINT) AS d0, {_E} FROM fp2 p, fp2 q WHERE q.vec_id = 0), k AS (SELECT vec_id, conflict AS d FROM e WHERE d0 <= {GATE.k0} AND conflict <= {GATE.k1} AND {_HDR} > 0 ORDER BY d, vec_id LIMIT 100) SELECT k.vec_id, k.d, {_LANE_D} AS lane_d, round(k.d + 0.01 * {_LANE_D}, 4)::DOUBLE AS score FROM k JOIN l p ON p.vec_id = k.vec_id, l q WHERE q.vec_id = 0 ORDER BY k.d + 0.01 * {_LANE_D}, k.vec_id LIMIT 25")
def hybrid_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    lane_of = lambda x: (F.when(x < 0, 32768).otherwise(0) + F.floor(F.abs(x.cast("double")) * 16384)).cast("int")
    df = e.select("vec_id", bits.sign_lanes("embedding", 2, 32).alias("fp"), F.transform("embedding", lane_of).alias("lanes"))
    df = stored(df, "prints")
    out = search.hybrid_pipeline(df, first_row(df, "fp"), first_row(df, "lanes"), GATE, 25)
    return out.select("vec_id", "d", "lane_d", rounded("score", 4).alias("score"))


_COS = "list_sum(list_transform(list_zip(p.embedding, q.embedding), lambda t: t[1]::DOUBLE * t[2]::DOUBLE)) / (sqrt(list_sum(list_transform(p.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))))"


@query(f"SELECT p.vec_id, round({_COS}, 5)::DOUBLE AS cos FROM embeddings p, embeddings q WHERE q.vec_id = 0 ORDER BY {_COS} DESC, p.vec_id LIMIT 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return search.cosine_top_k(df, first_row(df, "embedding"), 10).select("vec_id", rounded("cos", 5).alias("cos"))


@query(f"WITH {INT8} SELECT p.vec_id, CAST(list_sum(list_transform(list_zip(p.v, q.v), lambda t: t[1] * t[2])) AS BIGINT) AS dot, CAST(list_sum(list_transform(list_zip(p.v, q.v), lambda t: abs(t[1] - t[2]))) AS BIGINT) AS l1, CAST(list_sum(list_transform(list_zip(list_sort(p.v), list_sort(q.v)), lambda t: abs(t[1] - t[2]))) AS BIGINT) AS wasserstein, CAST(list_sum(list_transform(list_zip(p.v, q.v), lambda t: least(abs(t[1] - t[2]), 256 - abs(t[1] - t[2])))) AS BIGINT) AS circular, CAST(len(list_filter(list_zip(p.v, q.v), lambda t: t[1] <> t[2])) AS BIGINT) AS symbols FROM int8 p, int8 q WHERE q.vec_id = 0")
def int8_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = signed8(spark, sf_dir)
    q = F.array(*(F.lit(x) for x in first_row(df, "v")))
    return df.select("vec_id", bits.dot_i8("v", q).alias("dot"), bits.l1_distance("v", q).alias("l1"), bits.l1_distance(F.array_sort("v"), F.array_sort(q)).alias("wasserstein"), bits.circular_distance("v", q).alias("circular"), bits.symbol_distance("v", q).alias("symbols"))


@query(f"WITH {INT8} SELECT p.vec_id, round(list_sum(list_transform(list_zip(p.v, q.v), lambda t: t[1] * t[2])) / (sqrt(list_sum(list_transform(p.v, lambda x: x * x))::DOUBLE) * sqrt(list_sum(list_transform(q.v, lambda x: x * x))::DOUBLE)), 6)::DOUBLE AS cos FROM int8 p, int8 q WHERE q.vec_id = 0")
def int8_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = signed8(spark, sf_dir)
    q = F.array(*(F.lit(x) for x in first_row(df, "v")))
    return df.select("vec_id", rounded(bits.cosine_i8("v", q), 6).alias("cos"))


@query(f"WITH {INT8} SELECT p.vec_id, list_transform(list_zip(p.v, q.v), lambda t: CAST((t[1] + t[2] + 512) % 256 AS INTEGER)) AS bound FROM int8 p, int8 q WHERE q.vec_id = 0")
def phase_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = signed8(spark, sf_dir)
    q = F.array(*(F.lit(x) for x in first_row(df, "v")))
    return df.select("vec_id", bits.phase_bind("v", q).alias("bound"))


def _majority(w: int) -> str:
    bit = lambda i: f"CASE WHEN sum((x{w} >> {i}) & 1) > count(*) // 2 THEN {1 << i}::BIGINT ELSE 0 END"
    return "CAST(" + " + ".join(bit(i) for i in range(32)) + " AS BIGINT)"


@query(f"WITH {FP2}, x AS (SELECT label, a AS x0, b AS x1 FROM fp2) SELECT label, count(*) AS n, {_majority(0)} AS m0, {_majority(1)} AS m1 FROM x GROUP BY label")
def bundle_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hdc.bundle_majority(prints(spark, sf_dir), ["label"], 2, 32)
    return out.select("label", "n", F.col("fp")[0].alias("m0"), F.col("fp")[1].alias("m1"))


@query(f"WITH {INT8}, x AS (SELECT label, unnest(v) AS x, unnest(range(64)) AS pos FROM int8) SELECT label, CAST(pos AS INTEGER) AS pos, CAST(least(127, greatest(-128, sum(x))) AS BIGINT) AS v FROM x GROUP BY ALL")
def bundle_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hdc.bundle_sum(signed8(spark, sf_dir), ["label"], -128, 127)


_ROT = "CAST(((a << 5) | (b >> 27)) & 4294967295 AS BIGINT)", "CAST(((b << 5) | (a >> 27)) & 4294967295 AS BIGINT)"


@query(f"WITH {FP2} SELECT vec_id, {_ROT[0]} AS r0, {_ROT[1]} AS r1 FROM fp2")
def permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rotated = bits.permute("fp", 5, 2, 32)
    return prints(spark, sf_dir).select("vec_id", rotated[0].alias("r0"), rotated[1].alias("r1"))


@query(f"WITH {FP2}, r AS (SELECT vec_id, a, b, {_ROT[0]} AS r0, {_ROT[1]} AS r1 FROM fp2) SELECT s.vec_id, CAST(xor(xor(s.r0, d.a), q.a) AS BIGINT) AS e0, CAST(xor(xor(s.r1, d.b), q.b) AS BIGINT) AS e1, CAST(s.a AS BIGINT) AS back0 FROM r s JOIN r d ON d.vec_id = s.vec_id + 1, r q WHERE q.vec_id = 0")
def edge_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prints(spark, sf_dir)
    role = bits.literal(first_row(df, "fp"))
    pairs = df.select("vec_id", F.col("fp").alias("s")).join(df.select((F.col("vec_id") - 1).alias("vec_id"), F.col("fp").alias("d")), "vec_id")
    edges = pairs.withColumn("e", hdc.encode_edge(F.col("s"), F.col("d"), role, 5, 2, 32))
    return edges.select("vec_id", F.col("e")[0].alias("e0"), F.col("e")[1].alias("e1"), hdc.decode_edge_source(F.col("e"), F.col("d"), role, 5, 2, 32)[0].alias("back0"))


@query("WITH " + FP2 + " SELECT s.vec_id, CAST(xor(s.a, p.a) AS BIGINT) AS sp, CAST(xor(p.a, o.a) AS BIGINT) AS po, CAST(xor(s.a, o.a) AS BIGINT) AS so, s.a AS subject FROM fp2 s JOIN fp2 p ON p.vec_id = s.vec_id + 1 JOIN fp2 o ON o.vec_id = s.vec_id + 2")
def spo_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prints(spark, sf_dir)
    back = lambda n, name: df.select((F.col("vec_id") - n).alias("vec_id"), F.col("fp").alias(name))
    rows = back(0, "s").join(back(1, "p"), "vec_id").join(back(2, "o"), "vec_id")
    rows = rows.withColumn("c", hdc.spo_encode(F.col("s"), F.col("p"), F.col("o")))
    return rows.select("vec_id", F.col("c.sp")[0].alias("sp"), F.col("c.po")[0].alias("po"), F.col("c.so")[0].alias("so"), hdc.spo_recover(F.col("c"), "s", "p", F.col("p"))[0].alias("subject"))


@query(f"WITH {FP2}, c AS (SELECT label AS entry, min(vec_id) AS vec_id FROM fp2 GROUP BY label), book AS (SELECT entry, a, b FROM c JOIN fp2 USING (vec_id)) SELECT p.vec_id AS id, arg_min(q.entry, {ham('p', 'q')} * 1000 + q.entry) AS entry, min({ham('p', 'q')}) AS d FROM fp2 p, book q GROUP BY p.vec_id")
def infer_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prints(spark, sf_dir)
    book = df.groupBy(F.col("label").alias("entry")).agg(F.min_by("fp", "vec_id").alias("fp"))
    return hdc.nearest_entry(df.select(F.col("vec_id").alias("id"), "fp"), book, 2)


@query(f"WITH {FP2}, b AS (SELECT vec_id, a AS fp FROM fp2) SELECT x.vec_id AS a, y.vec_id AS b, CAST(bit_count(xor(x.fp, y.fp)) AS BIGINT) AS d FROM b x JOIN b y ON x.vec_id < y.vec_id WHERE bit_count(xor(x.fp, y.fp)) < 6")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.similar_pairs(prints(spark, sf_dir, 1, 32), 6, 1)


_L0 = f"SELECT 0 AS level, vec_id // 32 AS \"row\", vec_id % 32 AS \"column\", {lane(0)} AS word FROM embeddings"


@query(f'WITH l0 AS ({_L0}), l1 AS (SELECT 1 AS level, "row" // 2 AS "row", "column" // 2 AS "column", bit_or(word) AS word FROM l0 GROUP BY ALL), l2 AS (SELECT 2 AS level, "row" // 2 AS "row", "column" // 2 AS "column", bit_or(word) AS word FROM l1 GROUP BY ALL) SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2')
def or_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = prints(spark, sf_dir).select(F.floor(F.col("vec_id") / 32).alias("r"), (F.col("vec_id") % 32).alias("c"), F.col("fp")[0].alias("w"))
    return hdc.or_pyramid(cells, "r", "c", "w", 2)


@query(f"WITH {FP2}, m AS (SELECT label, bit_or(a) AS ma, bit_or(b) AS mb FROM fp2 GROUP BY label) SELECT m.label, CAST(bit_count(q.a & ~ma) + bit_count(q.b & ~mb) AS BIGINT) AS bound FROM m, fp2 q WHERE q.vec_id = 0")
def lod_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prints(spark, sf_dir)
    q = bits.literal(first_row(df, "fp"))
    masks = df.groupBy("label").agg(F.array(F.bit_or(F.col("fp")[0]), F.bit_or(F.col("fp")[1])).alias("mask"))
    return masks.select("label", bits.or_mask_bound(q, "mask", 2).alias("bound"))


@query(f"WITH {FP2} SELECT label, CAST(bit_xor(a) AS BIGINT) AS x0, CAST(bit_xor(b) AS BIGINT) AS x1, CAST(bit_and(a) AS BIGINT) AS conflict FROM fp2 GROUP BY label")
def delta_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of XOR deltas collapsed onto their base, by label; bits that all layers set."""
    df = prints(spark, sf_dir)
    return df.groupBy("label").agg(F.bit_xor(F.col("fp")[0]).alias("x0"), F.bit_xor(F.col("fp")[1]).alias("x1"), F.bit_and(F.col("fp")[0]).alias("conflict"))


@query(f"""WITH {FP2}, near AS (SELECT p.vec_id AS id, CAST(count(*) AS BIGINT) AS links FROM fp2 p JOIN fp2 q ON p.vec_id <> q.vec_id AND {ham('p', 'q')} < 8 GROUP BY 1),
classes AS (SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY a, b) AS class_id FROM fp2)
SELECT id, class_id, coalesce(links, 0) AS links FROM classes LEFT JOIN near USING (id)""")
def similar_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's class of equal fingerprints and its links, over all 64 bits; pairs of copies are never made."""
    return search.similar_classes(prints(spark, sf_dir), 8, 2)

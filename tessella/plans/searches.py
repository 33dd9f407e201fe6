"""Indexed cascades, sweeps, gated coordinates, spatial distances and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, qualia
from ..functions.bits import slice_gate
from ..operators import gates, graph, indexed, learning, overlays, sweeps, temporal
from ..functions.vectors import rounded
from ._registry import CH4, FP2, INT8, channels, first_row, ham, prints, query, signed8, table

_CH = ("meta", "cam", "btree", "embed")
_D = {c: f"CAST(bit_count(xor(p.{c}, q.{c})) AS BIGINT)" for c in _CH}
_LIMITS = dict.fromkeys(_CH, 8)
_WITHIN = " AND ".join(f"{d} <= 8" for d in _D.values())


@query(f"WITH {CH4} SELECT p.vec_id, {', '.join(f'{d} AS d_{c}' for c, d in _D.items())} FROM ch4 p, ch4 q WHERE q.vec_id = 0 AND {_WITHIN}")
def indexed_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat cascade's rows through an index that half of the rows built and the others were inserted into."""
    df = channels(spark, sf_dir)
    index = indexed.insert(indexed.build(df.where("vec_id % 2 = 0"), list(_CH)), df.where("vec_id % 2 = 1"))
    q = df.where("vec_id = 0").first()
    return indexed.search(index, {c: list(q[c]) for c in _CH}, _LIMITS).select("vec_id", *(f"d_{c}" for c in _CH))


@query(f"WITH {CH4} SELECT q.vec_id AS query, p.vec_id AS id, {', '.join(f'{d} AS d_{c}' for c, d in _D.items())} FROM ch4 p, ch4 q WHERE q.vec_id % 100 = 0 AND {_WITHIN}")
def indexed_cascade_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100 as a query against all rows."""
    df = channels(spark, sf_dir)
    index = indexed.rebuild(indexed.build(df, list(_CH), 4), 16)
    return indexed.search_batch(index, df.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query"), _LIMITS)


@query(f"WITH {FP2} SELECT p.vec_id, {ham('p', 'q')} AS d FROM fp2 p, fp2 q WHERE q.vec_id = 0 AND {ham('p', 'q')} <= 26 AND p.label % 2 = 0")
def sweep_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prints(spark, sf_dir)
    return sweeps.horizontal_sweep_filtered(df, first_row(df, "fp"), 26, F.col("label") % 2 == 0).select("vec_id", "d")


_L1 = "CAST(list_sum(list_transform(list_zip(p.v, q.v), lambda t: abs(t[1] - t[2]))) AS BIGINT)"


@query(f"WITH {FP2}, {INT8} SELECT f.vec_id, {ham('f', 'g')} AS d, {_L1} AS dense FROM fp2 f JOIN int8 p USING (vec_id), fp2 g JOIN int8 q USING (vec_id) WHERE g.vec_id = 0 AND {ham('f', 'g')} <= 30 AND {_L1} <= 1200 ORDER BY {_L1}, f.vec_id LIMIT 40")
def hybrid_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prints(spark, sf_dir).join(signed8(spark, sf_dir).select("vec_id", "v"), "vec_id")
    dense = bits.l1_distance("v", F.array(*map(F.lit, first_row(df, "v"))))
    return sweeps.hybrid_cascade_sweep(df, first_row(df, "fp"), 30, dense, 1200, 40).select("vec_id", "d", "dense")


@query(f"WITH {INT8} SELECT p.vec_id, CAST(list_sum(list_transform(list_zip(p.v, q.v), lambda t: t[1]::BIGINT * t[2])) AS BIGINT) AS score FROM int8 p, int8 q WHERE q.vec_id = 0 ORDER BY score DESC, p.vec_id LIMIT 50")
def tier0_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = signed8(spark, sf_dir)
    return sweeps.tier0_prefilter(df, first_row(df, "v"), 50).select("vec_id", "score")


@query("WITH s AS (SELECT q.vec_id AS query, p.vec_id AS id, list_sum(list_transform(list_zip(p.embedding, q.embedding), lambda t: t[1]::DOUBLE * t[2]::DOUBLE)) AS score FROM embeddings p, embeddings q WHERE q.vec_id < 8) SELECT CAST(query AS INTEGER) AS query, id, round(score, 5)::DOUBLE + 0 AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY s.score DESC, id) <= 10")
def batch_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    queries = [list(r.embedding) for r in df.where("vec_id < 8").orderBy("vec_id").collect()]
    return sweeps.batch_top_k(df, queries, 10).withColumn("score", rounded("score", 5) + 0.0)


_TOP = "list_max(list_transform(x, lambda v: abs(v)))"
_CAM = f"cam AS (SELECT vec_id, list_transform(x, lambda v: CAST(least(127, greatest(-127, round(v * 127 / {_TOP}))) AS INTEGER)) AS v, {_TOP} / 127 AS m, ['flow', 'hold', 'block'][label % 3 + 1] AS gate FROM (SELECT vec_id, label, list_transform(embedding[1:16], lambda v: v::DOUBLE) AS x FROM embeddings))"


def _cam(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("p", qualia.compress(F.slice(F.col("embedding").cast("array<double>"), 1, 16)))
    gate = F.element_at(F.array(*map(F.lit, gates.GATES)), (F.col("label") % 3 + 1).cast("int"))
    return e.select("vec_id", "p.resonance", "p.magnitude", gate.alias("gate"))


@query(f"WITH {_CAM} SELECT p.vec_id, {_L1} AS d, p.gate FROM cam p, cam q WHERE q.vec_id = 3 ORDER BY d, p.vec_id LIMIT 15")
def qualia_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _cam(spark, sf_dir)
    return gates.locate(df, first_row(df, "resonance", 3), 15).select("vec_id", "d", "gate")


@query(f"WITH {_CAM} SELECT p.vec_id, {_L1} AS d FROM cam p, cam q WHERE q.vec_id = 3 AND {_L1} <= 900")
def qualia_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _cam(spark, sf_dir)
    return gates.locate_within(df, first_row(df, "resonance", 3), 900).select("vec_id", "d")


@query(f"WITH {_CAM}, s AS (SELECT p.vec_id, list_sum(list_transform(list_zip(p.v, q.v), lambda t: t[1]::BIGINT * t[2]))::DOUBLE * (p.m * q.m) AS dot FROM cam p, cam q WHERE q.vec_id = 3) SELECT vec_id, round(dot, 6)::DOUBLE + 0 AS dot FROM s ORDER BY s.dot DESC, vec_id LIMIT 15")
def qualia_resonant(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _cam(spark, sf_dir)
    q = df.where("vec_id = 3").first()
    return gates.locate_resonant(df, list(q.resonance), q.magnitude, 15).select("vec_id", (rounded("dot", 6) + 0.0).alias("dot"))


@query(f"WITH {_CAM} SELECT p.vec_id, {_L1} AS d, p.gate FROM cam p, cam q WHERE q.vec_id = 3 AND p.gate <> 'flow' AND {_L1} <= 1500 ORDER BY d, p.vec_id LIMIT 1")
def qualia_nearest_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _cam(spark, sf_dir)
    return gates.nearest_gated(df, first_row(df, "resonance", 3), 1500).select("vec_id", "d", "gate")


@query(f"WITH {_CAM} SELECT count_if(gate = 'flow')::BIGINT AS flow, count_if(gate = 'hold')::BIGINT AS hold, count_if(gate = 'block')::BIGINT AS block FROM cam")
def gate_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.gate_distribution(_cam(spark, sf_dir))


@query(f"WITH {_CAM} SELECT vec_id, gate, CAST(list_position(['flow', 'hold', 'block'], gate) - 1 AS BIGINT) AS severity, gate <> 'flow' AS dark FROM cam")
def gate_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _cam(spark, sf_dir)
    arc = lambda rows, dark: rows.select("vec_id", "gate", gates.severity(F.col("gate")).cast("long").alias("severity"), F.lit(dark).alias("dark"))
    return arc(gates.gated(df), True).unionByName(arc(gates.open_rows(df), False))


_LANES = "list_transform(embedding, lambda x: CAST(CASE WHEN x < 0 THEN 32768 ELSE 0 END + floor(abs(x::DOUBLE) * 16384) AS BIGINT))"
_AXIS = "CAST(list_sum(list_transform(list_zip(p.l[{0}:{1}], q.l[{0}:{1}]), lambda t: (xor(t[1], t[2]) >> 15) * 256 + bit_count((xor(t[1], t[2]) >> 7) & 255) * 16 + bit_count(xor(t[1], t[2]) & 127))) AS BIGINT)"
_SPACE = f"l AS (SELECT vec_id, {_LANES} AS l FROM embeddings), s AS (SELECT p.vec_id, {_AXIS.format(1, 21)} AS x, {_AXIS.format(22, 42)} AS y, {_AXIS.format(43, 63)} AS z FROM l p, l q WHERE q.vec_id = 0)"


def _axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lane = lambda x: (F.when(x < 0, 32768).otherwise(0) + F.floor(F.abs(x.cast("double")) * 16384)).cast("int")
    lanes = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lane).alias("l"))
    return lanes.select("vec_id", *(F.slice("l", 21 * i + 1, 21).alias(a) for i, a in enumerate(("ax", "ay", "az"))))


@query(f"WITH {_SPACE} SELECT vec_id, x, y, z, x + y + z AS l1, greatest(x, y, z) AS linf, CASE WHEN x >= y AND x >= z THEN 'x' WHEN y >= z THEN 'y' ELSE 'z' END AS dominant, round(CASE WHEN x + y + z = 0 THEN 1 ELSE 1 - (greatest(x, y, z) / (x + y + z) - 1 / 3) * 1.5 END, 6)::DOUBLE AS balance FROM s")
def spatial_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _axes(spark, sf_dir)
    q = df.where("vec_id = 0").first()
    d = df.withColumn("d", sweeps.axis_distances([F.col(a) for a in ("ax", "ay", "az")], [list(q[a]) for a in ("ax", "ay", "az")])).withColumn("s", sweeps.spatial_scores(F.col("d")))
    return d.select("vec_id", "d.x", "d.y", "d.z", "s.l1", "s.linf", "s.dominant", rounded("s.balance", 6).alias("balance"))


@query(f"WITH {_SPACE} SELECT vec_id, x, y, z, x + y + z AS total FROM s WHERE x + y + z <= 11000")
def spatial_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _axes(spark, sf_dir)
    q = df.where("vec_id = 0").first()
    out = sweeps.spatial_sweep(df, ["ax", "ay", "az"], [list(q[a]) for a in ("ax", "ay", "az")], 11000)
    return out.select("vec_id", "d.x", "d.y", "d.z", F.col("score.l1").alias("total"))


_TIER = "CASE WHEN t < 32 - 3 * 4 THEN 'discovery' WHEN t < 32 - 2.5 * 4 THEN 'strong' WHEN t < 32 - 2 * 4 THEN 'evidence' WHEN t < 32 - 1.5 * 4 THEN 'hint' ELSE 'noise' END"


@query(f"WITH {FP2}, s AS (SELECT *, lag(a) OVER o AS pa, lag(b) OVER o AS pb FROM fp2 WINDOW o AS (PARTITION BY label ORDER BY vec_id)), c AS (SELECT label, vec_id, CAST(bit_count(xor(a, pa)) AS BIGINT) AS c0, CAST(bit_count(xor(b, pb)) AS BIGINT) AS c1, CAST(bit_count(xor(a, pa)) + bit_count(xor(b, pb)) AS BIGINT) AS t FROM s WHERE pa IS NOT NULL) SELECT label, vec_id, [c0, c1] AS correction, t AS total, {_TIER} AS tier FROM c")
def ewm_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.ewm_correction(prints(spark, sf_dir), ["label"], "vec_id", "fp", 2, 32)


def _links() -> str:
    plane = {"s": "meta", "p": "cam", "o": "btree"}
    one = "SELECT label, vec_id, '{0}' AS cause, '{1}' AS effect, e_{0} / 16.0::DOUBLE AS confidence FROM w WHERE e_{0} > 2 * l_{0} AND l_{1} > 2 * e_{1}"
    acts = ", ".join(f"CAST(bit_count(xor({c}, lag({c}) OVER o)) AS BIGINT) AS {p}" for p, c in plane.items())
    pairs = ", ".join(f"{p} AS e_{p}, lead({p}) OVER o AS l_{p}" for p in plane)
    return (
        f"WITH {CH4}, a AS (SELECT label, ch4.vec_id, {acts} FROM ch4 JOIN embeddings USING (vec_id) WINDOW o AS (PARTITION BY label ORDER BY ch4.vec_id)), "
        f"w AS (SELECT label, vec_id, {pairs} FROM a WHERE s IS NOT NULL WINDOW o AS (PARTITION BY label ORDER BY vec_id)) " + " UNION ALL ".join(one.format(a, b) for a in plane for b in plane if a != b)
    )


@query(_links())
def causal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which plane's quietening goes with which plane's waking, between successive vectors of a label."""
    df = channels(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    plane = {"s": "meta", "p": "cam", "o": "btree"}
    from pyspark.sql import Window

    order = Window.partitionBy("label").orderBy("vec_id")
    acts = {p: F.bit_count(F.col(c)[0].bitwiseXOR(F.lag(F.col(c)[0]).over(order))).cast("long") for p, c in plane.items()}
    activity = df.select("label", "vec_id", *(v.alias(p) for p, v in acts.items())).where("s is not null")
    return temporal.causal_links(activity, ["label"], "vec_id", {p: p for p in plane}, 16)


@query(f"WITH {CH4} SELECT p.vec_id, CAST({' + '.join(_D.values())} AS BIGINT) AS d, 1 - ({' + '.join(_D.values())}) / 256.0::DOUBLE AS similarity FROM ch4 p, ch4 q WHERE q.vec_id = 0")
def partial_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance over the first words of four channels."""
    df = channels(spark, sf_dir)
    q = df.where("vec_id = 0").first()
    a, b = [F.col(c) for c in _CH], [bits.literal(list(q[c])) for c in _CH]
    return df.select("vec_id", bits.partial_hamming(a, b, 1, 64).alias("d"), bits.partial_similarity(a, b, 1, 64).alias("similarity"))


def _trace() -> str:
    """Three steps of the trace; a step is asked only while those before it were confident."""
    ask = "xor(xor(p.a, {0}.a), r.a)", "xor(xor(p.b, {0}.b), r.b)"
    d = "CAST(bit_count(" + ask[0] + ") + bit_count(" + ask[1] + ") AS BIGINT)"
    step = "s{1} AS (SELECT {1} AS step, p.vec_id AS id, p.a, p.b, " + d + " AS d FROM fp2 p, {0}, fp2 r WHERE r.vec_id = 1{2} ORDER BY d, id LIMIT 1)"
    parts = [step.format("o", 0, ""), step.format("s0", 1, " AND s0.d / 64 < 0.35"), step.format("s1", 2, " AND s1.d / 64 < 0.35")]
    union = " UNION ALL ".join(f"SELECT CAST(step AS INTEGER) AS step, id, d, d / 64 < 0.35 AS confident FROM s{i}" for i in range(3))
    return f"WITH {FP2}, o AS (SELECT * FROM fp2 WHERE vec_id = 0), {', '.join(parts)} {union}"


@query(_trace())
def reverse_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prints(spark, sf_dir)
    entities = df.select(F.col("vec_id").alias("id"), "fp")
    return graph.reverse_trace(entities, first_row(df, "fp"), first_row(df, "fp", 1), 2, 3, 0.35, 32)


_BIND = "list_transform(list_zip(p.v, t.v), lambda t: least(7, greatest(-7, t[1] + t[2])))"
_COS = "coalesce(list_sum(list_transform(list_zip(b, {0}), lambda t: t[1]::DOUBLE * t[2])) / nullif(sqrt(list_sum(list_transform(b, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform({0}, lambda x: x::DOUBLE * x))), 0), 0)"


@query(f"WITH {INT8}, n AS (SELECT vec_id, (vec_id * 7 + 3) % 50 AS other FROM int8), near AS (SELECT CASE WHEN vec_id = 5 THEN other ELSE vec_id END AS x FROM n WHERE vec_id = 5 OR other = 5), g AS (SELECT p.vec_id, {_BIND} AS b, c.v AS c, list_transform(r.embedding, lambda x: x::DOUBLE) AS r FROM int8 p, int8 t, int8 c, embeddings r WHERE t.vec_id = 5 AND c.vec_id = 1 AND r.vec_id = 2 AND p.vec_id <> 5 AND p.vec_id NOT IN (SELECT x FROM near)), s AS (SELECT vec_id, {_COS.format('c')} AS direct, {_COS.format('r')} AS signal FROM g) SELECT vec_id AS node, round(direct, 6)::DOUBLE + 0 AS direct, round(signal, 6)::DOUBLE + 0 AS signal FROM s ORDER BY abs(s.signal) DESC, vec_id LIMIT 20")
def entity_ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes without an edge to one entity, by how strongly their binding answers a residual."""
    s = signed8(spark, sf_dir)
    nodes = s.select(F.col("vec_id").alias("node"), "v")
    edges = nodes.select(F.col("node").alias("src"), ((F.col("node") * 7 + 3) % 50).alias("dst"))
    residual = [float(x) for x in first_row(table(spark, sf_dir, "embeddings"), "embedding", 2)]
    out = graph.probe_entity(nodes, edges, 5, first_row(s, "v", 1), residual, 20)
    return out.select("node", (rounded("direct", 6) + 0.0).alias("direct"), (rounded("signal", 6) + 0.0).alias("signal"))


_LAYERS = f"{FP2}, l AS (SELECT label, max(CASE WHEN k = 1 THEN a END) AS g, max(CASE WHEN k = 2 THEN a END) AS x, max(CASE WHEN k = 3 THEN a END) AS y, max(CASE WHEN k = 4 THEN a END) AS z FROM (SELECT label, a, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM fp2) WHERE k <= 4 GROUP BY label HAVING count(*) = 4)"


@query(f"WITH {_LAYERS} SELECT label, CAST(xor(xor(xor(g, x), y), z) AS BIGINT) AS whole, CAST(xor(xor(g, x), y) AS BIGINT) AS through1, CAST(xor(g, y) AS BIGINT) AS ground, CAST(xor(xor(g, x), xor(y, z)) AS BIGINT) AS after, CAST(bit_count(xor(xor(x, y), z)) AS BIGINT) AS changed FROM l")
def layer_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ground and three layers for each label, from its first four vectors: read, collapsed, read again."""
    p = prints(spark, sf_dir).select("label", "vec_id", F.array(F.col("fp")[0]).alias("w"))
    first = p.groupBy("label").agg(F.slice(F.array_sort(F.collect_list(F.struct("vec_id", "w"))), 1, 4).alias("r")).where("size(r) = 4")
    l = first.select("label", F.col("r")[0]["w"].alias("ground"), F.transform(F.slice("r", 2, 3), lambda e: e["w"]).alias("deltas"))
    c = l.withColumn("c", learning.collapse_layer("ground", "deltas", 1))
    return c.select(
        "label", learning.read_through("ground", "deltas")[0].alias("whole"), learning.read_through("ground", "deltas", F.lit(1))[0].alias("through1"),
        F.col("c.ground")[0].alias("ground"), learning.read_through(F.col("c.ground"), F.col("c.deltas"))[0].alias("after"), learning.changed_bits("ground", "deltas", 1).alias("changed"),
    )


_GATE = slice_gate(64)


@query(f"WITH {FP2}, m AS (SELECT p.vec_id, {ham('p', 'q')} AS d, CAST(bit_count(xor(p.a, q.a)) AS BIGINT) AS d0 FROM fp2 p, fp2 q WHERE q.vec_id = 0) SELECT vec_id, 64 - d AS matches, 2.0::DOUBLE * (64 - d) / 64.0::DOUBLE - 1 AS score FROM m WHERE d0 <= {_GATE.k0} AND d <= {_GATE.k1} AND d < {_GATE.cold} ORDER BY d, vec_id LIMIT 30")
def bnn_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prints(spark, sf_dir)
    return learning.bnn_cascade_search(df, first_row(df, "fp"), 30, _GATE, 64).select("vec_id", "matches", "score")


@query(f"WITH {CH4} SELECT p.vec_id, 2.0::DOUBLE * (48 - (bit_count(xor(p.meta, q.meta)) + bit_count(xor(p.cam, q.cam)) + bit_count(xor(p.btree, q.btree)))) / 48.0::DOUBLE - 1 AS score FROM ch4 p, ch4 q WHERE q.vec_id = 0 AND p.vec_id % 3 = 0")
def bnn_conv1d_3ch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels as one kernel, at every third position: the stride is the operator's."""
    df = channels(spark, sf_dir)
    q = df.where("vec_id = 0").first()
    return learning.bnn_conv1d_channels(df, {c: list(q[c]) for c in _CH[:3]}, 3, 48, "vec_id").select("vec_id", "score")


@query(f"WITH l AS (SELECT vec_id, {_LANES} AS l FROM embeddings), x AS (SELECT p.vec_id, list_transform(list_zip(p.l, q.l), lambda t: xor(t[1], t[2])) AS x FROM l p, l q WHERE q.vec_id = 0) SELECT vec_id, CASE WHEN list_sum(list_transform(x, lambda v: v >> 15)) < 4 AND list_sum(list_transform(x, lambda v: bit_count((v >> 7) & 255))) < 4 THEN 2 ELSE 1 END AS band FROM x")
def refined_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    lane = lambda x: (F.when(x < 0, 32768).otherwise(0) + F.floor(F.abs(x.cast("double")) * 16384)).cast("int")
    lanes = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lane).alias("l"))
    return lanes.select("vec_id", bits.refine_cold("l", F.array(*map(F.lit, first_row(lanes, "l")))).alias("band"))


_DELTAS = f"{FP2}, d AS (SELECT label AS id, vec_id % 3 AS writer, vec_id AS version, a AS x, b & 255 AS y FROM fp2 WHERE vec_id >= 10), base AS (SELECT DISTINCT label AS id, label * 77 AS x, label * 1001 AS y FROM fp2)"


def _overlay(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = prints(spark, sf_dir)
    words = F.array(F.col("fp")[0], F.col("fp")[1].bitwiseAND(F.lit(255).cast("long")))
    deltas = p.where("vec_id >= 10").select(F.col("label").alias("id"), (F.col("vec_id") % 3).alias("writer"), F.col("vec_id").alias("version"), words.alias("delta"))
    base = p.select(F.col("label").alias("id")).distinct()
    return base.select("id", F.array((F.col("id") * 77).cast("long"), (F.col("id") * 1001).cast("long")).alias("fp")), deltas


@query(f"WITH {_DELTAS}, m AS (SELECT id, bit_xor(x) AS x, bit_xor(y) AS y FROM d WHERE version <= 200 GROUP BY id) SELECT b.id, CAST(xor(b.x, coalesce(m.x, 0)) AS BIGINT) AS x, CAST(xor(b.y, coalesce(m.y, 0)) AS BIGINT) AS y FROM base b LEFT JOIN m USING (id)")
def overlay_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base through its overlays, rewound to a version, flushed and read."""
    base, deltas = _overlay(spark, sf_dir)
    flushed, left = overlays.flush(base, overlays.rewind(deltas, min(200, overlays.snapshot(deltas))), 2)
    out = overlays.read_full(flushed, left, 2)
    return out.select("id", F.col("fp")[0].alias("x"), F.col("fp")[1].alias("y"))


_WRITERS = f"{_DELTAS}, w AS (SELECT id, writer, bit_xor(x) AS x, bit_xor(y) AS y FROM d GROUP BY id, writer), p AS (SELECT id, {', '.join(f'coalesce(max(CASE WHEN writer = {k} THEN {c} END), 0) AS {c}{k}' for c in 'xy' for k in range(3))} FROM w GROUP BY id), t AS (SELECT *, (x0 & x1) | (x0 & x2) | (x1 & x2) AS tx, (y0 & y1) | (y0 & y2) | (y1 & y2) AS ty FROM p)"


@query(f"WITH {_WRITERS} SELECT id, CAST(tx AS BIGINT) AS x, CAST(ty AS BIGINT) AS y, CAST(bit_count(tx) + bit_count(ty) AS BIGINT) AS bits, CASE WHEN bit_count(tx) + bit_count(ty) > 18 THEN 'block' WHEN (x0 | x1 | x2 | y0 | y1 | y2) = 0 THEN 'hold' ELSE 'flow' END AS gate FROM t")
def overlay_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, deltas = _overlay(spark, sf_dir)
    return overlays.conflict_map(deltas, 2, 18).select("id", F.col("conflict")[0].alias("x"), F.col("conflict")[1].alias("y"), "bits", "gate")


@query(f"WITH {_WRITERS}, f AS (SELECT id, xor(xor(x0, x1), x2) AS x, xor(xor(y0, y1), y2) AS y FROM t WHERE bit_count(tx) + bit_count(ty) <= 18 AND (x0 | x1 | x2 | y0 | y1 | y2) <> 0) SELECT b.id, CAST(xor(b.x, coalesce(f.x, 0)) AS BIGINT) AS x, CAST(xor(b.y, coalesce(f.y, 0)) AS BIGINT) AS y FROM base b LEFT JOIN f USING (id)")
def overlay_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, deltas = _overlay(spark, sf_dir)
    return overlays.commit(base, deltas, 2, 18).select("id", F.col("fp")[0].alias("x"), F.col("fp")[1].alias("y"))


@query(f"WITH {FP2}, e AS (SELECT p.vec_id, {ham('p', 'q')} AS c FROM fp2 p, fp2 q WHERE q.vec_id = 0) SELECT vec_id, c AS conflict, c >= {_GATE.anti} AS anti, c / 64.0::DOUBLE AS density FROM e")
def anti_resonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prints(spark, sf_dir)
    e = df.withColumn("e", bits.energy("fp", bits.literal(first_row(df, "fp")), 2))
    return e.select("vec_id", "e.conflict", (F.col("e.conflict") >= _GATE.anti).alias("anti"), bits.conflict_density(F.col("e"), 64).alias("density"))


_EWM = f"{FP2}, s AS (SELECT *, lag(a) OVER o AS pa, lag(b) OVER o AS pb FROM fp2 WINDOW o AS (PARTITION BY label ORDER BY vec_id)), c AS (SELECT label, vec_id, CAST(bit_count(xor(a, pa)) AS BIGINT) AS c0, CAST(bit_count(xor(b, pb)) AS BIGINT) AS c1 FROM s WHERE pa IS NOT NULL)"


@query(f"WITH {_EWM}, l AS (SELECT label, vec_id, 0 AS word, c0 AS v FROM c UNION ALL SELECT label, vec_id, 1, c1 FROM c), w AS (SELECT *, lag(v, 1) OVER o AS p, lag(v, 2) OVER o AS q FROM l WINDOW o AS (PARTITION BY label, word ORDER BY vec_id)), g AS (SELECT label, word, arg_min(v, vec_id) AS first, arg_max(v, vec_id) AS last, CAST(count_if(v <> p AND (v > p) <> (p > q)) AS BIGINT) AS turns FROM w GROUP BY label, word HAVING count(*) > 1) SELECT label, CAST(word AS INTEGER) AS word, first, last, turns, CASE WHEN turns >= 2 THEN 'contested' WHEN last + 2 < first THEN 'crystallizing' WHEN last > first + 2 THEN 'dissolving' ELSE 'steady' END AS trend FROM g")
def saliency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.saliency(temporal.ewm_correction(prints(spark, sf_dir), ["label"], "vec_id", "fp", 2, 32), ["label"], "vec_id")

"""Edges by verb, bindings, sign forms, circular bundles, masked volumes, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, qualia, truth, volumes
from ..operators import graph, hdc
from ..operators._cut import dealt, stored
from ..functions.vectors import rounded
from ._registry import FP2, INT8, prints, query, signed8, table


def _rot(a: str, b: str, k: int) -> tuple[str, str]:
    """Both 32-bit lanes of the 64 bits rotated by k < 32."""
    return f"CAST((({a} << {k}) | ({b} >> {32 - k})) & 4294967295 AS BIGINT)", f"CAST((({b} << {k}) | ({a} >> {32 - k})) & 4294967295 AS BIGINT)"


def _verb(s: str, d: str, k: int) -> tuple[str, str]:
    one, two = _rot(f"{s}.a", f"{s}.b", k), _rot(f"{d}.a", f"{d}.b", 2 * k)
    return tuple(f"xor(xor({s}.{c}, {one[i]}), {two[i]})" for i, c in enumerate("ab"))


_F, _R = _verb("s", "d", 5), _verb("d", "s", 5)


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fingerprint and the next one by id."""
    p = prints(spark, sf_dir)
    return p.select("vec_id", F.col("fp").alias("s")).join(p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("fp").alias("d")), "vec_id")


@query(f"WITH {FP2} SELECT s.vec_id, CAST({_F[0]} AS BIGINT) AS e0, CAST({_F[1]} AS BIGINT) AS e1, d.a AS back0, d.b AS back1, (bit_count(xor({_F[0]}, {_R[0]})) + bit_count(xor({_F[1]}, {_R[1]}))) / 64.0::DOUBLE AS asymmetry FROM fp2 s JOIN fp2 d ON d.vec_id = s.vec_id + 1")
def verb_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by one verb, the targets decoded from them, and how far an edge is from its reverse."""
    p = _neighbours(spark, sf_dir).withColumn("e", hdc.encode_verb(F.col("s"), "REFINES", F.col("d"), 2, 32))
    back = hdc.decode_target(F.col("e"), F.col("s"), "REFINES", 2, 32)
    asymmetry = hdc.causality_asymmetry(F.col("s"), "REFINES", F.col("d"), 2, 32)
    return p.select("vec_id", F.col("e")[0].alias("e0"), F.col("e")[1].alias("e1"), back[0].alias("back0"), back[1].alias("back1"), asymmetry.alias("asymmetry"))


@query(f"WITH {FP2} SELECT vec_id, CAST(2 * (bit_count(a) + bit_count(b)) - 64 AS BIGINT) AS total, a AS w0, b AS w1 FROM fp2")
def sign_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prints(spark, sf_dir).withColumn("signs", bits.to_signs("fp", 64, 32))
    back = bits.from_signs("signs", 2, 32)
    return p.select("vec_id", F.aggregate("signs", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), back[0].alias("w0"), back[1].alias("w1"))


_PAIR8 = f"{INT8}, p AS (SELECT a.vec_id, list_transform(list_zip(a.v, b.v), lambda t: {{0}}) AS v FROM int8 a JOIN int8 b ON b.vec_id = a.vec_id + 1)"


def _pairs8(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signed8(spark, sf_dir)
    return s.select("vec_id", F.col("v").alias("x")).join(s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("y")), "vec_id")


_XY = f"WITH {INT8}, p AS (SELECT a.vec_id, list_zip(a.v, b.v) AS z FROM int8 a JOIN int8 b ON b.vec_id = a.vec_id + 1)"


@query(f"{_XY} SELECT vec_id, list_transform(z, lambda t: CAST(((t[1] + 128) + (t[2] + 128)) % 256 AS INTEGER)) AS u, list_transform(z, lambda t: CAST(least(7, greatest(-7, t[1] + t[2])) AS INTEGER)) AS s, list_transform(z, lambda t: CAST(xor(t[1] + 128, t[2] + 128) AS INTEGER)) AS b, list_transform(z, lambda t: CAST(t[1] + 128 AS INTEGER)) AS back FROM p")
def symbol_binds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three bases, and a phase bound and unbound again."""
    p = _pairs8(spark, sf_dir)
    up = lambda c: F.transform(c, lambda v: v + 128)
    bound = bits.symbol_bind(up("x"), up("y"), "unsigned", 256)
    return p.select("vec_id", bound.alias("u"), bits.symbol_bind("x", "y", "signed", 15).alias("s"), bits.symbol_bind(up("x"), up("y"), "binary").alias("b"), bits.phase_unbind(bits.phase_bind(up("x"), up("y")), up("y")).alias("back"))


@query(f"WITH {INT8}, l AS (SELECT label, unnest(range(64)) AS pos, unnest(v) * 2 * pi() / 256 AS angle FROM int8) SELECT label, CAST(pos AS INTEGER) AS pos, CAST((CAST(round(atan2(sum(sin(angle)), sum(cos(angle))) * 256 / (2 * pi())) AS INTEGER) + 256) % 256 AS INTEGER) AS v FROM l GROUP BY label, pos")
def bundle_circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hdc.bundle_circular(signed8(spark, sf_dir), ["label"]).select("label", "pos", F.col("v").cast("int").alias("v"))


_TOP = "list_max(list_transform(x, lambda v: abs(v)))"
_PACK = f"pk AS (SELECT vec_id, label, list_transform(x, lambda v: CAST(least(127, greatest(-127, round(v * 127 / {_TOP}))) AS INTEGER)) AS r, {_TOP} / 127 AS m FROM (SELECT vec_id, label, list_transform(embedding[1:16], lambda v: v::DOUBLE) AS x FROM embeddings))"


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.slice(F.col("embedding").cast("array<double>"), 1, 16).alias("x"))
    return e.select("vec_id", "label", qualia.compress("x").alias("p"))


@query(f"WITH {_PACK}, s AS (SELECT label, i, sum(r * m) AS s FROM (SELECT label, unnest(range(16)) AS i, unnest(r) AS r, m FROM pk) GROUP BY label, i), t AS (SELECT *, max(abs(s)) OVER (PARTITION BY label) AS top FROM s) SELECT label, round(max(top) / 127, 6)::DOUBLE AS magnitude, CAST(sum(round(s * 127 / top)) AS BIGINT) AS total FROM t GROUP BY label")
def qualia_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = qualia.bundle(_packed(spark, sf_dir), ["label"], "p")
    total = F.aggregate("p.resonance", F.lit(0).cast("long"), lambda a, v: a + v)
    return b.select("label", rounded("p.magnitude", 6).alias("magnitude"), total.alias("total"))


@query(f"WITH {_PACK} SELECT p.vec_id, round(list_sum(list_transform(list_zip(p.r, q.r), lambda t: t[1] * t[2])) * p.m * q.m, 6)::DOUBLE + 0 AS dot, round(-p.m, 8)::DOUBLE AS turned, (p.r[2] < 0)::INTEGER + (p.r[4] < 0)::INTEGER + (p.r[6] < 0)::INTEGER >= 2 AS causing FROM pk p, pk q WHERE q.vec_id = 0")
def qualia_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _packed(spark, sf_dir)
    q = p.where("vec_id = 0").first()["p"]
    other = F.struct(F.array(*map(F.lit, q.resonance)).alias("resonance"), F.lit(q.magnitude).alias("magnitude"))
    return p.select("vec_id", (rounded(qualia.dot(F.col("p"), other), 6) + 0.0).alias("dot"), rounded(qualia.invert(F.col("p"))["magnitude"], 8).alias("turned"), qualia.causing(F.col("p"), [1, 3, 5]).alias("causing"))


_MASK = (0b10100110, 0b01110001, 0b11110000111100001111000011110000)
_IN = f"((({_MASK[0]} >> (i // 256)) & 1) = 1 AND (({_MASK[1]} >> ((i // 32) % 8)) & 1) = 1 AND (({_MASK[2]}::BIGINT >> (i % 32)) & 1) = 1)"
_VOLUME = "v AS (SELECT s_suppkey AS id, i, CAST((i * 7 + s_suppkey * 13) % 256 AS INTEGER) AS p, CAST((i * 5 + s_suppkey * 29 + 3) % 256 AS INTEGER) AS q FROM supplier, (SELECT unnest(range(2048)) AS i))"


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two volumes of 2,048 bytes for each supplier."""
    i = F.sequence(F.lit(0), F.lit(2047))
    byte = lambda a, b, c: F.transform(i, lambda x: ((x * a + F.col("s_suppkey") * b + c) % 256).cast("int"))
    suppliers = dealt(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", rows=1024)
    return suppliers.select(F.col("s_suppkey").alias("id"), byte(7, 13, 0).alias("p"), byte(5, 29, 3).alias("q"))


@query(f"WITH {_VOLUME}, c AS (SELECT id, i, p, CASE WHEN {_IN} THEN xor(p, q) ELSE p END AS x, CASE WHEN {_IN} THEN (p + q) % 256 ELSE p END AS a, CASE WHEN {_IN} THEN (p - q + 256) % 256 ELSE p END AS s, CASE WHEN {_IN} THEN p ELSE 0 END AS r FROM v) SELECT id, CAST(sum(x * (i + 1)) AS BIGINT) AS xored, CAST(sum(a * (i + 1)) AS BIGINT) AS added, CAST(sum(s * (i + 1)) AS BIGINT) AS taken, CAST(sum(r * (i + 1)) AS BIGINT) AS seen FROM c GROUP BY id")
def focus_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four masked operations, each as a sum of value times position."""
    v = _volumes(spark, sf_dir)
    weigh = lambda x: F.aggregate(F.transform(x, lambda b, i: (b * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda a, y: a + y)
    return v.select("id", *(weigh(qualia.focus("p", "q", _MASK, op)).alias(name) for op, name in (("xor", "xored"), ("add", "added"), ("sub", "taken"), ("read", "seen"))))


@query(f"WITH {_VOLUME} SELECT id, CAST(sum(bit_count(xor(p, q))) AS BIGINT) AS hamming, CAST(sum(abs(p - q)) AS BIGINT) AS l1, count(*) AS size FROM v WHERE {_IN} GROUP BY id")
def focus_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _volumes(spark, sf_dir).select("id", qualia.focus_distance("p", "q", _MASK).alias("d")).select("id", "d.hamming", "d.l1", "d.size")


@query(f"WITH {FP2}, e AS (SELECT vec_id AS src, (vec_id * 7 + 3) % (SELECT count(*) FROM fp2) AS dst FROM fp2), u AS (SELECT src AS node, dst AS other FROM e UNION SELECT dst, src FROM e), x AS (SELECT u.node, bit_xor(f.a) AS a, bit_xor(f.b) AS b FROM u JOIN fp2 f ON f.vec_id = u.other GROUP BY u.node), n1 AS (SELECT f.vec_id, xor(f.a, x.a) AS a, xor(f.b, x.b) AS b FROM fp2 f JOIN x ON x.node = f.vec_id), y AS (SELECT u.node, bit_xor(f.a) AS a, bit_xor(f.b) AS b FROM u JOIN n1 f ON f.vec_id = u.other GROUP BY u.node) SELECT f.vec_id AS node, CAST(xor(f.a, y.a) AS BIGINT) AS x0, CAST(xor(f.b, y.b) AS BIGINT) AS x1 FROM n1 f JOIN y ON y.node = f.vec_id")
def fanout_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of mixing neighbours, the lineage cut after each."""
    nodes = prints(spark, sf_dir).select(F.col("vec_id").alias("node"), "fp")
    n = nodes.count()
    edges = nodes.select(F.col("node").alias("src"), ((F.col("node") * 7 + 3) % n).alias("dst"))
    return graph.fanout(nodes, edges, 2, 2, stored)[0].select("node", F.col("fp")[0].alias("x0"), F.col("fp")[1].alias("x1"))


_PATH = "p AS (SELECT c_custkey AS id, CAST(c_custkey * 40503 % 65536 AS INTEGER) AS bits, CAST(1 + c_custkey % 4 AS INTEGER) AS n FROM customer), h AS (SELECT id, n, lower(lpad(to_hex(bits), 4, '0'))[1:n] AS d FROM p)"


@query(f"WITH {_PATH} SELECT id, 'ada:clam:' || array_to_string(string_split(d, ''), ':') AS address, CAST(('0x' || rpad(d, 4, '0')) AS INTEGER) AS bits, CAST(4 * n AS INTEGER) AS depth FROM h")
def path_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses written and parsed again."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 40503 % 65536).cast("int").alias("bits"), (4 + 4 * (F.col("c_custkey") % 4)).cast("int").alias("depth"))
    a = c.select("id", truth.to_address(F.col("bits"), F.col("depth")).alias("address")).withColumn("p", truth.parse_address(F.col("address")))
    return a.select("id", "address", "p.bits", "p.depth")


_T = "t AS (SELECT event_id, abs(value) / (1 + abs(value)) AS f1, 0.5::DOUBLE AS c1, (event_id % 10) / 10.0::DOUBLE AS f2, (event_id % 9) / 10.0::DOUBLE AS c2 FROM events)"


@query(f"WITH {_T}, x AS (SELECT *, f1 * f2 * c1 * c2 AS c FROM t) SELECT event_id, f1 AS af, c / (c + 1e-3::DOUBLE) AS ac, f2 AS jf, c / (c + 1e-3::DOUBLE) AS jc FROM x")
def truth_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abduction and induction, unrounded: the same operations on doubles in the same order."""
    v = F.abs("value") / (1 + F.abs("value"))
    t = table(spark, sf_dir, "events").select("event_id", truth.truth(v, F.lit(0.5)).alias("a"), truth.truth((F.col("event_id") % 10) / 10.0, (F.col("event_id") % 9) / 10.0).alias("b"))
    t = t.select("event_id", truth.abduction(F.col("a"), F.col("b")).alias("x"), truth.induction(F.col("a"), F.col("b")).alias("y"))
    return t.select("event_id", F.col("x.f").alias("af"), F.col("x.c").alias("ac"), F.col("y.f").alias("jf"), F.col("y.c").alias("jc"))


@query("WITH d AS (SELECT l_orderkey, l_linenumber, l_discount AS ds, l_tax AS dp, (l_quantity % 10) / 10 AS d3 FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN greatest(ds, dp, d3) < 0.3 THEN 'core' WHEN d3 = greatest(ds, dp, d3) THEN 'sp' WHEN dp = greatest(ds, dp, d3) THEN 'so' ELSE 'po' END AS halo FROM d")
def halo_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", truth.halo_by_distance(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") % 10 / 10).alias("halo"))


_SEVEN = [_verb("s", "d", k) for k in range(1, 8)]
_DIST = ", ".join(f"bit_count(xor({a}, {_F[0]})) + bit_count(xor({b}, {_F[1]}))" for a, b in _SEVEN)


@query(f"WITH {FP2}, x AS (SELECT s.vec_id, [{_DIST}] AS d FROM fp2 s JOIN fp2 d ON d.vec_id = s.vec_id + 1) SELECT vec_id, CAST(list_min(d) AS BIGINT) AS d, ['BECOMES', 'CAUSES', 'SUPPORTS', 'CONTRADICTS', 'REFINES', 'GROUNDS', 'ABSTRACTS'][list_position(d, list_min(d))] AS verb FROM x")
def inferred_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verb of each edge again, from its ends."""
    p = _neighbours(spark, sf_dir).withColumn("e", hdc.encode_verb(F.col("s"), "REFINES", F.col("d"), 2, 32))
    return p.select("vec_id", hdc.infer_verb(F.col("e"), F.col("s"), F.col("d"), 2, 32).alias("v")).select("vec_id", "v.d", "v.verb")


@query(f"WITH {INT8}, l AS (SELECT label, unnest(range(64)) AS pos, unnest(v) + 128 AS x FROM int8) SELECT label, CAST(pos AS INTEGER) AS pos, CAST(floor(sum(x) / count(*)) AS INTEGER) AS v FROM l GROUP BY label, pos")
def bundle_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signed8(spark, sf_dir).select("label", F.transform("v", lambda x: x + 128).alias("v"))
    return hdc.bundle_average(s, ["label"])


@query(f"WITH {FP2}, c AS (SELECT vec_id, bit_count(a)::DOUBLE AS x, bit_count(b)::DOUBLE AS y FROM fp2) SELECT vec_id, (x * x + y * y) / 2 - ((x + y) / 2) * ((x + y) / 2) AS quality FROM c")
def signal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prints(spark, sf_dir).select("vec_id", bits.signal_quality("fp", 2).alias("quality"))


@query(f"WITH {FP2} SELECT s.vec_id, s.a AS s, q.a AS p, d.a AS o, 0.5::DOUBLE AS c1, q.a AS s2, 0.25::DOUBLE AS c2 FROM fp2 s JOIN fp2 d ON d.vec_id = s.vec_id + 1, fp2 q WHERE q.vec_id = 0")
def mutated_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slot and two slots of a triple replaced."""
    other = bits.literal([w % (1 << 64) for w in prints(spark, sf_dir).where("vec_id = 0").first()["fp"]])
    t = _neighbours(spark, sf_dir).select("vec_id", F.struct(F.col("s"), F.col("s").alias("p"), F.col("d").alias("o"), F.lit(1.0).alias("confidence")).alias("t"))
    m = t.select("vec_id", hdc.mutate(F.col("t"), "p", other).alias("one"), hdc.mutate(F.col("t"), "sp", other).alias("two"))
    return m.select("vec_id", F.col("one.s")[0].alias("s"), F.col("one.p")[0].alias("p"), F.col("one.o")[0].alias("o"), F.col("one.confidence").alias("c1"), F.col("two.s")[0].alias("s2"), F.col("two.confidence").alias("c2"))


_KILL = "CAST('0x' || substr(md5('7:' || CAST(vec_id AS VARCHAR) || ':{0}:{1}'), 1, 8) AS BIGINT)"
_KILLED = [" & ".join(_KILL.format(w, k) for k in range(3)) for w in (0, 1)]


@query(f"WITH {FP2} SELECT vec_id, CAST(a & ~({_KILLED[0]}) AS BIGINT) AS x0, CAST(b & ~({_KILLED[1]}) AS BIGINT) AS x1 FROM fp2")
def decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints that lose about an eighth of their set bits."""
    d = prints(spark, sf_dir).select("vec_id", hdc.decay(F.col("fp"), F.col("vec_id"), 2, 0.875, 7, 32).alias("d"))
    return d.select("vec_id", F.col("d")[0].alias("x0"), F.col("d")[1].alias("x1"))


def _weighed(x):
    """A volume in one number: its values times their positions, from 1."""
    return F.aggregate(F.transform(x, lambda b, i: (b * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda a, y: a + y)


_GO = "(({0} // 32) % 8) * 256 + ({0} % 8) * 32 + ({0} // 256) * 4 + ({0} % 32) // 8"


@query(f"WITH {_VOLUME}, r AS (SELECT id, p, i, {_GO.format('i')} AS j FROM v), t AS (SELECT *, {_GO.format('j')} AS k FROM r) SELECT id, CAST(sum(p * (j + 1)) AS BIGINT) AS once, CAST(sum(p * (k + 1)) AS BIGINT) AS twice, CAST(sum(p * (i + 1)) AS BIGINT) AS back FROM t GROUP BY id")
def spatial_binds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes turned once, twice, and back."""
    turn = volumes.rotation()
    v = _volumes(spark, sf_dir)
    return v.select("id", _weighed(volumes.bind("p", turn)).alias("once"), _weighed(volumes.bind("p", volumes.compose(turn, turn))).alias("twice"), _weighed(volumes.unbind(volumes.bind("p", turn), turn)).alias("back"))


@query(f"WITH {_VOLUME} SELECT id, CAST(sum(xor(p, q) * (i + 1)) AS BIGINT) AS related, CAST(sum((((p - 128) - (q - 128) + 128 + 256) % 256 - 128) * (i + 1)) AS BIGINT) AS taken, CAST(sum((i % 256) * (i + 1)) AS BIGINT) AS content FROM v GROUP BY id")
def delta_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of two volumes, and a content stored in one and recovered."""
    v = _volumes(spark, sf_dir).withColumn("c", F.transform(F.sequence(F.lit(0), F.lit(2047)), lambda i: i % 256))
    signed = lambda x: F.transform(x, lambda b: b - 128)
    stored_ = volumes.delta_xor(volumes.delta_xor("p", "q"), "c")
    return v.select("id", _weighed(volumes.delta_xor("p", "q")).alias("related"), _weighed(volumes.delta_sub(signed("p"), signed("q"))).alias("taken"), _weighed(volumes.recover_xor(stored_, "p", "q")).alias("content"))


@query(f"WITH {_VOLUME}, h AS (SELECT id, [{', '.join(f'CAST(count_if(p // 16 = {k}) AS INTEGER)' for k in range(16))}] AS p, [{', '.join(f'CAST(count_if(q // 16 = {k}) AS INTEGER)' for k in range(16))}] AS q FROM v WHERE i < 700 GROUP BY id) SELECT id, p AS bins, CAST(list_sum(list_transform(list_zip(p, q), lambda t: abs(t[1] - t[2]))) AS BIGINT) AS distance FROM h")
def phase_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of the first 700 bytes (whole volumes hold every byte equally often) and their distance."""
    v = _volumes(spark, sf_dir).select("id", volumes.histogram16(F.slice("p", 1, 700)).alias("p"), volumes.histogram16(F.slice("q", 1, 700)).alias("q"))
    return v.select("id", F.col("p").alias("bins"), bits.l1_distance("p", "q").alias("distance"))

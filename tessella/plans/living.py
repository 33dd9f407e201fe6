"""Indexes and trees that change, ghosts, hydration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates, ghosts, hydrate, livetree, writelog
from ..functions import bits
from ..operators._cut import stored
from ..operators._versions import new_folder
from ..streaming import trajectories
from ._registry import FP2, first_row, ham, lane, prints, query, signed8, table


@query()
def cam_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every row whose id is divisible by 100, among all rows, by the hashed index."""
    rows = prints(spark, sf_dir).select(F.col("vec_id").alias("id"), "fp")
    path = new_folder(spark, "cam")
    late = F.pmod(F.xxhash64("id"), F.lit(10)) == 0
    candidates.build(rows.where(~late), path, 2, 32, tables=16, sample=1, block=48)
    candidates.insert(rows.where(late), path)
    return candidates.search(rows.where("id % 100 = 0").select(F.col("id").alias("q"), "fp"), path, 10)


_TRADE = """
months AS (SELECT month(l_shipdate) AS m, CAST(sum(l_quantity) AS BIGINT) AS t FROM lineitem GROUP BY 1),
weights AS (SELECT m, CAST(round(1000.0 * (12.0 * t / (SELECT sum(t) FROM months) - 1.0)) AS BIGINT) AS w FROM months),
lines AS (SELECT o_custkey AS src, l_suppkey AS dst, month(l_shipdate) AS m, l_quantity AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
a AS (SELECT src, m, CAST(sum(q) AS BIGINT) AS v FROM lines GROUP BY ALL),
b AS (SELECT dst, m, CAST(sum(q) AS BIGINT) AS v FROM lines GROUP BY ALL),
edges AS (SELECT DISTINCT src, dst FROM lines)"""


def _by_month(df: DataFrame, key: str) -> DataFrame:
    sums = df.groupBy(F.col(key).alias("node")).agg(*(F.sum(F.when(F.col("m") == m, F.col("q")).otherwise(0.0)).alias(f"m{m}") for m in range(1, 13)))
    return sums.select("node", F.array(*(f"m{m}" for m in range(1, 13))).alias("v"))


@query(f"""WITH {_TRADE}, pairs AS (SELECT src, dst, sum(a.v * b.v * w) AS signal FROM a JOIN b USING (m) JOIN weights USING (m) GROUP BY ALL)
SELECT src, dst, CAST(signal AS DOUBLE) AS signal FROM pairs ANTI JOIN edges USING (src, dst) ORDER BY abs(signal) DESC, src, dst LIMIT 100""")
def ghost_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 customers and suppliers that never traded whose months answer the year's rhythm most strongly."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("dst"), F.month("l_shipdate").alias("m"), F.col("l_quantity").alias("q"))
    lines = stored(lines.join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("src")), "o_orderkey"), "ghost-lines")
    months = {r.m: r.t for r in lines.groupBy("m").agg(F.sum("q").alias("t")).collect()}  # twelve rows
    total = sum(months.values())
    rhythm = {m: 1000.0 * (12.0 * t / total - 1.0) for m, t in months.items()}
    weights = [float(int(abs(x) + 0.5)) * (1 if x >= 0 else -1) for x in (rhythm.get(m, 0.0) for m in range(1, 13))]
    return ghosts.top_ghosts(_by_month(lines, "src"), _by_month(lines, "dst"), lines.select("src", "dst"), weights, 100).pairs


_LIVE = f"{FP2}, live AS (SELECT CASE WHEN vec_id % 7 = 3 THEN vec_id + 1000000 ELSE vec_id END AS id, a, b FROM fp2 WHERE vec_id % 7 <> 5)"


def _live(spark: SparkSession, sf_dir: str) -> str:
    """All rows but those with a remainder of 3 by 7 as a tree; these are set under other ids, those of 5 dropped."""
    rows = prints(spark, sf_dir).select(F.col("vec_id").alias("id"), "fp")
    path = new_folder(spark, "live-tree")
    livetree.create(rows.where("id % 7 <> 3"), path, 2, 32, leaf_size=40, max_depth=6)
    livetree.change(spark, path, add=rows.where("id % 7 = 3").select((F.col("id") + 1_000_000).alias("id"), "fp"), drop=rows.where("id % 7 = 5"))
    return path


@query(f"WITH {_LIVE} SELECT p.id, {ham('p', 'q')} AS d FROM live p, fp2 q WHERE q.vec_id = 3 AND {ham('p', 'q')} <= 26")
def live_tree_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A radius search after rows were set and dropped."""
    c, m = livetree.snapshot(spark, _live(spark, sf_dir))
    return livetree.clusters.within(c, m, first_row(prints(spark, sf_dir), "fp", 3), 26, 2).select("id", "d")


@query(f"WITH {_LIVE} SELECT CAST(count(*) AS BIGINT) AS n, CAST(bit_xor(a) AS BIGINT) AS xa, CAST(bit_xor(b) AS BIGINT) AS xb, CAST(sum(id) AS BIGINT) AS ids FROM live")
def live_tree_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that the tree holds after the change: each row once."""
    _, m = livetree.snapshot(spark, _live(spark, sf_dir))
    return m.agg(F.count("*").alias("n"), F.bit_xor(F.col("fp")[0]).alias("xa"), F.bit_xor(F.col("fp")[1]).alias("xb"), F.sum("id").alias("ids"))


# Parts and suppliers (ids below zero) with the first 60 bits of a digest, and what was delivered, by its flag.
def _digest(x: str) -> str:
    return f"CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)"


_GRAPH = f"""
nodes AS (SELECT p_partkey AS node, {_digest('p_name')} AS fp FROM part UNION ALL SELECT -1 - s_suppkey, {_digest('s_name')} FROM supplier),
edges AS (SELECT DISTINCT l_partkey AS src, -1 - l_suppkey AS dst, l_returnflag AS rel FROM lineitem),
signed AS (SELECT src, dst, rel, CAST(xor(n.fp, {_digest('rel')}) AS BIGINT) AS sig FROM edges JOIN nodes n ON n.node = src SEMI JOIN nodes d ON d.node = dst)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    digest = lambda c: F.array(F.conv(F.substring(F.md5(F.col(c).cast("binary")), 1, 15), 16, 10).cast("long"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), digest("p_name").alias("fp"))
    nodes = parts.unionByName(table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("node"), digest("s_name").alias("fp")))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst"), F.col("l_returnflag").alias("rel")).distinct()
    return nodes, edges, edges.select("rel").distinct().withColumn("fp", digest("rel"))


_ONES = ", ".join(f"CAST(sum((sig >> {i}) & 1) AS BIGINT) AS o{i}" for i in range(60))
_MAJORITY = " + ".join(f"CASE WHEN o{i} > n // 2 THEN {1 << i}::BIGINT ELSE 0 END" for i in range(60))
_AGREED = " + ".join(f"CASE WHEN o{i} > sure OR o{i} < n - sure THEN 1 ELSE 0 END" for i in range(60))


@query(f"""WITH {_GRAPH},
way AS (SELECT *, CASE rel WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END AS c FROM signed),
ends AS (SELECT src AS node, sig, 1 AS s, 0 AS o, c FROM way UNION ALL SELECT dst, sig, 0, 1, -c FROM way),
sums AS (SELECT node, count(*) AS n, greatest(1, count(*) * 3 // 4) AS sure, sum(s) AS s, sum(o) AS o, sum(c) AS c, {_ONES} FROM ends GROUP BY node)
SELECT node, coalesce({_MAJORITY}, 0) AS awareness, coalesce(n, 0) AS edge_count, coalesce(({_AGREED}) / 60.0::DOUBLE, 0.0) AS crystallization,
  CAST(coalesce(s, 0) AS BIGINT) AS subject_count, CAST(coalesce(o, 0) AS BIGINT) AS object_count, CAST(coalesce(c, 0) AS BIGINT) AS causal_sign
FROM nodes LEFT JOIN sums USING (node)""")
def hydrated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, relations = _graph(spark, sf_dir)
    out = hydrate.hydrate(nodes, edges, 1, 60, relations, ("R",), ("A",))
    return out.select("node", F.col("awareness")[0].alias("awareness"), "edge_count", "crystallization", "subject_count", "object_count", "causal_sign")


@query(f"WITH {_GRAPH} SELECT src AS node, rel, CAST(bit_xor(sig) AS BIGINT) AS x FROM signed GROUP BY ALL")
def relation_awareness(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, relations = _graph(spark, sf_dir)
    return hydrate.relation_awareness(nodes, edges, 1, 60, relations).select("node", "rel", F.col("fp")[0].alias("x"))


def _round(k: int) -> str:
    before = f"x{k - 1}" if k else "nodes"
    return f"x{k} AS (SELECT n.node, CAST(xor(n.fp, coalesce(s.fp, 0)) AS BIGINT) AS fp FROM {before} n LEFT JOIN (SELECT near.node, CAST(bit_xor(o.fp) AS BIGINT) AS fp FROM near JOIN {before} o ON o.node = near.other GROUP BY 1) s USING (node))"


@query(f"""WITH {_GRAPH}, both_ways AS (SELECT src AS node, dst AS other FROM edges UNION SELECT dst, src FROM edges),
near AS (SELECT * FROM both_ways SEMI JOIN nodes USING (node)), {_round(0)}, {_round(1)}, {_round(2)}
SELECT node, fp AS x FROM x2""")
def fanout_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds in which only what changed is sent."""
    nodes, _, _ = _graph(spark, sf_dir)
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst"))  # repeated ones count once
    out, _ = hydrate.frontier_fanout(nodes, edges, 1, 3)
    return out.select("node", F.col("fp")[0].alias("x"))


@query("""WITH w AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS clock,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS count FROM events)
SELECT event_id, clock, count, CASE WHEN count <= 2 THEN 0.5 WHEN count <= 5 THEN 0.8 WHEN count <= 20 THEN 1.0 WHEN count <= 50 THEN 0.5
  WHEN count <= 200 THEN 0.2 ELSE 0.1 END::DOUBLE AS plasticity FROM w""")
def write_plasticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each event, as a write of its type into its user's container, would be taken up."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return writelog.with_plasticity(events, "user_id", "event_type", ["ts", "event_id"]).select("event_id", "clock", "count", "plasticity")


@query()
def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in two batches as a log, the first of them compacted; each user's container after replay."""
    kinds = [r.event_type for r in table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]  # the vocabulary
    templates = [list(r.v) for r in signed8(spark, sf_dir).orderBy("vec_id").limit(len(kinds)).select("v").collect()]
    number = F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type")).cast("int") - 1
    events = table(spark, sf_dir, "events").where("value is not null")
    events = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), number.alias("concept"), (F.col("value") / (1 + F.abs("value"))).alias("amplitude"))
    path, early = new_folder(spark, "log"), F.col("seq") % 2 == 0
    writelog.append(events.where(early), path, "loader", 0)
    writelog.compact(spark, path, templates)
    writelog.append(events.where(~early), path, "loader", 1)
    states = writelog.replay(spark, path, templates)
    energy = F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + x * x)
    return states.select(F.col("key").alias("user_id"), "clock", energy.alias("energy"), "counts", "last")


_PLANES = ", ".join(f"{lane(0, 16, 16 * i)} AS {c}" for i, c in enumerate("spo"))
_LAGS = ", ".join(f"lag({c}, {k}) OVER w AS {c}{k}" for c in "spo" for k in (1, 2))
_SETTLED = " + ".join(f"CAST(bit_count(xor({c}, {c}1)) <= 7 AS INTEGER)" for c in "spo")
_BACK = ", ".join(f"CAST(coalesce({c} = {c}2 AND {c} <> {c}1, false) AS INTEGER) AS b{c}" for c in "spo")


@query(f"""WITH x AS (SELECT label AS key, vec_id AS iter, {_PLANES} FROM embeddings),
st AS (SELECT *, {_LAGS} FROM x WINDOW w AS (PARTITION BY key ORDER BY iter)),
lv AS (SELECT *, {_SETTLED} AS level, {_BACK} FROM st),
bf AS (SELECT *, lag(level) OVER (PARTITION BY key ORDER BY iter) AS was FROM lv),
g AS (SELECT key, count(*) AS n, count(*) FILTER (level > was) AS supports, count(*) FILTER (level < was) AS undermines,
  CAST(sum(bs) > 0 AS BIGINT) + CAST(sum(bp) > 0 AS BIGINT) + CAST(sum(bo) > 0 AS BIGINT) AS contradicts, coalesce(arg_max(level, iter) = 3, false) AS converged FROM bf GROUP BY key)
SELECT key, n, supports, undermines, contradicts, CASE WHEN converged AND supports > undermines + contradicts THEN 'flow' WHEN contradicts > supports THEN 'block' ELSE 'hold' END AS gate FROM g""")
def trajectory_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's vectors in order of their ids as one trajectory of three 16-bit planes."""
    planes = [F.array(p).alias(c) for p, c in ((bits.sign_lanes("embedding", 1, 16, 16 * i)[0], c) for i, c in enumerate("spo"))]
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("key"), F.col("vec_id").alias("iter"), *planes)
    return trajectories.gates(rows, 1, settled=7, contested=0)

"""A cluster tree that changes: versions of its tables, of which each holds only what it touched.

A tree is a folder (see _versions) of layers. A layer has clusters, members and gone: ids whose rows
in earlier layers no longer count. A node or member of a later layer stands for the one before; a
node with `n` 0 is a tombstone. Any version can be read, whatever came after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from . import _versions, clusters
from ._cut import stored

NODE = ["node", "depth"]
#: half_of: the radius at which n_half was counted last; members within half of it count.
CLUSTER = [*NODE, "center", "radius", "n", "n_half", "half_of", "leaf"]
MEMBER = ["id", "fp", *NODE]


def create(df: DataFrame, path: str, lanes: int, width: int = 64, leaf_size: int = 40, max_depth: int = 8) -> int:
    """The tree of (id, fp) as version 1 of the folder; ids are distinct."""
    spark = df.sparkSession
    before, _ = _versions.read(spark, path)
    c, m = clusters.build(df, lanes, width, min_size=leaf_size, max_depth=max_depth)
    layer = _layer(path, c.withColumn("half_of", F.col("radius")).select(CLUSTER), m.select(MEMBER), df.select("id").limit(0))
    return _versions.commit(spark, path, before, {"lanes": lanes, "width": width, "leaf_size": leaf_size, "max_depth": max_depth, "layers": [layer]})


def _layer(path: str, c: DataFrame, m: DataFrame, gone: DataFrame) -> dict:
    return {"clusters": _versions.write(c, path, "clusters"), "members": _versions.write(m, path, "members"), "gone": _versions.write(gone, path, "gone")}


def _nodes(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    """The newest row of each node; 2^17 at most, so they are grouped and broadcast freely."""
    out = None
    for i, layer in enumerate(manifest["layers"]):
        one = _versions.table(spark, path, layer["clusters"]).select(*CLUSTER, F.lit(i).alias("layer"))
        out = one if out is None else out.unionByName(one)
    rest = [c for c in CLUSTER if c not in NODE]
    newest = out.groupBy(*NODE).agg(F.max_by(F.struct(*rest), "layer").alias("c"))
    return newest.select(*NODE, *(F.col(f"c.{c}").alias(c) for c in rest)).where("n > 0")


def _members(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    out, gone = None, None
    for layer in reversed(manifest["layers"]):
        one = _versions.table(spark, path, layer["members"]).select(MEMBER)
        one = one if gone is None else one.join(gone.distinct(), "id", "left_anti")
        out = one if out is None else out.unionByName(one.select(MEMBER))
        dead = _versions.table(spark, path, layer["gone"])
        gone = dead if gone is None else gone.unionByName(dead)
    return out


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters, members) of a version, the last by default, for the searches of `clusters`."""
    _, m = _versions.read(spark, path, version)
    c = _nodes(spark, path, m)
    return c.select("node", "depth", "center", "radius", "n", "n_half", clusters.lfd(F.col("n"), F.col("n_half")).alias("lfd"), "leaf"), _members(spark, path, m)


def _prefix(node: Column, depth: Column) -> Column:
    """The path's first `depth` steps."""
    free = F.call_function("shiftleft", F.lit(1), (F.lit(16) - depth).cast("int")) - 1
    return node.bitwiseAND(F.bitwise_not(free)).bitwiseAND(F.lit(0xFFFF)).cast("int")


def _ancestors(rows: DataFrame) -> DataFrame:
    """A row for each node on the path of each row: 17 at most."""
    rows = rows.withColumnRenamed("depth", "leaf_depth").withColumn("depth", F.explode(F.sequence(F.lit(0), F.col("leaf_depth"))))
    return rows.withColumn("node", _prefix(F.col("node"), F.col("depth")))


def route(rows: DataFrame, nodes: DataFrame, lanes: int, max_depth: int) -> DataFrame:
    """(id, fp, node, depth): the leaf of each (id, fp), step by step to the child with the nearer
    centre, the first among equals. Nodes are broadcast, rows are not moved."""
    children = nodes.select(*NODE, "center", "leaf")
    rows = rows.select("id", "fp", F.lit(0).alias("node"), F.lit(0).alias("depth"))
    for depth in range(max_depth):
        inner = F.broadcast(children.where(f"not leaf and depth = {depth}").select("node", F.lit(True).alias("open")))
        left = F.broadcast(children.where(f"depth = {depth + 1}").select("node", F.col("center").alias("lc")))
        right = F.broadcast(children.where(f"depth = {depth + 1}").select(F.col("node").bitwiseAND(F.lit(0xFFFF ^ (1 << (15 - depth)))).cast("int").alias("parent"), F.col("node").alias("r"), F.col("center").alias("rc")).where("parent <> r"))
        at = rows.join(inner, "node", "left").join(left, "node", "left").join(right, F.col("node") == F.col("parent"), "left")
        go = (F.col("depth") == depth) & F.coalesce("open", F.lit(False))
        far = F.coalesce(bits.hamming("fp", "lc", lanes) > bits.hamming("fp", "rc", lanes), F.col("lc").isNull())
        step = F.when(go & far, F.col("r")).otherwise(F.col("node")).cast("int")
        rows = at.select("id", "fp", step.alias("node"), F.when(go, depth + 1).otherwise(F.col("depth")).cast("int").alias("depth"))
    return rows


def _touched(nodes: DataFrame, added: DataFrame, lost: DataFrame, lanes: int) -> DataFrame:
    """The nodes on the paths of added and lost members, with n, n_half and radius brought up to date:
    one grouped sum, combined before the shuffle. Lost members leave the radius as it was, an upper bound."""
    signs = _ancestors(added.withColumn("sign", F.lit(1))).unionByName(_ancestors(lost.withColumn("sign", F.lit(-1))))
    d = bits.hamming("fp", "center", lanes)
    met = signs.join(F.broadcast(nodes.select(*NODE, "center", "half_of")), NODE).withColumn("d", d)
    sums = met.groupBy(*NODE).agg(
        F.sum("sign").alias("dn"),
        F.sum(F.when(F.col("d") * 2 <= F.col("half_of"), F.col("sign")).otherwise(0)).alias("dh"),
        F.max(F.when(F.col("sign") > 0, F.col("d"))).alias("far"),
    )
    out = nodes.join(F.broadcast(sums), NODE)
    return out.withColumns({"n": F.col("n") + F.col("dn"), "n_half": F.col("n_half") + F.col("dh"), "radius": F.greatest("radius", F.coalesce("far", F.lit(0)))}).select(CLUSTER)


def _repaired(nodes: DataFrame, touched: DataFrame, lanes: int, max_depth: int) -> DataFrame:
    """touched with smaller radii where the children's allow it, from the leaves up: no member is
    farther from a node's centre than a child's centre and its radius together."""
    rest = nodes.join(touched.select(*NODE), NODE, "left_anti")
    for depth in range(max_depth - 1, -1, -1):
        below = touched.unionByName(rest).where((F.col("depth") == depth + 1) & (F.col("n") > 0))
        below = below.select(_prefix(F.col("node"), F.lit(depth)).alias("node"), F.lit(depth).alias("depth"), F.col("center").alias("cc"), F.col("radius").alias("cr"))
        bound = below.join(F.broadcast(touched.where(f"depth = {depth} and not leaf").select(*NODE, "center")), NODE).groupBy(*NODE).agg(F.max(bits.hamming("center", "cc", lanes) + F.col("cr")).alias("most"))
        touched = stored(touched.join(F.broadcast(bound), NODE, "left").withColumn("radius", F.least("radius", F.coalesce("most", "radius"))).select(CLUSTER), "tree-repaired")
    return touched


def change(spark: SparkSession, path: str, add: DataFrame | None = None, drop: DataFrame | None = None) -> int:
    """SET the rows add (id, fp) and DEL the ids drop (id), as one new version; returns it.

    A set id that is there is replaced; a dropped id that is not there is ignored; an id in both is
    set. Null ids and fingerprints are left out, repeated rows of an id count as one (the least fp).
    Rewritten are the leaves that gain or lose a member and the nodes above them, and the members
    of leaves that grow beyond leaf_size, which are split where they stand, step by step.
    """
    version, m = _versions.read(spark, path)
    lanes, width = m["lanes"], m["width"]
    nodes, members = stored(_nodes(spark, path, m), "tree-nodes"), _members(spark, path, m)
    empty = members.limit(0)
    add = empty.select("id", "fp") if add is None else add.where("id is not null and fp is not null").groupBy("id").agg(F.min("fp").alias("fp"))
    add = stored(add, "tree-add")
    leave = add.select("id") if drop is None else add.select("id").unionByName(drop.select("id").where("id is not null")).distinct()
    lost = stored(members.join(leave, "id", "left_semi"), "tree-lost")
    if nodes.limit(1).count():
        placed = route(add, nodes, lanes, m["max_depth"])
    else:  # everything was dropped before: the first row is the new root's centre
        placed = add.select("id", "fp", F.lit(0).alias("node"), F.lit(0).alias("depth"))
        root = add.agg(F.min_by("fp", "id").alias("center")).where("center is not null")
        nodes = stored(root.select(F.lit(0).alias("node"), F.lit(0).alias("depth"), "center", F.lit(0).cast("long").alias("radius"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_half"), F.lit(0).cast("long").alias("half_of"), F.lit(True).alias("leaf")), "tree-root")
    placed = stored(placed, "tree-placed")
    touched = stored(_touched(nodes, placed, lost, lanes), "tree-touched")
    # Leaves that are too large, with all their members, old and new.
    full = touched.where((F.col("leaf")) & (F.col("n") > m["leaf_size"]) & (F.col("radius") > 0) & (F.col("depth") < m["max_depth"]))
    full = stored(full, "tree-full")
    moved = None
    if full.limit(1).count():
        old = members.join(leave, "id", "left_anti").unionByName(placed)
        rows = old.join(F.broadcast(full.select(*NODE, "center")), NODE)
        moved, below = _split(rows, m, lanes, width)
        opened = full.withColumn("leaf", F.lit(False))
        touched = stored(touched.join(full.select(*NODE), NODE, "left_anti").unionByName(opened).unionByName(below), "tree-split")
    touched = _repaired(nodes, touched, lanes, m["max_depth"])
    gone = lost.select("id")
    if moved is not None:
        placed = placed.join(moved.select("id"), "id", "left_anti").unionByName(moved)
        gone = gone.unionByName(moved.select("id")).distinct()
    layer = _layer(path, touched, placed.select(MEMBER), gone)
    return _versions.commit(spark, path, version, m | {"layers": [*m["layers"], layer]})


def _split(rows: DataFrame, m: dict, lanes: int, width: int) -> tuple[DataFrame, DataFrame]:
    """The members (id, fp, node, depth) of leaves split until small, and the nodes below them."""
    rows, settled, made = stored(rows, "tree-open"), None, None
    while rows.limit(1).count():
        rows = stored(clusters.halves(rows, lanes), "tree-halves")
        level = clusters._summaries(rows, lanes, width).withColumn("half_of", F.col("radius"))
        level = level.withColumn("leaf", (F.col("n") <= m["leaf_size"]) | (F.col("radius") == 0) | (F.col("depth") >= m["max_depth"]))
        level = stored(level.select(CLUSTER), "tree-level")
        made = level if made is None else made.unionByName(level)
        done = rows.join(F.broadcast(level.where("leaf").select(*NODE)), NODE, "left_semi").select(MEMBER)
        settled = done if settled is None else settled.unionByName(done)
        rows = stored(rows.join(F.broadcast(level.where("not leaf").select(*NODE, "center")), NODE), "tree-open")
    return stored(settled, "tree-moved"), made


def compact(spark: SparkSession, path: str) -> int:
    """All layers as one, rows as they are; reads need no layers any more. Older versions stay readable."""
    version, m = _versions.read(spark, path)
    members = _members(spark, path, m)
    layer = _layer(path, _nodes(spark, path, m), members, members.select("id").limit(0))
    return _versions.commit(spark, path, version, m | {"layers": [layer]})


def touched_nodes(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The nodes that the version's last layer holds."""
    _, m = _versions.read(spark, path, version)
    return _versions.table(spark, path, m["layers"][-1]["clusters"])


def under(node: int, depth: int) -> Column:
    """Whether a member's path begins with these steps."""
    low, high = clusters.path_range(F.lit(node), F.lit(depth))
    return F.col("node").between(low, high) & (F.col("depth") >= depth)


def arrivals(nodes: DataFrame, members: DataFrame, rows: DataFrame, lanes: int) -> DataFrame:
    """What would become of rows (id, fp, path, steps) that arrive at an address: a row each.

    A row meets the deepest node on the way to its address, the last step left out: siblings (its members),
    d (to its centre), norm (d by the radius), halo, anomaly (the z-score of d among the members'
    distances, by 5, within 0 and 1), calibration, sigma level, truth before and after, shift and
    gate. Fixed thresholds. Each node's distances are summed once, whatever number of rows meet it.
    """
    asked = rows.withColumn("depth", F.explode(F.sequence(F.lit(0), F.greatest(F.col("steps") - 1, F.lit(0)))))
    asked = asked.withColumn("node", _prefix(F.col("path"), F.col("depth")))
    known = nodes.select(*NODE, "center", "radius", "n")
    met = asked.join(F.broadcast(known), NODE)
    best = met.groupBy("id").agg(F.max_by(F.struct("fp", *NODE, "center", "radius", "n"), "depth").alias("b")).select("id", "b.*")
    best = stored(best, "tree-arrivals")
    wanted = F.broadcast(best.select(*NODE, "center").distinct())
    inside = _ancestors(members).join(wanted, NODE).groupBy(*NODE).agg(F.avg(bits.hamming("fp", "center", lanes)).alias("mean"), F.stddev_pop(bits.hamming("fp", "center", lanes)).alias("std"))
    total = nodes.where("depth = 0").agg(F.max("n")).first()[0] or 1
    d = bits.hamming("fp", "center", lanes)
    out = best.join(F.broadcast(inside), NODE, "left").withColumn("d", d).withColumn("norm", F.when(F.col("radius") > 0, F.col("d") / F.col("radius")).otherwise(F.lit(0.0)))
    z = F.when(F.col("std") > 0, (F.col("d") - F.col("mean")) / F.col("std")).otherwise(F.lit(0.0))
    out = out.withColumn("anomaly", F.least(F.lit(1.0), F.greatest(F.lit(0.0), z / 5.0)))
    weight, frequency = 1.0 / (F.col("n") + 1.0), 1.0 - F.least("norm", F.lit(1.0))
    confidence = F.least(F.col("n") / F.lit(float(total)), F.lit(1.0))
    level = F.when(F.col("anomaly") < 0.1, "discovery").when(F.col("anomaly") < 0.2, "strong").when(F.col("anomaly") < 0.35, "evidence").when(F.col("anomaly") < 0.5, "hint").otherwise("noise")
    return out.select(
        "id", *NODE, F.col("n").alias("siblings"), "d", "norm", "anomaly",
        F.when(F.col("norm") * 0.7 < 0.3, "core").otherwise("sp").alias("halo"),
        F.when(F.col("anomaly") > 0.7, "minute").when(F.col("anomaly") > 0.4, "second").otherwise("none").alias("calibration"),
        level.alias("sigma"), frequency.alias("f_before"), confidence.alias("c_before"),
        (frequency * (1.0 - weight) + (1.0 - F.col("anomaly")) * weight).alias("f_after"), F.least(confidence + weight, F.lit(1.0)).alias("c_after"),
        F.when(F.col("norm") < 0.5, "foveal").when(F.col("norm") > 1.5, "peripheral").otherwise("stable").alias("shift"),
        F.when(F.col("anomaly") > 0.7, "block").when(F.col("anomaly") > 0.4, "hold").otherwise("flow").alias("gate"),
    )

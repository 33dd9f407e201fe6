"""A binary cluster tree over fingerprints as two tables, and exact searches that prune by it.

members: (id, fp, node, depth) with the node's path in the highest `depth` of 16 bits; clusters:
(node, depth, center, radius, n, n_half, lfd, leaf). Prefixes of paths are ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.truth import path_range
from ._cut import cut
from .hdc import bundle_majority


def lfd(n: Column, n_half: Column) -> Column:
    """log2 of members within the radius to those within half of it; 0 where degenerate."""
    return F.when((n_half > 0) & (n > 0), F.log2(n / n_half)).otherwise(F.lit(0.0))


def _summaries(members: DataFrame, lanes: int, width: int) -> DataFrame:
    """Centre (the member nearest to the majority vector), radius and counts of each node.

    Tables of nodes have 2^16 rows at most and are broadcast, so the rows of a node, all rows at
    the root, are never dealt by node; what is grouped is combined in each task first.
    """
    middle = bundle_majority(members, ["node", "depth"], lanes, width).select("node", "depth", F.col("fp").alias("mid"))
    near = members.join(F.broadcast(middle), ["node", "depth"]).withColumn("dm", bits.hamming("fp", "mid", lanes))
    centers = near.groupBy("node", "depth").agg(F.min_by("fp", F.struct("dm", "id")).alias("center"))
    far = members.join(F.broadcast(centers), ["node", "depth"]).withColumn("dc", bits.hamming("fp", "center", lanes))
    radii = far.groupBy("node", "depth").agg(F.first("center").alias("center"), F.max("dc").alias("radius"), F.count("*").alias("n"))
    half = far.join(F.broadcast(radii.select("node", "depth", "radius")), ["node", "depth"]).groupBy("node", "depth").agg(F.count_if(F.col("dc") * 2 <= F.col("radius")).alias("n_half"))
    return radii.join(half, ["node", "depth"]).withColumn("lfd", lfd(F.col("n"), F.col("n_half")))


def halves(rows: DataFrame, lanes: int) -> DataFrame:
    """(id, fp, node, depth) one step down, of rows (id, fp, node, depth, center): each node is split by
    two poles, the member farthest from the centre and the one farthest from that; ties go left."""
    by = ["node", "depth"]
    left = rows.withColumn("d", bits.hamming("fp", "center", lanes)).groupBy(*by).agg(F.max_by("fp", F.struct("d", -F.col("id"))).alias("left"))
    both = rows.join(F.broadcast(left), by).withColumn("dl", bits.hamming("fp", "left", lanes))
    right = both.groupBy(*by).agg(F.max_by("fp", F.struct("dl", -F.col("id"))).alias("right"))
    side = both.join(F.broadcast(right), by).withColumn("go", F.when(F.col("dl") <= bits.hamming("fp", "right", lanes), 0).otherwise(1))
    step = F.col("node").bitwiseOR(F.col("go") * F.call_function("shiftleft", F.lit(1), 15 - F.col("depth"))).cast("int")
    return side.select("id", "fp", step.alias("node"), (F.col("depth") + 1).alias("depth"))


def build(df: DataFrame, lanes: int, width: int = 64, min_size: int = 10, max_depth: int = 6, id_col: str = "id", fp: str = "fp") -> tuple[DataFrame, DataFrame]:
    """(clusters, members), level by level: each node over min_size rows and of positive radius is
    split by two poles, the member farthest from the centre and the one farthest from that; ties
    go left. A level is a few grouped sums and joins over the rows still being split.
    """
    if not 0 < max_depth <= 16:
        raise ValueError("paths have 16 steps")
    rows = df.select(F.col(id_col).alias("id"), F.col(fp).alias("fp")).withColumn("node", F.lit(0)).withColumn("depth", F.lit(0))
    rows, clusters, settled = cut(rows), None, None
    for depth in range(max_depth + 1):
        level = cut(_summaries(rows, lanes, width).withColumn("leaf", (F.col("n") <= min_size) | (F.col("radius") == 0) | F.lit(depth == max_depth)))
        clusters = level if clusters is None else clusters.unionByName(level)
        done = rows.join(F.broadcast(level.where("leaf").select("node", "depth")), ["node", "depth"], "left_semi")
        settled = done if settled is None else settled.unionByName(done)
        open_rows = rows.join(F.broadcast(level.where("not leaf").select("node", "depth", "center")), ["node", "depth"])
        if not level.where("not leaf").count():
            break
        rows = cut(halves(open_rows, lanes))
    return cut(clusters), cut(settled)


def delta_minus(query: list[int], lanes: int) -> Column:
    """No member of the cluster can be nearer than this: distance to the centre less the radius."""
    return F.greatest(F.lit(0), bits.hamming("center", bits.literal(query), lanes) - F.col("radius"))


def delta_plus(query: list[int], lanes: int) -> Column:
    return bits.hamming("center", bits.literal(query), lanes) + F.col("radius")


def within(clusters: DataFrame, members: DataFrame, query: list[int], rho: int, lanes: int) -> DataFrame:
    """All members at most rho away, exactly, with d: leaves that cannot hold one are left out."""
    leaves = clusters.where("leaf").where(delta_minus(query, lanes) <= rho).select("node", "depth")
    return members.join(leaves, ["node", "depth"], "left_semi").withColumn("d", bits.hamming("fp", bits.literal(query), lanes)).where(F.col("d") <= rho)


def nearest(clusters: DataFrame, members: DataFrame, query: list[int], k: int, lanes: int) -> DataFrame:
    """The k nearest members, exactly, by (d, id).

    Leaves in order of delta_plus hold k members within the bound that the k-th needs at most; the
    radius search with that bound has the answer.
    """
    ordered = clusters.where("leaf").select(delta_plus(query, lanes).alias("bound"), "n").groupBy("bound").agg(F.sum("n").alias("n")).orderBy("bound")
    have, rho = 0, None
    for r in ordered.limit(k).collect():  # k leaves of one member at least hold k members
        have, rho = have + r.n, r.bound
        if have >= k:
            break
    if rho is None:
        return members.withColumn("d", F.lit(0).cast("long")).limit(0)
    return within(clusters, members, query, rho, lanes).orderBy("d", "id").limit(k)


def below(clusters: DataFrame, node: int, depth: int) -> DataFrame:
    """Clusters at or under a path."""
    low, high = path_range(F.lit(node), F.lit(depth))
    return clusters.where((F.col("depth") >= depth) & F.col("node").between(low, high))


def above(clusters: DataFrame, node: int, depth: int) -> DataFrame:
    """The path's own cluster and its ancestors."""
    return clusters.where((F.col("depth") <= depth) & (F.col("node") == path_range(F.lit(node), F.col("depth"))[0]))


def deepest(clusters: DataFrame, node: int, depth: int) -> DataFrame:
    """The deepest existing prefix of a path."""
    return above(clusters, node, depth).orderBy(F.desc("depth")).limit(1)


def lfd_by_depth(clusters: DataFrame) -> DataFrame:
    """Mean LFD of each depth, weighted by members."""
    return clusters.groupBy("depth").agg((F.sum(F.col("lfd") * F.col("n")) / F.sum("n")).alias("lfd"), F.count("*").alias("clusters"), F.sum("n").alias("n"))


def anomaly(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Per member: depth share * (1 - share of rows) * min(lfd / 3, 1), and its band (.4, .7)."""
    size = clusters.agg(F.max(F.when(F.col("leaf"), F.col("depth"))).alias("deep"), F.max(F.when(F.col("depth") == 0, F.col("n"))).alias("all_n")).first()
    score = (F.col("depth") / F.lit(float(max(1, size.deep or 0)))) * (1.0 - F.col("n") / F.lit(float(size.all_n or 1))) * F.least(F.col("lfd") / 3.0, F.lit(1.0))
    rows = members.join(clusters.where("leaf").select("node", "depth", "n", "lfd"), ["node", "depth"]).withColumn("score", score)
    return rows.select("id", "node", "depth", "score", F.when(F.col("score") >= 0.7, "anomalous").when(F.col("score") >= 0.4, "unusual").otherwise("normal").alias("band"))


def xor_diffs(clusters: DataFrame, members: DataFrame, lanes: int) -> DataFrame:
    """Each member as the positions and words that differ from its leaf's centre; and their bits."""
    leaves = clusters.where("leaf").select("node", "depth", "center")
    pairs = F.array(*(F.struct(F.lit(i).alias("pos"), F.col("fp")[i].bitwiseXOR(F.col("center")[i]).alias("x")) for i in range(lanes)))
    kept = F.filter(pairs, lambda e: e["x"] != 0)
    return members.join(leaves, ["node", "depth"]).select("id", "node", "depth", kept.alias("diff"), bits.hamming("fp", "center", lanes).alias("bits"))


def undo_diffs(clusters: DataFrame, diffs: DataFrame, lanes: int) -> DataFrame:
    """The members back from their differences."""
    leaves = clusters.where("leaf").select("node", "depth", "center")
    word = lambda i: F.aggregate(F.filter("diff", lambda e: e["pos"] == i), F.col("center")[i], lambda a, e: a.bitwiseXOR(e["x"]))
    return diffs.join(leaves, ["node", "depth"]).select("id", F.array(*(word(i) for i in range(lanes))).alias("fp"))


def lod_masks(members: DataFrame, lanes: int) -> DataFrame:
    """(node, depth, mask): the OR of a leaf's members, for lower bounds."""
    return members.groupBy("node", "depth").agg(*(F.bit_or(F.col("fp")[i]).alias(f"m{i}") for i in range(lanes))).select("node", "depth", F.array(*(F.col(f"m{i}") for i in range(lanes))).alias("mask"))


def local_inverse_lfd(clusters: DataFrame, query: list[int], rho: int, lanes: int) -> float:
    """Mean of 1 / LFD (at least 0.1) over the leaves that may hold a member at most rho away; 1 without one."""
    near = clusters.where("leaf").where(delta_minus(query, lanes) <= rho)
    found = near.agg(F.avg(1.0 / F.greatest(F.col("lfd"), F.lit(0.1)))).first()[0]
    return 1.0 if found is None else found


def nearest_by_radius(clusters: DataFrame, members: DataFrame, query: list[int], k: int, lanes: int) -> DataFrame:
    """The k nearest members, exactly, by (d, id): a radius search whose radius grows until it holds k.

    It doubles while nothing is found and grows by the local dimension, 1.1 to 2 times, afterwards;
    twice the root's radius, or the query's distance from its centre and more, holds every member.
    """
    root = clusters.where("depth = 0").select("radius", "n", delta_plus(query, lanes).alias("all")).first()
    if root is None:
        return members.withColumn("d", F.lit(0).cast("long")).limit(0)
    rho = max(1, root.radius // root.n)
    while rho < root["all"]:
        found = within(clusters, members, query, rho, lanes).count()
        if found >= k:
            break
        grow = 2.0 if not found else min(2.0, max(1.1, (k / found) ** local_inverse_lfd(clusters, query, rho, lanes)))
        rho = min(root["all"], -int(-rho * grow // 1))
    return within(clusters, members, query, rho, lanes).orderBy("d", "id").limit(k)


def diff_distances(clusters: DataFrame, diffs: DataFrame, query: list[int], lanes: int) -> DataFrame:
    """(id, d): distances to compressed members without restoring them, from their leaf's distance and
    the words that differ."""
    q = bits.literal(query)
    leaves = F.broadcast(clusters.where("leaf").select("node", "depth", "center", bits.hamming("center", q, lanes).alias("dc")))

    def change(e: Column) -> Column:
        plain = F.get("center", e["pos"]).bitwiseXOR(F.get(q, e["pos"]))
        return (F.bit_count(plain.bitwiseXOR(e["x"])) - F.bit_count(plain)).cast("long")

    return diffs.join(leaves, ["node", "depth"]).select("id", F.aggregate("diff", F.col("dc"), lambda a, e: a + change(e)).alias("d"))


def lod_nearest(clusters: DataFrame, members: DataFrame, masks: DataFrame, query: list[int], k: int, lanes: int) -> DataFrame:
    """The k nearest members, exactly, by (d, id), pruned by the OR masks of leaves.

    A member can be no nearer than the query's bits outside its leaf's mask; leaves whose bound is
    over the k-th least upper bound (delta_plus) are left out.
    """
    leaves = clusters.where("leaf").join(F.broadcast(masks), ["node", "depth"]).select("node", "depth", "n", delta_plus(query, lanes).alias("upper"), bits.or_mask_bound(bits.literal(query), "mask", lanes).alias("lower"))
    have, limit = 0, None
    for r in leaves.groupBy("upper").agg(F.sum("n").alias("n")).orderBy("upper").limit(k).collect():
        have, limit = have + r.n, r.upper
        if have >= k:
            break
    if limit is None:
        return members.withColumn("d", F.lit(0).cast("long")).limit(0)
    kept = F.broadcast(leaves.where(F.col("lower") <= limit).select("node", "depth"))
    d = bits.hamming("fp", bits.literal(query), lanes)
    return members.join(kept, ["node", "depth"], "left_semi").withColumn("d", d).orderBy("d", "id").limit(k)

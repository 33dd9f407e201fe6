"""Hydration: what a node's edges say about it; and fan-out, in which only nodes that changed send."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from ._cut import dealt, stored
from .graph import undirected
from .hdc import votes


def hash_lanes(name: Column, lanes: int, width: int = 64) -> Column:
    """A vector for a name that has none of its own: `width` bits of a hash in each lane."""
    mask = -1 if width == 64 else (1 << width) - 1
    return F.array(*(F.xxhash64(name, F.lit(i)).bitwiseAND(F.lit(mask).cast("long")) for i in range(lanes)))


def _signed_edges(nodes: DataFrame, edges: DataFrame, relations: DataFrame | None, lanes: int, width: int) -> DataFrame:
    """(src, dst, rel, sig): sig is the source's vector bound (XOR) with the relation's. Edges with an
    end that is no node are left out; repeated ones count each."""
    ends = edges.join(nodes.select(F.col("node").alias("src"), F.col("fp").alias("s")), "src")
    ends = ends.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    vector = hash_lanes(F.coalesce("rel", F.lit("")), lanes, width)
    if relations is not None:
        ends = ends.join(relations.select("rel", F.col("fp").alias("p")), "rel", "left")
        vector = F.coalesce("p", vector)
    return ends.withColumn("p", vector).select("src", "dst", "rel", bits.xor_bind("s", "p").alias("sig"))


def hydrate(nodes: DataFrame, edges: DataFrame, lanes: int, width: int = 64, relations: DataFrame | None = None, forward: tuple[str, ...] = (), backward: tuple[str, ...] = ()) -> DataFrame:
    """A row for each node (node, fp): its edges bundled. Columns: node, fp (as it was), awareness (the
    majority of its edges' signatures, both ways, ties 0), edge_count, crystallization (the share of
    bits on which more than three quarters of the edges agree), subject_count, object_count, causal_sign.

    edges: (src, dst, rel); relations: (rel, fp), a hash of the name where it has none. Relations
    in `forward` count +1 for the source and -1 for the target, those in `backward` the other way.
    A node without edges has zeros. Votes of a node are summed in each task first (hdc.votes), so a
    hub is one vector of counts from each task.
    """
    signed = stored(_signed_edges(nodes, edges, relations, lanes, width), "hydrate-edges")
    sign = F.when(F.col("rel").isin(*forward), 1).when(F.col("rel").isin(*backward), -1).otherwise(0)
    subject = signed.select(F.col("src").alias("node"), "sig", F.lit(1).alias("s"), F.lit(0).alias("o"), sign.alias("c"))
    target = signed.select(F.col("dst").alias("node"), "sig", F.lit(0).alias("s"), F.lit(1).alias("o"), (-sign).alias("c"))
    both = subject.unionByName(target)
    voted = votes(both, ["node"], lanes, width, "sig")
    counts = both.groupBy("node").agg(F.sum("s").alias("s"), F.sum("o").alias("o"), F.sum("c").alias("c"))
    zero = F.array_repeat(F.lit(0).cast("long"), lanes)
    out = nodes.select("node", "fp").join(voted, "node", "left").join(counts, "node", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "node", "fp", F.coalesce("sig", zero).alias("awareness"), number("n").alias("edge_count"),
        F.coalesce(F.col("agreed") / F.lit(float(lanes * width)), F.lit(0.0)).alias("crystallization"),
        number("s").alias("subject_count"), number("o").alias("object_count"), number("c").alias("causal_sign"),
    )


def relation_awareness(nodes: DataFrame, edges: DataFrame, lanes: int, width: int = 64, relations: DataFrame | None = None) -> DataFrame:
    """(node, rel, fp): the XOR of a node's outgoing signatures by relation, combined before the shuffle."""
    signed = _signed_edges(nodes, edges, relations, lanes, width)
    sums = signed.groupBy(F.col("src").alias("node"), "rel").agg(*(F.bit_xor(F.col("sig")[i]).alias(f"x{i}") for i in range(lanes)))
    return sums.select("node", "rel", F.array(*(f"x{i}" for i in range(lanes))).alias("fp"))


def _any(v: str, lanes: int) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [F.col(v)[i] for i in range(lanes)]) != 0


def frontier_fanout(nodes: DataFrame, edges: DataFrame, lanes: int, rounds: int) -> tuple[DataFrame, list[dict]]:
    """Every node's vector (node, fp) XOR those of its neighbours, round after round until no bit
    changes, `rounds` at most; returns the nodes and for each round what was counted: changed nodes, their
    bits, and messages (edges, each way, out of nodes that had changed).

    x' = x + A x over bits; the change d of a round follows from the change before, d' = d + A d, so
    only nodes that changed send, and what they send is their change. A round costs what its
    frontier's edges cost: neither the nodes nor the other edges are touched. All changes are
    added to the nodes once, at the end. Edges (src, dst) count once, either way; those with an end
    that is no node are left out, and so are loops. A round's counts are one combined sum.
    """
    ends = nodes.select(F.col("node").alias("other"))
    near = dealt(undirected(edges).where("node <> other"), "node", "other").distinct().join(ends, "other", "left_semi").join(ends.withColumnRenamed("other", "node"), "node", "left_semi")
    near = stored(near, "fanout-edges")

    def sent(frontier: DataFrame) -> DataFrame:
        met = near.join(frontier.select(F.col("node").alias("other"), "d"), "other")
        sums = met.groupBy("node").agg(*(F.bit_xor(F.col("d")[i]).alias(f"x{i}") for i in range(lanes)), F.count("*").alias("messages"))
        return sums.select("node", F.array(*(f"x{i}" for i in range(lanes))).alias("a"), "messages")

    told, changes, before = [], None, nodes.select("node", F.col("fp").alias("d")).where(_any("d", lanes))
    for k in range(rounds):
        came = sent(before)
        if k:
            came = before.join(came, "node", "full")
            zero = F.array_repeat(F.lit(0).cast("long"), lanes)
            came = came.select("node", bits.xor_bind(F.coalesce("d", zero), F.coalesce("a", zero)).alias("d"), F.coalesce("messages", F.lit(0)).alias("messages"))
        else:
            came = came.withColumnRenamed("a", "d")
        came = stored(came, "fanout-round")
        change = F.aggregate(F.transform("d", lambda w: F.bit_count(w).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
        row = came.agg(F.count_if(_any("d", lanes)).alias("nodes"), F.sum(change).alias("bits"), F.sum("messages").alias("messages")).first()
        told.append({"round": k, "changed": row["nodes"], "bits": row["bits"] or 0, "messages": row["messages"] or 0})
        before = came.select("node", "d").where(_any("d", lanes))
        changes = before if changes is None else changes.unionByName(before)
        if not row["nodes"]:
            break
    if changes is None:
        return nodes.select("node", "fp"), told
    total = changes.groupBy("node").agg(*(F.bit_xor(F.col("d")[i]).alias(f"x{i}") for i in range(lanes)))
    mixed = F.array(*(F.col("fp")[i].bitwiseXOR(F.coalesce(F.col(f"x{i}"), F.lit(0).cast("long"))) for i in range(lanes)))
    return nodes.join(total, "node", "left").select("node", mixed.alias("fp")), told

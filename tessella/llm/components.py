"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._shared import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node that has an edge.

    edges: columns a and b of one orderable type; self loops, repeats and both directions may
    occur. Returns (node, root), root <= node. An empty edge table gives an empty result.
    Every step is a grouped minimum (combined before the shuffle) and a join that adaptive
    execution may split, so a hub of any degree never has to meet in one task. The edge table is
    written to the shared folder after each round.
    """
    pairs, before = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), None
    pairs, _ = _written(pairs)
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
            .where("u <> v")
            .distinct()
        )
        pairs, now = _written(small)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _written(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    """pairs written, and their number and sum of hashes, which the write itself observes."""
    told = Observation()
    seen = pairs.observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    out = materialize(seen, "cc")
    return out, (told.get["n"], told.get["h"])

"""Ghosts: the pairs of nodes without an edge whose binding answers a residual most strongly.

A maximum-product join that never makes all pairs: nodes go to blocks by how much they can answer, a
pair of blocks has an upper bound, and pairs of blocks are held against each other in falling bound
until the k-th answer passes it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cut import stored
from ._order import numbered


@dataclass(frozen=True)
class Ghosts:
    """The pairs, and how much of all pairs of blocks was looked at."""

    pairs: DataFrame
    blocks_seen: int
    blocks_all: int


@dataclass(frozen=True)
class _Bounds:
    """What a pair of blocks can answer at most, by the blocks' largest figures.

    With u in the one and v in the other, and c the mean of all v: |u.v| <= |u||v|, and |u.v| <= |u.c| + |u||v - c|.
    A block of u has the largest |u.c| (`still`), the largest |u.c| + |u| * far[0] (`most`) and
    the largest |u|; between distances 0 and far[0] the second bound is at most the chord. A block
    of v has its largest |v - c| (`far`, falling) and the largest |v| of it and of all after it.
    """

    most: np.ndarray
    still: np.ndarray
    norm_a: np.ndarray
    far: np.ndarray
    norm_b: np.ndarray

    def reach(self, level: float) -> np.ndarray:
        """For each of a's blocks, the number of b's, from the first, whose bound with it is `level` or more.
        A billionth less counts too, and what rounding adds to a product."""
        if level <= 0 or not len(self.far):
            return np.full(len(self.most), len(self.far))
        low = level * (1 - 1e-9) - 1e-11 * self.norm_a * self.norm_b[0]
        slope = self.most - self.still
        by_norm = np.divide(low, self.norm_a, out=np.full(len(low), np.inf), where=self.norm_a > 0)
        by_far = np.divide(self.far[0] * (low - self.still), slope, out=np.where(low <= self.still, -np.inf, np.inf), where=slope > 0)
        return np.minimum(np.searchsorted(-self.norm_b, -by_norm, "right"), np.searchsorted(-self.far, -by_far, "right"))

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        share = self.far[y] / self.far[0] if self.far[0] > 0 else 0.0
        return np.minimum(self.norm_a[x] * self.norm_b[y], self.still[x] + (self.most[x] - self.still[x]) * share)


def _blocked(nodes: DataFrame, rows: int, label: str, *figures: str) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """nodes (node, v, figures) by the first figure, falling, in blocks of so many: (block, nodes,
    flat) with a row a block, (node, block, at), and each block's largest figures."""
    ranked = numbered(nodes.withColumn("falling", -F.col(figures[0])), "falling", "node")
    placed = stored(ranked.select("node", "v", *figures, F.floor(F.col("rank") / rows).cast("int").alias("block"), (F.col("rank") % rows).cast("int").alias("at")), f"{label}-placed")
    grouped = placed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "node", "v"))).alias("r"), *(F.max(f).alias(f) for f in figures))
    blocks = stored(grouped.select("block", F.col("r.node").alias("nodes"), F.flatten("r.v").alias("flat"), *figures), f"{label}-blocks")
    tops = sorted(tuple(r) for r in blocks.select("block", *figures).collect())  # a row for each `rows` nodes
    return blocks, placed.select("node", "block", "at"), np.array(tops, float).reshape(-1, 1 + len(figures))[:, 1:]


def _known(edges: DataFrame, at_a: DataFrame, at_b: DataFrame, xs: np.ndarray, block_rows: int) -> DataFrame:
    """(x, y, i, j): the edges of a's blocks xs, by block and place, each once."""
    spark = edges.sparkSession
    ends = lambda at, node, block, place: at.select(F.col("node").alias(node), F.col("block").alias(block), F.col("at").alias(place))
    left = ends(at_a, "src", "x", "i").join(F.broadcast(spark.createDataFrame([(int(x),) for x in xs], "x int")), "x")
    met = edges.join(F.broadcast(left) if len(xs) * block_rows <= 1 << 17 else left, "src").distinct()
    return stored(met.join(ends(at_b, "dst", "y", "j"), "dst").select("x", "y", "i", "j"), "ghosts-edges")


def _answers(spark: SparkSession, pairs: list[tuple[int, int]], a: DataFrame, b: DataFrame, edges: DataFrame, k: int, least: float, directed: bool, kind: str) -> DataFrame:
    """(src, dst, signal): of each pair of blocks the k best pairs of nodes without an edge, of at least that size."""
    chosen = spark.createDataFrame(pairs, "x int, y int").repartition(min(len(pairs), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    known = edges.join(F.broadcast(chosen) if len(pairs) <= 100_000 else chosen, ["x", "y"]).groupBy("x", "y").agg(F.collect_list(F.struct("i", "j")).alias("known"))
    left = a.select(F.col("block").alias("x"), F.col("nodes").alias("src"), F.col("flat").alias("u"))
    right = b.select(F.col("block").alias("y"), F.col("nodes").alias("dst"), F.col("flat").alias("v"))
    rows = chosen.join(known, ["x", "y"], "left").join(left, "x").join(right, "y")
    rows = rows.select("src", "u", "dst", "v", F.col("known.i").alias("i"), F.col("known.j").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                src, u, dst, v, i, j = (batch.column(c)[r] for c in range(6))
                src, dst = src.values.to_numpy(zero_copy_only=False), dst.values.to_numpy(zero_copy_only=False)
                u, v = u.values.to_numpy().reshape(len(src), -1), v.values.to_numpy().reshape(len(dst), -1)
                signal = u @ v.T
                size = np.abs(signal)
                if i.is_valid:
                    size[i.values.to_numpy(), j.values.to_numpy()] = -1
                if not directed:
                    size[src[:, None] >= dst[None, :]] = -1
                p, q = np.nonzero(size >= max(least, 0))
                if len(p) > k:  # the k-th size, and all that equal it
                    cut = np.partition(size[p, q], len(p) - k)[len(p) - k]
                    p, q = np.nonzero(size >= cut)
                order = np.lexsort((dst[q], src[p], -size[p, q]))[:k]
                p, q = p[order], q[order]
                yield pa.RecordBatch.from_arrays([pa.array(src[p]), pa.array(dst[q]), pa.array(signal[p, q])], names=["src", "dst", "signal"])

    return rows.mapInArrow(run, f"src {kind}, dst {kind}, signal double")


def top_ghosts(nodes_a: DataFrame, nodes_b: DataFrame, edges: DataFrame, weights: list[float], k: int, block_rows: int = 512, directed: bool = True) -> Ghosts:
    """The k pairs (src, dst, signal) without an edge of largest |signal|, the smaller src, then dst, first
    among equals. signal is the sum over dimensions of a * b * weight: how strongly the product of
    the two vectors answers the residual `weights`.

    nodes_a, nodes_b: (node, v array<double>) of one length, nodes distinct; edges: (src, dst). With
    directed false the two tables are one set of nodes, edges count either way and src < dst.
    Nulls: nodes, vectors and ends of edges that are null are left out.

    Blocks hold block_rows nodes each. No pair of two blocks is larger than the lesser of two bounds
    (Cauchy, Schwarz; see _Bounds): of their vectors, and of what b's differ from their mean.
    The first round takes the pair of the first blocks; each next one takes twice as many pairs in
    falling bound as all before, of those whose bound is not under the k-th size so far. Edges are
    looked up for those of a's blocks that a bound leaves, once the first round gave a size. The
    driver holds a few numbers for each block_rows nodes and the pairs of blocks of a round; products
    of two blocks are one matrix product in a task.
    """
    spark = nodes_a.sparkSession
    if k < 1 or block_rows < 1:
        raise ValueError("k and block_rows must be 1 or more")
    good = lambda df: df.where("node is not null and v is not null").select("node", F.col("v").cast("array<double>").alias("v"))
    weighed = F.zip_with("v", F.array(*(F.lit(float(w)) for w in weights)), lambda x, w: x * w)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    rows_a, rows_b = stored(good(nodes_a).withColumn("v", weighed), "ghosts-a"), stored(good(nodes_b), "ghosts-b")
    mean = [x if x is not None and np.isfinite(x) else 0.0 for x in rows_b.agg(*(F.avg(F.get("v", F.lit(i))) for i in range(len(weights)))).first()]
    centre = F.array(*(F.lit(float(x)) for x in mean))
    b, at_b, tops_b = _blocked(rows_b.withColumns({"far": size(F.zip_with("v", centre, lambda x, c: x - c)), "norm": size("v")}), block_rows, "ghosts-b", "far", "norm")
    still = F.abs(F.aggregate(F.zip_with("v", centre, lambda x, c: x * c), F.lit(0.0), lambda a, x: a + x))
    rows_a = rows_a.withColumns({"still": still, "norm": size("v")}).withColumn("most", F.col("still") + F.col("norm") * F.lit(float(tops_b[:, 0].max(initial=0.0))))
    a, at_a, tops_a = _blocked(rows_a, block_rows, "ghosts-a", "most", "still", "norm")
    bounds = _Bounds(*tops_a.T, tops_b[:, 0], np.maximum.accumulate(tops_b[::-1, 1])[::-1])
    edges = edges.select("src", "dst") if directed else edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    kind = nodes_a.schema["node"].dataType.simpleString()
    best = spark.createDataFrame([], f"src {kind}, dst {kind}, signal double")
    seen, least, everything, width, known, looked = np.zeros(len(tops_a), np.int64), -1.0, len(tops_a) * len(tops_b), 1, None, np.empty(0, int)
    while seen.sum() < everything:
        # b's blocks fall, so each of a's meets a first part of them: those whose bound counts still.
        need = np.maximum(bounds.reach(least), seen)
        if not (need - seen).sum():
            break
        upto = np.maximum(np.minimum(need, bounds.reach(_level(bounds, seen, need, width))), seen)
        pairs = [(x, y) for x in range(len(tops_a)) for y in range(int(seen[x]), int(upto[x]))]
        left = np.flatnonzero(upto > seen) if known is None else np.flatnonzero(need > seen)
        if not np.isin(left, looked).all():  # twice at most: what is left only falls
            known, looked = _known(edges, at_a, at_b, left, block_rows), left
        seen = upto
        found = _answers(spark, pairs, a, b, known, k, least, directed, kind)
        best = stored(best.unionByName(found).orderBy(F.desc(F.abs("signal")), "src", "dst").limit(k), "ghosts-best")
        last = best.agg(F.count("*").alias("n"), F.min(F.abs("signal")).alias("m")).first()
        least = last.m if last.n == k else -1.0
        width = 2 * int(seen.sum())
    return Ghosts(best, int(seen.sum()), everything)


def _level(bounds: _Bounds, seen: np.ndarray, need: np.ndarray, width: int) -> float:
    """A bound that at least `width` of the pairs of blocks to do, or all of them, reach; about the largest such."""
    count = lambda level: int(np.maximum(np.minimum(need, bounds.reach(level)) - seen, 0).sum())
    todo = np.flatnonzero(need > seen)
    high, low = float(bounds.of(todo, seen[todo]).max()), 0.0
    if count(high) >= width or count(low) <= width:
        return high if count(high) >= width else low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if count(middle) >= width else (low, middle)
    return low

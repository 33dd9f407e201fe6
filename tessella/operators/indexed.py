"""Channel indices for cascades: rows dealt to clusters by pivots, and pruned by the triangle inequality.

An index is a table: each row has its channels and, for each channel, the cluster of its nearest
pivot. Written partitioned by the first channel's cluster, a search reads only the folders that can
hold an answer. What a search prunes it could not have kept: distance(query, row) is at least
distance(query, pivot) less the cluster's radius.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from ._cut import stored
from .search import cascade


@dataclass(frozen=True)
class ChannelIndex:
    """rows: the table with a column c_<channel> for each channel; clusters: (channel, cluster,
    radius, n); pivots: for each channel the fingerprints that clusters are about, a bounded list."""

    rows: DataFrame
    clusters: DataFrame
    pivots: dict[str, list[list[int]]]


def _assigned(df: DataFrame, pivots: dict[str, list[list[int]]]) -> DataFrame:
    """df plus, for each channel, c_ and r_: the nearest pivot (the first among equals) and its distance."""
    for channel, points in pivots.items():
        near = F.array(*(F.struct(bits.hamming(channel, bits.literal(p), len(p)).alias("d"), F.lit(i).alias("c")) for i, p in enumerate(points)))
        df = df.withColumn("best", F.array_min(near)).withColumn(f"c_{channel}", F.col("best.c")).withColumn(f"r_{channel}", F.col("best.d")).drop("best")
    return df


def _clusters(rows: DataFrame, channels: list[str]) -> DataFrame:
    one = lambda c: F.struct(F.lit(c).alias("channel"), F.col(f"c_{c}").alias("cluster"), F.col(f"r_{c}").alias("r"))
    long = rows.select(F.inline(F.array(*map(one, channels))))
    return long.groupBy("channel", "cluster").agg(F.max("r").alias("radius"), F.count("*").alias("n"))


def build(df: DataFrame, channels: list[str], pivots: int = 16, id_col: str = "vec_id") -> ChannelIndex:
    """An index over df. The pivots are the channels of the rows with the smallest hash of the id, at
    most `pivots` of them; they only steer the pruning. Repeated pivots leave empty clusters."""
    chosen = df.orderBy(F.xxhash64(id_col), id_col).limit(pivots).select(*channels).collect()
    points = {c: [[w % (1 << 64) for w in r[c]] for r in chosen] for c in channels}
    if not chosen:
        points = {c: [[0]] for c in channels}
    rows = stored(_assigned(df, points), "index-rows")
    return ChannelIndex(rows, stored(_clusters(rows, channels), "index-clusters"), points)


def insert(index: ChannelIndex, more: DataFrame) -> ChannelIndex:
    """The index with more rows: only they are read; radii grow where they must."""
    channels = list(index.pivots)
    added = stored(_assigned(more, index.pivots), "index-added")
    clusters = index.clusters.unionByName(_clusters(added, channels)).groupBy("channel", "cluster").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"))
    return ChannelIndex(index.rows.unionByName(added), stored(clusters, "index-clusters"), index.pivots)


def rebuild(index: ChannelIndex, pivots: int = 16, id_col: str = "vec_id") -> ChannelIndex:
    """A new index over all rows, with new pivots."""
    plain = [c for c in index.rows.columns if not (c[:2] in ("c_", "r_") and c[2:] in index.pivots)]
    return build(index.rows.select(*plain), list(index.pivots), pivots, id_col)


def _distance(a: list[int], b: list[int]) -> int:
    return sum(((x ^ y) & ((1 << 64) - 1)).bit_count() for x, y in zip(a, b, strict=True))


def overlapping(index: ChannelIndex, query: dict[str, list[int]], limits: dict[str, int]) -> dict[str, list[int]]:
    """For each channel the clusters that may hold a row within its limit; the cluster table is as
    long as the lists of pivots."""
    table = index.clusters.collect()
    near = lambda r: _distance(query[r.channel], index.pivots[r.channel][r.cluster]) - r.radius <= limits[r.channel]
    return {c: sorted(r.cluster for r in table if r.channel == c and near(r)) for c in query}


def candidates(index: ChannelIndex, query: dict[str, list[int]], limits: dict[str, int]) -> DataFrame:
    """The rows whose clusters overlap in every channel: a filter on the cluster columns, pushed to the scan."""
    rows = index.rows
    for channel, clusters in overlapping(index, query, limits).items():
        rows = rows.where(F.col(f"c_{channel}").isin(clusters) if clusters else F.lit(False))
    return rows


def search(index: ChannelIndex, query: dict[str, list[int]], limits: dict[str, int]) -> DataFrame:
    """Rows within every channel's limit, with d_<channel>; the same rows as the flat cascade."""
    return cascade(candidates(index, query, limits), query, limits)


def search_batch(index: ChannelIndex, queries: DataFrame, limits: dict[str, int], id_col: str = "vec_id", query_id: str = "query") -> DataFrame:
    """(query, id, d_<channel>...) for a table of queries (query_id and the channels).

    Each query meets the clusters of the first channel that may hold an answer, so the join is on
    the cluster; the other channels' clusters and then all distances are conditions of it. A
    cluster with many rows is one key: let adaptive execution split it, or take more pivots.
    """
    channels = list(limits)
    first = channels[0]
    radius = {(r.channel, r.cluster): r.radius for r in index.clusters.collect()}
    bound = lambda c, i, p: bits.hamming(F.col(c), bits.literal(p), len(p)) - radius[c, i]
    live = {c: [(i, p) for i, p in enumerate(index.pivots[c]) if (c, i) in radius] for c in channels}
    may = lambda c: F.filter(F.array(*(F.when(bound(c, i, p) <= limits[c], F.lit(i)) for i, p in live[c])), lambda x: x.isNotNull())
    asked = queries.select(F.col(query_id).alias("query"), *(F.col(c).alias(f"q_{c}") for c in channels), *(may(c).alias(f"may_{c}") for c in channels))
    asked = asked.withColumn("cluster", F.explode(f"may_{first}"))
    words = {c: len(index.pivots[c][0]) for c in channels}
    met = index.rows.join(asked, F.col(f"c_{first}") == F.col("cluster"))
    for c in channels:
        met = met.where(F.array_contains(f"may_{c}", F.col(f"c_{c}"))).withColumn(f"d_{c}", bits.hamming(c, f"q_{c}", words[c])).where(F.col(f"d_{c}") <= limits[c])
    return met.select("query", F.col(id_col).alias("id"), *(f"d_{c}" for c in channels))


def stages(index: ChannelIndex, query: dict[str, list[int]], limits: dict[str, int]) -> DataFrame:
    """One row: clusters and how many the first channel prunes, rows that each channel's clusters leave."""
    keep = overlapping(index, query, limits)
    first = next(iter(keep))
    left, counts = F.lit(True), []
    for c, clusters in keep.items():
        left = left & (F.col(f"c_{c}").isin(clusters) if clusters else F.lit(False))
        counts.append(F.count_if(left).alias(f"left_{c}"))
    total = len(index.pivots[first])
    return index.rows.agg(F.count("*").alias("n"), *counts).withColumn("pruned", F.lit(total - len(keep[first])))

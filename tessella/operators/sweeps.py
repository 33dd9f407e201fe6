"""Sweeps: progressive filters over words, axes and channels, then a dearer score for what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits, vectors


def horizontal_sweep(df: DataFrame, query: list[int], limit: int, fp: str = "fp", steps: list[int] | None = None) -> DataFrame:
    """Rows within `limit` bits, with d. After each count of words in `steps` (1, 2, 4 and so on by
    default, so that all filters together are as long as the last comparison) a row whose distance so
    far is over the limit is compared no further; no row within it is lost."""
    q = bits.literal(query)
    doubling = [1 << i for i in range(max(0, len(query) - 1).bit_length()) if 1 << i < len(query)]
    for n in doubling if steps is None else steps:
        df = df.where(bits.hamming(fp, q, n) <= limit)
    return df.withColumn("d", bits.hamming(fp, q, len(query))).where(F.col("d") <= limit)


def horizontal_sweep_filtered(df: DataFrame, query: list[int], limit: int, keep: Column, fp: str = "fp") -> DataFrame:
    """The sweep over the rows that a condition keeps, which comes first."""
    return horizontal_sweep(df.where(keep), query, limit, fp)


def hybrid_cascade_sweep(df: DataFrame, query: list[int], limit: int, dense: Column, dense_limit: float, k: int, fp: str = "fp", id_col: str = "vec_id") -> DataFrame:
    """The sweep, then a dense distance of the survivors within its own limit; the k least first."""
    swept = horizontal_sweep(df, query, limit, fp).withColumn("dense", dense).where(F.col("dense") <= F.lit(dense_limit))
    return swept.orderBy("dense", id_col).limit(k)


def tier0_prefilter(df: DataFrame, query: list[int], k: int, vector: str = "v", id_col: str = "vec_id") -> DataFrame:
    """The k rows of largest integer dot product with the query, with score: a first, cheap cut."""
    score = bits.dot_i8(vector, F.array(*map(F.lit, query)))
    return df.withColumn("score", score).orderBy(F.desc("score"), id_col).limit(k)


def batch_top_k(df: DataFrame, queries: list[list[float]], k: int, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(query, id, score): for each of a list of queries the k rows of largest dot product, the smaller
    id among equals. A task multiplies its Arrow batches with all queries and keeps k rows a query
    of each batch, so what is shuffled is as long as the batches, not the rows."""
    q = np.asarray(queries, float)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float)
            order_ids = np.asarray(ids)
            scores = q @ x.T
            for i, row in enumerate(scores):
                top = np.lexsort((order_ids, -row))[:k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), i), pa.int32()), ids.take(pa.array(top)), pa.array(row[top])], names=["query", "id", "score"])

    best = df.select(id_col, vector).mapInArrow(run, f"query int, id {kind}, score double")
    place = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return best.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).drop("place")


# --- prefilters by coarse norms and deviations


def approx_norm(x: Column | str) -> Column:
    """The L2 norm of a row from its 8-bit values: sqrt of their squares' sum, times the scale."""
    x = vectors.col(x)

    def norm(top: Column) -> Column:
        squares = F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + F.pow(F.round(v / (top / 127.0)), F.lit(2.0)).cast("long"))
        return F.when(top == 0, F.lit(0.0)).otherwise(F.sqrt(squares.cast("double")) * (top / 127.0))

    return vectors.let(F.array_max(F.transform(x, F.abs)), norm)


def top_rows_by_norm(df: DataFrame, k: int, vector: str, id_col: str = "vec_id") -> DataFrame:
    return df.withColumn("norm", approx_norm(vector)).orderBy(F.desc("norm"), id_col).limit(k)


def approx_mean_std(x: Column | str) -> Column:
    """struct<mean, std> of a row from its values in 256 levels between the least and the largest."""
    x = vectors.col(x)

    def stats(low_high: Column) -> Column:
        low, wide = low_high["low"], (low_high["high"] - low_high["low"]) / 255.0
        level = lambda v: F.round((v - low) * (1.0 / wide))
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
        add = lambda a, v: F.struct((a["s"] + level(v)).alias("s"), (a["q"] + level(v) * level(v)).alias("q"))
        n = F.size(x).cast("double")

        def done(a: Column) -> Column:
            mean = a["s"] / n
            spread = F.sqrt(F.greatest(F.lit(0.0), a["q"] / n - mean * mean))
            return F.struct((mean * wide + low).alias("mean"), (spread * wide).alias("std"))

        flat = F.struct(low.alias("mean"), F.lit(0.0).alias("std"))
        return F.when(wide == 0, flat).otherwise(F.aggregate(x, zero, add, done))

    return vectors.let(F.struct(F.array_min(x).alias("low"), F.array_max(x).alias("high")), stats)


def approx_column_std(df: DataFrame, vector: str) -> DataFrame:
    """(j, std) from values in 256 levels between each column's least and largest: two grouped sums."""
    long = df.select(F.posexplode(vector).alias("j", "v")).withColumn("v", F.col("v").cast("double"))
    span = long.groupBy("j").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    wide = (F.col("high") - F.col("low")) / 255.0
    leveled = long.join(F.broadcast(span), "j").withColumn("q", F.round((F.col("v") - F.col("low")) * (1.0 / wide)))
    sums = leveled.groupBy("j", "low", "high").agg(F.count("*").alias("n"), F.sum("q").alias("s"), F.sum(F.col("q") * F.col("q")).alias("qq"))
    mean = F.col("s") / F.col("n")
    return sums.select("j", F.when(wide == 0, F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("qq") / F.col("n") - mean * mean)) * wide).alias("std"))


# --- three axes of 16-bit float lanes


def axis_distances(axes: list[Column], query: list[list[int]]) -> Column:
    """struct<x, y, z> of lane distances to a literal query."""
    d = [bits.lane_distance(a, F.array(*map(F.lit, q))) for a, q in zip(axes, query, strict=True)]
    return F.struct(*(v.alias(n) for v, n in zip(d, "xyz", strict=True)))


def spatial_scores(d: Column) -> Column:
    """struct<l1, linf, dominant, balance>: the sum, the largest, its axis (x before y before z), and
    1 where all axes are equal, 0 where one has it all."""
    l1, linf = d["x"] + d["y"] + d["z"], F.greatest(d["x"], d["y"], d["z"])
    dominant = F.when((d["x"] >= d["y"]) & (d["x"] >= d["z"]), "x").when(d["y"] >= d["z"], "y").otherwise("z")
    balance = F.when(l1 == 0, F.lit(1.0)).otherwise(1.0 - (linf / l1 - 1.0 / 3.0) * 1.5)
    return F.struct(l1.alias("l1"), linf.alias("linf"), dominant.alias("dominant"), balance.alias("balance"))


def spatial_sweep(df: DataFrame, axes: list[str], query: list[list[int]], limit: int, id_col: str = "vec_id") -> DataFrame:
    """Rows whose axes' distances add up to at most `limit`, with d and score; axis by axis, so a row
    that is over it is compared no further."""
    one = lambda i: bits.lane_distance(axes[i], F.array(*map(F.lit, query[i])))
    df = df.withColumn("dx", one(0)).where(F.col("dx") <= limit)
    df = df.withColumn("dy", one(1)).where(F.col("dx") + F.col("dy") <= limit)
    df = df.withColumn("d", F.struct(F.col("dx").alias("x"), F.col("dy").alias("y"), one(2).alias("z"))).drop("dx", "dy")
    return df.withColumn("score", spatial_scores(F.col("d"))).where(F.col("score.l1") <= limit).orderBy("score.l1", id_col)

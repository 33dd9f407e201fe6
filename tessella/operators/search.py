"""Scans and searches: one query fingerprint, a literal of bounded size, against a table.

The query travels in the plan, so every search is a filter over the scan; the exact distance is the
contract and no approximate stage drops a row that it would keep.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits, vectors
from ..functions.bits import SliceGate


def hamming_scan(df: DataFrame, query: list[int], limit: int, fp: str = "fp") -> DataFrame:
    """Rows at most `limit` bits away, with d."""
    return df.withColumn("d", bits.hamming(fp, bits.literal(query), len(query))).where(F.col("d") <= limit)


def nearest(df: DataFrame, distance: Column, k: int, id_col: str = "vec_id") -> DataFrame:
    """The k rows of least distance, the smaller id first among equals: a bounded heap in each task."""
    return df.withColumn("d", distance).orderBy("d", id_col).limit(k)


def hamming_top_k(df: DataFrame, query: list[int], k: int, fp: str = "fp", id_col: str = "vec_id") -> DataFrame:
    return nearest(df, bits.hamming(fp, bits.literal(query), len(query)), k, id_col)


def scan_first(df: DataFrame, query: list[int], below: int, k: int, fp: str = "fp", id_col: str = "vec_id") -> DataFrame:
    """The first k rows in id order that are strictly nearer than `below`."""
    return df.withColumn("d", bits.hamming(fp, bits.literal(query), len(query))).where(F.col("d") < below).orderBy(id_col).limit(k)


def cascade(df: DataFrame, query: dict[str, list[int]], limits: dict[str, int]) -> DataFrame:
    """Rows within every channel's limit, with d_<channel>: conjuncts in the order given, so a row
    that the first refuses is not compared further."""
    for channel, words in query.items():
        distance = bits.hamming(channel, bits.literal(words), len(words))
        df = df.where(distance <= limits[channel]).withColumn(f"d_{channel}", distance)
    return df


def kernel_pipeline(df: DataFrame, query: list[int], gate: SliceGate, fp: str = "fp", probe0: int = 1, probe1: int = 8) -> DataFrame:
    """Probes of the first words, then the exact energy; keeps rows with a positive score."""
    q, n = bits.literal(query), len(query)
    words = lambda k: bits.hamming(fp, q, min(k, n))
    df = df.where(words(probe0) <= gate.k0).where(words(probe1) <= gate.k1)
    df = df.withColumn("energy", bits.energy(fp, q, n))
    df = df.withColumn("hdr", bits.hdr_score(F.col("energy.conflict"), gate)).withColumn("sigma", bits.sigma_score(F.col("energy.conflict"), gate.bits))
    return df.where("hdr > 0")


def pipeline_stats(df: DataFrame, query: list[int], gate: SliceGate, fp: str = "fp", probe0: int = 1, probe1: int = 8) -> DataFrame:
    """One row: rows, rejected by each probe, rejection rates."""
    q, n = bits.literal(query), len(query)
    first = bits.hamming(fp, q, min(probe0, n)) > gate.k0
    second = ~first & (bits.hamming(fp, q, min(probe1, n)) > gate.k1)
    out = df.agg(F.count("*").alias("n"), F.count_if(first).alias("k0_rejected"), F.count_if(second).alias("k1_rejected"))
    rate = lambda x: F.coalesce(F.try_divide(x, F.col("n")), F.lit(0.0))
    return out.withColumn("k0_rate", rate(F.col("k0_rejected"))).withColumn("total_rate", rate(F.col("k0_rejected") + F.col("k1_rejected")))


def hybrid_pipeline(df: DataFrame, query: list[int], lanes: list[int], gate: SliceGate, k: int, fp: str = "fp", lane_col: str = "lanes", id_col: str = "vec_id", candidates: int = 100, lane_weight: float = 0.01) -> DataFrame:
    """Kernel pipeline, the best `candidates` by distance, then score = distance + lane_weight * lane distance, ascending."""
    kept = kernel_pipeline(df, query, gate, fp).withColumn("d", F.col("energy.conflict")).orderBy("d", id_col).limit(candidates)
    lane = bits.lane_distance(lane_col, F.array(*(F.lit(x) for x in lanes)))
    return kept.withColumn("lane_d", lane).withColumn("score", F.col("d") + F.lit(lane_weight) * F.col("lane_d")).orderBy("score", id_col).limit(k)


def cosine_top_k(df: DataFrame, query: list[float], k: int, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """k largest cosines. Up to 128 dimensions the products are written out term by term, for
    generated code; longer vectors, whose code would be too large for that, are folded."""
    v = F.col(vector)
    total = lambda xs: sum(xs[1:], xs[0])
    dims = range(len(query))
    if len(query) <= 128:
        dot = total([v[i].cast("double") * F.lit(float(query[i])) for i in dims])
        own = F.sqrt(total([v[i].cast("double") * v[i].cast("double") for i in dims]))
    else:
        literal = F.array(*(F.lit(float(x)) for x in query))
        dot = vectors.dot(vectors.doubles(v), literal)
        own = vectors.l2(vectors.doubles(v))
    size = sum(float(x) ** 2 for x in query) ** 0.5
    cos = F.coalesce(F.try_divide(dot, own * F.lit(size)), F.lit(0.0))
    return df.withColumn("cos", cos).orderBy(F.desc("cos"), id_col).limit(k)


def within(df: DataFrame, distance: Column, limit: int) -> DataFrame:
    """Rows at most `limit` away by any metric, with d."""
    return df.withColumn("d", distance).where(F.col("d") <= limit)


def sweep_then_rank(df: DataFrame, query: dict[str, list[int]], limits: dict[str, int], score: Column, k: int, id_col: str = "vec_id") -> DataFrame:
    """Four-channel filter, then the k survivors of largest score."""
    return cascade(df, query, limits).withColumn("score", score).orderBy(F.desc("score"), id_col).limit(k)


def block_masks(distance: int, words: int, width: int = 32) -> list[list[int]]:
    """One mask (a signed long for each word) for each choice of blocks that a pair at most `distance` bits apart may share.

    The changed bits touch at most `distance` blocks, so of distance + 3 blocks three are equal.
    """
    bits_all = words * width
    shared = max(0, min(3, bits_all - distance))
    blocks = max(1, distance + shared)
    cuts = [bits_all * i // blocks for i in range(blocks + 1)]
    whole = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [[signed(sum(c) >> (width * w) & ((1 << width) - 1)) for w in range(words)] for c in combinations(whole, shared)]


def _near_prints(one: DataFrame, limit: int, words: int, width: int) -> DataFrame:
    """(fa, fb, d), fa < fb: distinct fingerprints nearer than limit, met on three shared blocks.

    A block is dealt as a hash, since each meeting is verified. The rows of all masks are many times
    the table, which Spark's estimate of a generated table does not count; so they are joined by
    sorting, never sent to the driver as a broadcast, and made in all tasks: the fingerprints
    alone are so small that adaptive execution would put them in one.
    """
    tasks = int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    masked = lambda k, m: F.xxhash64(F.lit(k), *(F.col("fp")[w].bitwiseAND(F.lit(x).cast("long")) for w, x in enumerate(m)))
    cut = one.select("fp").repartition(tasks).select("fp", F.explode(F.array(*(masked(k, m) for k, m in enumerate(block_masks(limit - 1, words, width))))).alias("block"))
    met = cut.withColumnRenamed("fp", "fa").hint("merge").join(cut.withColumnRenamed("fp", "fb").hint("merge"), "block").where("fa < fb")
    return met.withColumn("d", bits.hamming("fa", "fb", words)).where(F.col("d") < limit).select("fa", "fb", "d").distinct()


def similar_classes(df: DataFrame, limit: int, words: int, fp: str = "fp", id_col: str = "vec_id", width: int = 32) -> DataFrame:
    """(id, class_id, links): a row for each row of df. class_id is the smallest id with the same
    fingerprint, links the number of other rows nearer than `limit` bits, its own class included.

    Only distinct fingerprints meet; what a class adds to its neighbours' links is its number of
    rows. So copies are never made into pairs, however many there are. A null fingerprint is a
    class of its own for each row, without links.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"))
    one = rows.where("fp IS NOT NULL").groupBy("fp").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    near = _near_prints(one.select("fp"), limit, words, width)
    both = near.select(F.col("fa").alias("fp"), F.col("fb").alias("other")).unionByName(near.select(F.col("fb").alias("fp"), F.col("fa").alias("other")))
    others = both.join(one.select(F.col("fp").alias("other"), F.col("n").alias("m")), "other").groupBy("fp").agg(F.sum("m").alias("others"))
    own = F.when(F.lit(limit) > 0, F.col("n") - 1).otherwise(F.lit(0))
    classes = one.join(others, "fp", "left").select("fp", "class_id", (own + F.coalesce("others", F.lit(0))).alias("links"))
    return rows.join(classes, "fp", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def similar_pairs(df: DataFrame, limit: int, words: int, fp: str = "fp", id_col: str = "vec_id", width: int = 32) -> DataFrame:
    """All pairs (a, b), a < b, nearer than `limit` bits, with d; fp holds words of `width` bits.

    Distinct fingerprints meet where they share three blocks (block_masks), and each meeting is
    verified; rows with one fingerprint are paired by it afterwards.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"))
    one = rows.where("fp IS NOT NULL").select("fp").distinct()
    near = _near_prints(one, limit, words, width)
    same = one.select(F.col("fp").alias("fa"), F.col("fp").alias("fb")).withColumn("d", bits.hamming("fa", "fb", words)).where(F.col("d") < limit)
    pairs = near.unionByName(same).join(rows.select(F.col("id").alias("x"), F.col("fp").alias("fa")), "fa").join(rows.select(F.col("id").alias("y"), F.col("fp").alias("fb")), "fb")
    return pairs.where("CASE WHEN fa = fb THEN x < y ELSE x <> y END").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "d")


def cosine_within(df: DataFrame, query: list[float], least: float, vector: str = "embedding") -> DataFrame:
    """Rows whose cosine with the query is at least `least`, with cos."""
    cos = vectors.cosine(vectors.doubles(vector), F.array(*(F.lit(float(x)) for x in query)))
    return df.withColumn("cos", cos).where(F.col("cos") >= F.lit(least))

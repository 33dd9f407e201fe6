"""Near copies by word shingles: MinHash bands as candidates, the exact Jaccard similarity of each link checked."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

SHINGLE = 5
#: A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: 0.9996 at 0.8.
BANDS, ROWS = 20, 5
#: Longs of parity bits for each set.
PARITY = 8
_random = np.random.default_rng(20)
_A, _B = (_random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
_A |= np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Ascending distinct hashes of a whole text's word shingles, unsigned; the text's words are one shingle where they are fewer."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), grams), np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of minima, signed; all zero for a text without a word."""
    if not len(hashes):
        return np.zeros(BANDS, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 4096):
        np.minimum(low, (hashes[k : k + 4096, None] * _A + _B).min(axis=0), out=low)
    return np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in low.reshape(BANDS, ROWS)], np.uint64).view(np.int64)


def _key(hashes: np.ndarray) -> int:
    x = xxhash.xxh64_intdigest(hashes.tobytes())
    return x - (1 << 64) if x >> 63 else x


def parity(hashes: np.ndarray) -> np.ndarray:
    """PARITY longs of bits, each whether an odd number of shingles falls on it."""
    odd = np.bincount((hashes % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _signatures(texts: DataFrame) -> DataFrame:
    """(th, key, bands, size, parity) of (th, text): key names the set of shingles, size is its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(_key, sets), pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64())), pa.array(map(len, sets), pa.int32()), pa.array(map(parity, sets), pa.list_(pa.int64()))], names=["th", "key", "bands", "size", "parity"])

    return texts.mapInArrow(run, "th long, key long, bands array<long>, size int, parity array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """(key, hashes) of (th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(map(_key, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["key", "hashes"])

    return texts.mapInArrow(run, "key long, hashes array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose shingles have at least that Jaccard similarity."""
    both = pairs.distinct().join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return materialize(both.where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared)).select("a", "b"), "near-links")


def _may(x: str, y: str, similarity: float) -> Column:
    """Whether two sets can be that similar: bits of parity that differ are no more than the shingles
    that only one of them has, so this refuses no similar pair."""
    apart = sum((F.bit_count(F.col(f"parity_{x}")[i].bitwiseXOR(F.col(f"parity_{y}")[i])) for i in range(PARITY)), F.lit(0))
    both = F.col(f"size_{x}") + F.col(f"size_{y}")
    return both - apart >= F.lit(similarity) * (both + apart)


def _side(rows: DataFrame, x: str) -> DataFrame:
    return rows.select("band", "value", "cell", "salt", *(F.col(c).alias(f"{c}_{x}") for c in ("key", "label", "size", "parity")))


def _near_pairs(rows: DataFrame, similarity: float, fine: int = 2048) -> DataFrame:
    """Pairs (a, b) of members of a bucket of n that have different labels and can be similar enough.

    Sizes of similar sets differ by the similarity at most, so members go to cells by the logarithm
    of their size and meet those of their own cell and of the two beside it. A bucket of over `fine`
    members is dealt by salt to a task for each `fine` of them, to each of which the other side is
    copied: no task holds all tests of a bucket, whatever is common to its members.
    """
    cell = F.when(F.col("size") > 0, F.floor(F.log(F.col("size").cast("double")) / -np.log(similarity))).otherwise(F.lit(-1)).cast("int")
    rows = rows.withColumns({"cell": cell, "tasks": F.ceil(F.col("n") / fine).cast("int")})
    left = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.col("tasks")).cast("int"))
    right = rows.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    may = (F.col("key_a") < F.col("key_b")) & (F.col("label_a") != F.col("label_b")) & _may("a", "b", similarity)
    return _side(left, "a").join(_side(right, "b"), ["band", "value", "cell", "salt"]).where(may).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))


def similar_sets(texts: DataFrame, similarity: float = 0.8, prints: DataFrame | None = None, close: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """texts: (th, text), th a hash of the text. Returns (th, key), key naming the text's set of
    shingles, and links (a, b) of keys of at least that similarity.

    The links' components are those of all such pairs that share a band. First each member of a
    bucket is held against the bucket's most central member, and takes the most central of the
    members that it is linked to as its label. Then members of a bucket with different labels
    are held against each other where their sizes and parity bits allow the similarity (_near_pairs).
    So the pairs that are made are about those that are links; no bucket is capped and no link is
    lost. prints (th, fp) and links close (a, b) between fingerprints add candidates, which are
    checked like any other. The sets of shingles are made once, for texts that have a candidate.
    """
    rows = materialize(_signatures(texts.select("th", "text")), "near-signatures")
    signed = rows.groupBy("key").agg(F.min("th").alias("th"), *(F.first(c).alias(c) for c in ("bands", "size", "parity")))
    signed, keys = materialize(signed, "near-keys"), rows.select("th", "key").distinct()
    members = signed.select("key", F.posexplode("bands").alias("band", "value"))
    buckets = members.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(members.join(buckets, ["band", "value"]), "near-buckets")
    # The most central member of a bucket, which shares the largest buckets: of copies, the least changed.
    weights = materialize(met.groupBy("key").agg(F.sum("n").alias("weight")), "near-weights")
    met = materialize(met.join(weights, "key"), "near-weighted")
    hubs = met.groupBy("band", "value").agg(F.max_by("key", F.struct("weight", "key")).alias("hub"))
    pairs = met.join(hubs, ["band", "value"]).select(F.col("key").alias("a"), F.col("hub").alias("b"))
    if prints is not None and close is not None:
        held = keys.join(prints.select("th", "fp").distinct(), "th").select("key", "fp").distinct()
        first = held.groupBy("fp").agg(F.min("key").alias("first"))
        end = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"key_{c}"))
        pairs = pairs.unionByName(held.join(first, "fp").select(F.col("key").alias("a"), F.col("first").alias("b")))
        pairs = pairs.unionByName(close.join(end("a"), "a").join(end("b"), "b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b")))
    pairs = materialize(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(met.select("key")).distinct()
    named = signed.select("key", "th").join(needed, "key").select("th")
    sets = materialize(_sets(texts.select("th", "text").join(named, "th", "left_semi").dropDuplicates(["th"])), "near-sets")
    links = _verified(pairs, sets, similarity)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = both.join(weights.withColumnRenamed("key", "b"), "b").select(F.col("a").alias("key"), F.col("b").alias("other"), "weight")
    ends = ends.unionByName(weights.select("key", F.col("key").alias("other"), "weight"))
    labels = ends.groupBy("key").agg(F.max_by("other", F.struct("weight", "other")).alias("label"))
    placed = materialize(met.select("band", "value", "key", "n").join(labels, "key"), "near-labels")
    mixed = placed.groupBy("band", "value").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band", "value")
    placed = placed.join(mixed, ["band", "value"]).join(signed.select("key", "size", "parity"), "key")
    placed = materialize(placed, "near-mixed")
    return keys, links.unionByName(_verified(_near_pairs(placed, similarity), sets, similarity))

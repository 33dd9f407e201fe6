"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, verified Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize
from .components import connected_components
from .nearcopies import similar_sets

BITS = 64


def simhash(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one whole text; 0 where it has no word."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), grams), np.dtype("<u8"))
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, th, fp): th is the text's hash, fp holds the 64 bits as a signed long. Map only; a null text counts as empty."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(x.as_py(), shingle) for x in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "th", "fp"])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, th long, fp long")


def _block_keys(distance: int, blocks: int) -> tuple[list[int], list[int]]:
    """Block masks, and for each choice of blocks that a close pair must share their joint mask.

    distance changed bits touch at most that many blocks, so blocks - distance blocks are equal.
    """
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return masks, [sum(c) for c in combinations(masks, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _key(fp: Column, mask: int) -> Column:
    return fp.bitwiseAND(F.lit(_signed(mask)).cast("long"))


def close_pairs(fps: DataFrame, distance: int = 2, blocks: int = 4, bucket_limit: int = 32) -> DataFrame:
    """Links (a, b) between different fingerprints at most `distance` bits apart, enough of them
    that the components are those of all such pairs.

    fps: one column fp of distinct longs. Each fingerprint is emitted once for each choice of
    blocks; a bucket of up to bucket_limit fingerprints is joined with itself and every pair
    verified. A larger bucket is not joined (its pairs would grow with the square of its size):
    each member is emitted with its neighbours at distance 1 outside the shared blocks instead;
    members that meet at a neighbour are at most 2 bits apart, so each is linked to the smallest
    there, and any pair at 1 or 2 bits does meet. That is exact for distance 2, and linear.
    """
    if distance != 2:
        raise ValueError("large buckets are exact for distance 2 only")
    _, keys = _block_keys(distance, blocks)
    rows = fps.select(
        "fp",
        F.inline(F.array(*(F.struct(F.lit(i).cast("tinyint").alias("k"), _key(F.col("fp"), m).alias("block")) for i, m in enumerate(keys)))),
    )
    sizes = rows.groupBy("k", "block").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    sizes = materialize(sizes, "simhash-sizes")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    two = sizes.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    more = rows.join(sizes.where("n > 2").select("k", "block", "n"), ["k", "block"])
    more = materialize(more, "simhash-buckets")
    some = more.where(F.col("n") <= bucket_limit).drop("n")
    joined = (
        some.withColumnRenamed("fp", "a")
        .join(some.withColumnRenamed("fp", "b"), ["k", "block"])
        .where("a < b")
        .select("a", "b")
    )
    # The bits outside the shared blocks, for each choice of blocks.
    outside = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)).cast("long") for i in range(BITS) if not m >> i & 1)) for m in keys))
    met = (
        more.where(F.col("n") > bucket_limit)
        .select("fp", F.explode(F.element_at(outside, F.col("k").cast("int") + 1)).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("meet"))
        .distinct()
    )
    star = met.groupBy("meet").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("meet", "a")
    starred = met.join(star, "meet").where("fp <> a").select("a", F.col("fp").alias("b"))
    return two.unionByName(joined).where(near).unionByName(starred).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    distance: int = 2,
    blocks: int = 4,
) -> DataFrame:
    """Each row's fingerprint and component.

    Returns (doc_id, th long, fp long, fingerprint string of 16 hex digits, component_id), one row
    per input row; th is the text's hash. component_id is the smallest doc_id reachable over links
    of at most `distance` differing bits, itself included. Null and empty texts have fingerprint zero and are linked
    like any other; repeated rows stay; an empty table gives an empty result; other columns of
    docs are ignored. A null doc_id is never a component's name unless all its members are null.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-fps")
    by_fp = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    links = close_pairs(by_fp.select("fp"), distance, blocks)
    nodes = connected_components(links)
    rooted = by_fp.join(nodes.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "th", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """(doc_id, th, component_id) as near_duplicates, but two texts are linked if their 5-word
    shingles have at least that Jaccard similarity.

    Close fingerprints are candidates, and so are texts that share a band of minima (nearcopies):
    at 0.8 and 5-word shingles fingerprints differ by about ten bits, too many for blocks alone.
    Texts without a word are alike.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash-fps")
    close = materialize(close_pairs(materialize(prints.select("fp").distinct(), "simhash-distinct")), "simhash-links")
    texts = docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    keys, links = similar_sets(texts, similarity, prints, close)
    firsts = prints.groupBy("th").agg(F.min("doc_id").alias("first")).join(keys, "th")
    rooted = firsts.join(connected_components(links).select(F.col("node").alias("key"), "root"), "key", "left")
    rooted = materialize(rooted.select("th", "first", F.coalesce("root", "key").alias("root")), "simhash-rooted")
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(names, "root").select("th", "component_id"), "th").select("doc_id", "th", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, **how: int) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays.

    Components are those of near_copies if similarity is given, else of near_duplicates. Rows that
    repeat that doc_id stay as they are; rows without doc_id stay. A doc_id that stands on several
    texts loses only the rows whose own text is a later copy.
    """
    if similarity is None:
        found = near_duplicates(docs, id_col, text_col, **how)
    else:
        found = near_copies(docs, id_col, text_col, similarity)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone"), F.col("th").alias("__th")).distinct()
    return docs.join(gone, (F.col(id_col) == F.col("__gone")) & (F.xxhash64(text_col) == F.col("__th")), "left_anti")

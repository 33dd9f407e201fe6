"""A hashed candidate index: tables of keys in order on disk, probed by windows of neighbouring keys.

An index is a folder (see _versions): runs, each with a table of keys, their fences and the
fingerprints. The first run is what build was given; an insert adds one; compact and rebuild make one of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits
from . import _versions
from ._cut import stored
from ._order import numbered, running_max

#: Hash bits in a key.
BITS = 64


def positions(lanes: int, width: int, tables: int, sample: int, seed: int) -> np.ndarray:
    """[tables, BITS, sample]: the fingerprint's bits of which each hash bit is the parity.

    With as many bits as a key has and sample 1, each table is a permutation of them all.
    """
    rng, n = np.random.default_rng(seed), lanes * width
    if sample == 1 and n >= BITS:
        return np.stack([rng.permutation(n)[:BITS, None] for _ in range(tables)])
    return rng.integers(0, n, (tables, BITS, sample))


def hashed(df: DataFrame, lanes: int, width: int, tables: int, sample: int, seed: int) -> DataFrame:
    """(id, t, key) of (id, fp): a row for each of the tables; keys are signed, in the order of their
    unsigned bits. By Arrow batch, 1,024 fingerprints at a time, so wide ones stay within memory."""
    where = positions(lanes, width, tables, sample, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 1024):
                b = whole.slice(lo, 1024)
                words = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(len(b), lanes)
                ones = np.unpackbits(words.view(np.uint8).reshape(len(b), lanes, 8), axis=2, bitorder="little")[:, :, :width].reshape(len(b), -1)
                for t in range(tables):
                    code = np.ascontiguousarray(np.packbits(np.bitwise_xor.reduce(ones[:, where[t]], axis=2), axis=1)).view(">u8").ravel().astype(np.uint64)
                    key = (code ^ np.uint64(1 << 63)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(b), t, np.int32)), pa.array(key)], names=["id", "t", "key"])

    rows = df.select("id", F.col("fp").cast("array<bigint>").alias("fp")).where("fp is not null")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, t int, key long")


def _run(keys: DataFrame, prints: DataFrame, path: str, block: int) -> dict:
    """One run: keys in order, cut into blocks of `block` rows, the first key of each, and the fingerprints."""
    spark = keys.sparkSession
    ranked = numbered(keys, "t", "key", "id")
    name = _versions.write(ranked.select("t", "key", "id", F.floor(F.col("rank") / block).alias("block")), path, "keys")
    fences = _versions.table(spark, path, name).groupBy("block").agg(F.min(F.struct("t", "key")).alias("f")).select("f.t", "f.key", "block")
    return {"keys": name, "fences": _versions.write(fences, path, "fences"), "prints": _versions.write(prints, path, "prints")}


def build(df: DataFrame, path: str, lanes: int, width: int = 64, tables: int = 4, sample: int = 8, block: int = 16, seed: int = 1) -> int:
    """Index (id, fp array<bigint>) in the folder; returns the version. Ids are distinct; rows with a
    null fingerprint are left out. More tables and larger blocks find more and cost more."""
    if tables < 1 or sample < 1 or block < 1:
        raise ValueError("tables, sample and block must be 1 or more")
    spec = {"lanes": lanes, "width": width, "tables": tables, "sample": sample, "seed": seed}
    before, _ = _versions.read(df.sparkSession, path)
    prints = stored(df.select("id", "fp").where("fp is not null"), "index-prints")
    run = _run(hashed(prints, **spec), prints, path, block)
    return _versions.commit(df.sparkSession, path, before, {"spec": spec, "block": block, "runs": [run]})


def entries(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(id, fp) of all that is indexed."""
    _, m = _versions.read(spark, path, version)
    return _all(spark, path, m, "prints")


def _all(spark: SparkSession, path: str, manifest: dict, name: str) -> DataFrame:
    out = None
    for run in manifest["runs"]:
        one = _versions.table(spark, path, run[name])
        out = one if out is None else out.unionByName(one)
    return out


def insert(df: DataFrame, path: str) -> int:
    """Add (id, fp) as a run of its own: nothing that is there is written again. Ids must be new."""
    spark = df.sparkSession
    before, m = _versions.read(spark, path)
    rows = stored(df.select("id", "fp").where("fp is not null"), "index-prints")
    if rows.join(_all(spark, path, m, "prints").select("id"), "id", "left_semi").limit(1).count():
        raise ValueError("an id is indexed already")
    run = _run(hashed(rows, **m["spec"]), rows, path, m["block"])
    return _versions.commit(spark, path, before, m | {"runs": [*m["runs"], run]})


def compact(spark: SparkSession, path: str) -> int:
    """Merge all runs into one; keys are put in order anew, not hashed anew."""
    before, m = _versions.read(spark, path)
    run = _run(_all(spark, path, m, "keys").select("id", "t", "key"), _all(spark, path, m, "prints"), path, m["block"])
    return _versions.commit(spark, path, before, m | {"runs": [run]})


def rebuild(spark: SparkSession, path: str, **changed: int) -> int:
    """Hash everything anew into one run, with other tables, sample, seed or block if given."""
    before, m = _versions.read(spark, path)
    block, spec = changed.pop("block", m["block"]), m["spec"] | changed
    prints = _all(spark, path, m, "prints")
    return _versions.commit(spark, path, before, {"spec": spec, "block": block, "runs": [_run(hashed(prints, **spec), prints, path, block)]})


def candidates(queries: DataFrame, path: str, version: int | None = None) -> DataFrame:
    """(q, id), distinct: for each query (q, fp), table and run the rows of the block in which its key
    falls and of the two beside it, so between block and 3 * block rows, half of them and more on
    either side; never a key's whole rows, however many share it.

    The queries' keys and the fences (one row for block * rows) are put in one order; the last fence
    before a key names its block. Only then do queries meet the keys, by block.
    """
    spark = queries.sparkSession
    _, m = _versions.read(spark, path, version)
    asked = stored(hashed(queries.select(F.col("q").alias("id"), "fp"), **m["spec"]).withColumnRenamed("id", "q"), "index-asked")
    found = None
    for run in m["runs"]:
        fences = _versions.table(spark, path, run["fences"]).select("t", "key", "block", F.lit(0).alias("kind"), F.lit(None).cast(asked.schema["q"].dataType).alias("q"))
        both = fences.unionByName(asked.select("t", "key", F.lit(None).cast("long").alias("block"), F.lit(1).alias("kind"), "q"))
        # Ties: fences first, of one key the last; so a key that fills many blocks is met at its end.
        placed = running_max(both, "block", "t", "key", "kind", "block", "q").where("kind = 1")
        near = F.explode(F.array(*(F.coalesce("block", F.lit(0)) + i for i in (-1, 0, 1)))).alias("block")
        one = placed.select("q", "t", near).join(_versions.table(spark, path, run["keys"]), ["t", "block"]).select("q", "id")
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def search(queries: DataFrame, path: str, k: int, version: int | None = None) -> DataFrame:
    """(q, id, d): of each query's candidates the k nearest by exact Hamming distance, the smaller id
    among equals. Queries are (q, fp), q distinct; a null fp finds nothing. An empty index gives no row."""
    spark = queries.sparkSession
    _, m = _versions.read(spark, path, version)
    met = candidates(queries, path, version).join(_all(spark, path, m, "prints"), "id").join(queries.select("q", F.col("fp").alias("asked")), "q")
    met = met.select("q", "id", bits.hamming("fp", "asked", m["spec"]["lanes"]).alias("d"))
    place = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))  # of a bounded number of candidates
    return met.withColumn("place", place).where(F.col("place") <= k).drop("place")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact's rows (q, d), each query's k nearest, that found matches in distance:
    a found row counts if it is no farther than the query's k-th."""
    last = exact.groupBy("q").agg(F.max("d").alias("last"), F.count("*").alias("k"))
    good = found.join(last, "q").where("d <= last").groupBy("q").agg(F.least(F.count("*"), F.max("k")).alias("good"))
    row = last.join(good, "q", "left").agg(F.sum(F.coalesce("good", F.lit(0))) / F.sum("k")).first()
    return float(row[0] if row[0] is not None else 1.0)

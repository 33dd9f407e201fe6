"""Hypervector algebra over tables: bundling, spatial encodings, edges and inference over them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits


def bundle_majority(df: DataFrame, by: list[str], lanes: int, width: int, fp: str = "fp") -> DataFrame:
    """Majority vote for each bit over the rows of a group: set if in more than half (floor), ties 0.

    One counter for each bit, summed before the shuffle, so a group of any size is a few numbers
    from each task. Over 128 bits the counters are one vector (votes), not an expression a bit.
    """
    if lanes * width > 128:
        return votes(df, by, lanes, width, fp).drop("agreed")
    one = lambda w, i: F.sum(F.shiftright(F.col(fp)[w], i).bitwiseAND(F.lit(1).cast("long")))
    counts = [one(w, i).alias(f"c{w}_{i}") for w in range(lanes) for i in range(width)]
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), *counts)
    bit = lambda w, i: F.when(F.col(f"c{w}_{i}") > F.floor(F.col("n") / 2), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    lane = lambda w: reduce(lambda a, b: a.bitwiseOR(b), [bit(w, i) for i in range(width)])
    return sums.select(*by, "n", F.array(*(lane(w) for w in range(lanes))).alias(fp))


def _codes(columns: list[pa.Array], n: int) -> np.ndarray:
    """A number for each row, equal where all key columns are (nulls are one value)."""
    out = np.zeros(n, np.int64)
    for c in columns:
        coded = c.dictionary_encode(null_encoding="encode")
        out = np.unique(out * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_inverse=True)[1].astype(np.int64)
    return out


def votes(df: DataFrame, by: list[str], lanes: int, width: int, fp: str = "fp", state_bytes: int = 64 << 20, heavy: int = 32) -> DataFrame:
    """(by..., n, fp, agreed) of the rows of each group: their number, their majority as above, and the
    number of bits on which more than three quarters of them (1 at least) agree, either way.

    A group with `heavy` rows in an Arrow batch becomes a vector of counts, kept by the task until it
    holds state_bytes of them; rows of smaller groups are handed on as they are, since a vector is
    larger than they. Both meet in order of the groups, a slice of rows at a time, as whole
    arrays. Rows with a null fp are left out. Any width is one short plan.
    """
    size = lanes * width
    some = max(1, (8 << 20) // (8 * size))
    rows = df.select(*by, F.col(fp).cast("array<bigint>").alias("__fp")).where("__fp is not null")
    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    k = len(by)

    def ones_of(words: pa.Array) -> np.ndarray:
        w = np.ascontiguousarray(words.flatten().to_numpy(zero_copy_only=False).astype("<i8")).view(np.uint8).reshape(len(words), lanes, 8)
        return np.unpackbits(w, axis=2, bitorder="little")[:, :, :width].reshape(len(words), size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[int, np.ndarray]] = {}
        kinds = None

        def out() -> pa.RecordBatch:
            names = [pa.array(column, kind) for column, kind in zip(zip(*held, strict=True), kinds, strict=True)] if by else []
            vectors = [pa.array([n for n, _ in held.values()], pa.int64()), pa.nulls(len(held), pa.list_(pa.int64())), pa.array([x for _, x in held.values()], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*names, *vectors], names=[*by, "n", "words", "ones"])

        for b in batches:
            kinds = [c.type for c in b.columns[:k]]
            code = _codes(b.columns[:k], len(b))
            many = np.bincount(code, minlength=1) >= (heavy if by else 1)
            light = b.filter(pa.array(~many[code]))
            if len(light):
                yield pa.RecordBatch.from_arrays([*light.columns[:k], pa.array(np.ones(len(light), np.int64)), light.column(k).cast(pa.list_(pa.int64())), pa.nulls(len(light), pa.list_(pa.int64()))], names=[*by, "n", "words", "ones"])
            for group in np.flatnonzero(many):
                places = np.flatnonzero(code == group)
                key = tuple(c[int(places[0])].as_py() for c in b.columns[:k])
                n, sums = held.get(key, (0, np.zeros(size, np.int64)))
                for lo in range(0, len(places), some):
                    sums = sums + ones_of(b.column(k).take(pa.array(places[lo : lo + some]))).sum(axis=0, dtype=np.int64)
                held[key] = n + len(places), sums
                if len(held) * size * 8 > state_bytes:
                    yield out()
                    held = {}
        if held:
            yield out()

    parts = rows.mapInArrow(count, ", ".join(filter(None, [keys, "n long, words array<long>, ones array<long>"])))
    parts = parts.repartition(*by).sortWithinPartitions(*by) if by else parts.coalesce(1)

    def result(names: list[pa.Array], n: np.ndarray, ones: np.ndarray) -> pa.RecordBatch:
        sure = np.maximum(1, n * 3 // 4)[:, None]
        packed = np.packbits((ones > n[:, None] // 2).reshape(len(n), lanes, width), axis=2, bitorder="little")
        words = np.zeros((len(n), lanes, 8), np.uint8)
        words[:, :, : packed.shape[2]] = packed
        agreed = ((ones > sure) | (ones < n[:, None] - sure)).sum(axis=1)
        offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * lanes)
        return pa.RecordBatch.from_arrays([*names, pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(words.view("<i8").ravel())), pa.array(agreed, pa.int64())], names=[*by, "n", fp, "agreed"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the group that may go on: its keys, a row each, number and counts
        for whole in batches:
            for lo in range(0, len(whole), some):
                b = whole.slice(lo, some)
                names = list(b.columns[:k])
                number, ones = b.column(k).to_numpy().astype(np.int64), np.zeros((len(b), size), np.int64)
                counted = b.column(k + 2).is_valid().to_numpy(zero_copy_only=False)
                ones[~counted] = ones_of(b.column(k + 1).filter(pa.array(~counted)))
                ones[counted] = b.column(k + 2).filter(pa.array(counted)).flatten().to_numpy().reshape(-1, size)
                if last is not None:
                    names = [pa.concat_arrays([x, y]) for x, y in zip(last[0], names, strict=True)]
                    number, ones = np.concatenate([last[1], number]), np.concatenate([last[2], ones])
                code = _codes(names, len(number))
                starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                number, ones = np.add.reduceat(number, starts), np.add.reduceat(ones, starts, axis=0)
                names = [x.take(pa.array(starts)) for x in names]
                if len(starts) > 1:
                    yield result([x.slice(0, len(starts) - 1) for x in names], number[:-1], ones[:-1])
                last = [x.slice(len(starts) - 1) for x in names], number[-1:], ones[-1:]
        if last is not None:
            yield result(*last)

    return parts.mapInArrow(meet, ", ".join(filter(None, [keys, f"n long, `{fp}` array<long>, agreed long"])))


def bundle_sum(df: DataFrame, by: list[str], low: int, high: int, vector: str = "v") -> DataFrame:
    """Position-wise sums clamped to [low, high], as (by, pos, v)."""
    long = df.select(*by, F.posexplode(vector).alias("pos", "x"))
    return long.groupBy(*by, "pos").agg(F.least(F.lit(high), F.greatest(F.lit(low), F.sum("x"))).cast("long").alias("v"))


def bundle_circular(df: DataFrame, by: list[str], vector: str = "v") -> DataFrame:
    """Circular mean modulo 256 of each position, as (by, pos, v)."""
    angle = F.col("x") * F.lit(2 * 3.141592653589793 / 256)
    mean = F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle))) * F.lit(256 / (2 * 3.141592653589793))
    long = df.select(*by, F.posexplode(vector).alias("pos", "x"))
    return long.groupBy(*by, "pos").agg(F.pmod(F.round(mean).cast("int"), F.lit(256)).alias("v"))


def or_pyramid(df: DataFrame, row: str, column: str, word: str, levels: int) -> DataFrame:
    """(level, row, column, word): the OR of 2 x 2 cells, level by level from the given one (0)."""
    level = df.select(F.lit(0).alias("level"), F.col(row).alias("row"), F.col(column).alias("column"), F.col(word).alias("word"))
    out = level
    for k in range(1, levels + 1):
        level = level.groupBy(F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("column") / 2).alias("column")).agg(F.bit_or("word").alias("word")).select(F.lit(k).alias("level"), "row", "column", "word")
        out = out.unionByName(level)
    return out


def spo_encode(s: Column, p: Column, o: Column) -> Column:
    """struct<sp, po, so> of pairwise XOR."""
    return F.struct(bits.xor_bind(s, p).alias("sp"), bits.xor_bind(p, o).alias("po"), bits.xor_bind(s, o).alias("so"))


def spo_recover(crystal: Column, slot: str, known: str, value: Column) -> Column:
    """The open slot from a known one: XOR with the pair that joins both."""
    pair = "".join(x for x in "spo" if x in slot + known)
    return bits.xor_bind(crystal[{"sp": "sp", "po": "po", "so": "so"}[pair]], value)


def encode_edge(src: Column, dst: Column, role: Column, shift: int, lanes: int, width: int = 64) -> Column:
    """permute(src) ^ dst ^ role."""
    return bits.xor_bind(bits.xor_bind(bits.permute(src, shift, lanes, width), dst), role)


def decode_edge_source(edge: Column, dst: Column, role: Column, shift: int, lanes: int, width: int = 64) -> Column:
    return bits.permute(bits.xor_bind(bits.xor_bind(edge, dst), role), lanes * width - shift, lanes, width)


#: Fixed rotation offsets of the verbs.
VERBS = {"BECOMES": 1, "CAUSES": 2, "SUPPORTS": 3, "CONTRADICTS": 4, "REFINES": 5, "GROUNDS": 6, "ABSTRACTS": 7}


def encode_verb(src: Column, verb: str, dst: Column, lanes: int, width: int = 64) -> Column:
    """src ^ permute(src, k) ^ permute(dst, 2k), k the verb's offset."""
    k = VERBS[verb]
    return bits.xor_bind(bits.xor_bind(src, bits.permute(src, k, lanes, width)), bits.permute(dst, 2 * k, lanes, width))


def decode_target(edge: Column, src: Column, verb: str, lanes: int, width: int = 64) -> Column:
    k = VERBS[verb]
    rotated = bits.xor_bind(bits.xor_bind(edge, src), bits.permute(src, k, lanes, width))
    return bits.permute(rotated, lanes * width - 2 * k, lanes, width)


def causality_asymmetry(src: Column, verb: str, dst: Column, lanes: int, width: int = 64) -> Column:
    """Share of bits in which the edge and its reverse differ."""
    forward, back = encode_verb(src, verb, dst, lanes, width), encode_verb(dst, verb, src, lanes, width)
    return bits.hamming(forward, back, lanes) / F.lit(float(lanes * width))


def nearest_entry(probe: DataFrame, codebook: DataFrame, lanes: int, max_entries: int = 10_000) -> DataFrame:
    """probe (id, fp) with its nearest codebook entry (entry, d), the smaller entry among equals.

    The codebook is a list of names, not data; more than max_entries raises. It is broadcast, and
    each Arrow batch of probes is held against it in slices, so the probe table is neither shuffled
    nor multiplied. An empty codebook gives nulls.
    """
    book = codebook.select("entry", "fp").orderBy("entry").limit(max_entries + 1).toArrow().combine_chunks()
    if book.num_rows > max_entries:
        raise ValueError(f"the codebook has over {max_entries} entries")
    words = np.array(book.column("fp").to_pylist(), np.int64).reshape(-1, lanes).view(np.uint64)
    names = pa.array(book.column("entry").to_pylist(), book.schema.field("entry").type)
    shared = probe.sparkSession.sparkContext.broadcast((names, words))
    kinds = f"id {probe.schema['id'].dataType.simpleString()}, entry {codebook.schema['entry'].dataType.simpleString()}, d long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, words = shared.value
        for b in batches:
            fps = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, lanes).view(np.uint64)
            best, at = np.full(len(fps), np.iinfo(np.int64).max), np.full(len(fps), -1)
            for lo in range(0, len(words), 64):
                d = np.bitwise_count(fps[:, None, :] ^ words[None, lo : lo + 64, :]).sum(-1, dtype=np.int64)
                near = d.argmin(1)
                low = d[np.arange(len(fps)), near]
                closer = low < best
                best[closer], at[closer] = low[closer], lo + near[closer]
            none = at < 0
            entry = names.take(pa.array(at, mask=none))
            yield pa.RecordBatch.from_arrays([b.column(0), entry, pa.array(best, mask=none)], names=["id", "entry", "d"])

    return probe.select("id", "fp").mapInArrow(run, kinds)


def decay(fp: Column, key: Column, lanes: int, keep: float, seed: int, width: int = 64) -> Column:
    """fp with each set bit cleared with about probability 1 - keep: a bit goes where it is set in all
    of n words drawn for (seed, key, lane) from MD5, 2^-n being nearest to 1 - keep."""
    if keep >= 1:
        return fp
    n = max(1, round(-math.log2(1 - max(0.0, keep))))
    text = lambda w, k: F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(str(w)), F.lit(str(k)))
    half = lambda w, k, at: F.conv(F.substring(F.md5(text(w, k).cast("binary")), at, 8), 16, 10).cast("long")
    word = lambda w, k: half(w, k, 1) if width <= 32 else F.shiftleft(half(w, k, 1), 32).bitwiseOR(half(w, k, 9))
    killed = lambda w: reduce(lambda a, b: a.bitwiseAND(b), [word(w, k) for k in range(n)])
    return F.array(*(fp[w].bitwiseAND(F.bitwise_not(killed(w))) for w in range(lanes)))


def infer_verb(edge: Column, src: Column, dst: Column, lanes: int, width: int = 64) -> Column:
    """struct<d, verb>: the verb whose decoded target is nearest to dst, the smaller offset among equals."""
    one = lambda v, k: F.struct(bits.hamming(decode_target(edge, src, v, lanes, width), dst, lanes).alias("d"), F.lit(k).alias("k"), F.lit(v).alias("verb"))
    best = F.array_min(F.array(*(one(v, k) for v, k in VERBS.items())))
    return F.struct(best["d"].alias("d"), best["verb"].alias("verb"))


def bundle_average(df: DataFrame, by: list[str], vector: str = "v") -> DataFrame:
    """(by, pos, v): the mean of each position, rounded down; for phases that do not wrap around."""
    long = df.select(*by, F.posexplode(vector).alias("pos", "x"))
    return long.groupBy(*by, "pos").agg(F.floor(F.sum("x") / F.count("*")).cast("int").alias("v"))


def mutate(triple: Column, slots: str, replacement: Column) -> Column:
    """struct<s, p, o, confidence> with one or two of its slots replaced: confidence halves for each."""
    part = lambda c: (replacement if c in slots else triple[c]).alias(c)
    return F.struct(*map(part, "spo"), (triple["confidence"] * 0.5 ** len(slots)).alias("confidence"))

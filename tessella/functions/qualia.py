"""Packed vectors of 16 signed bytes and a magnitude, nibble codes, and masked 8 x 8 x 32 volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import col, elementwise, let


def compress(values: Column | str) -> Column:
    """struct<resonance, magnitude>: values over their largest size, times 127; zeros where there is none."""
    x = col(values)

    def packed(top: Column) -> Column:
        q = F.transform(x, lambda v: F.least(F.lit(127), F.greatest(F.lit(-127), F.round(v * 127.0 / top).cast("int"))))
        zeros = F.transform(x, lambda _: F.lit(0))
        tiny = top < 1.1920929e-07
        return F.struct(F.when(tiny, zeros).otherwise(q).alias("resonance"), F.when(tiny, F.lit(0.0)).otherwise(top / 127.0).alias("magnitude"))

    return let(F.array_max(F.transform(x, F.abs)), packed)


def hydrate(packed: Column) -> Column:
    return let(packed, lambda p: F.transform(p["resonance"], lambda r: r * p["magnitude"]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(elementwise(hydrate(a), hydrate(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def invert(packed: Column) -> Column:
    """The opposite direction: only the magnitude's sign changes."""
    return F.struct(packed["resonance"].alias("resonance"), (-packed["magnitude"]).alias("magnitude"))


def bundle(df: DataFrame, by: list[str], packed: str, dims: int = 16) -> DataFrame:
    """(by, packed): the sum of a group's vectors, compressed again; a group of one stays as it is.

    One sum for each dimension, combined before the shuffle.
    """
    h = lambda i: F.sum(F.col(packed)["resonance"][i] * F.col(packed)["magnitude"])
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), F.first(packed).alias("one"), *(h(i).alias(f"s{i}") for i in range(dims)))
    summed = compress(F.array(*(F.col(f"s{i}") for i in range(dims))))
    return sums.select(*by, F.when(F.col("n") == 1, F.col("one")).otherwise(summed).alias(packed))


def causing(packed: Column, dims: list[int]) -> Column:
    """Whether at least two of the causality dimensions are negative."""
    return sum((F.when(packed["resonance"][d] < 0, 1).otherwise(0) for d in dims), F.lit(0)) >= 2


def nibbles(df: DataFrame, vector: str, dims: int, levels: int = 15) -> DataFrame:
    """df plus nib, each dimension scaled between the table's least and largest value to 0..levels.

    The bounds are one row of partial minima and maxima, read first.
    """
    v = lambda i: F.col(vector)[i].cast("double")
    row = df.agg(*(F.min(v(i)).alias(f"a{i}") for i in range(dims)), *(F.max(v(i)).alias(f"b{i}") for i in range(dims))).first()
    if row is None or row["a0"] is None:
        return df.withColumn("nib", F.array().cast("array<int>"))
    low = [row[f"a{i}"] for i in range(dims)]
    width = [row[f"b{i}"] - row[f"a{i}"] if abs(row[f"b{i}"] - row[f"a{i}"]) >= 1e-9 else 1.0 for i in range(dims)]
    one = lambda i: F.least(F.lit(levels), F.greatest(F.lit(0), F.round((v(i) - F.lit(low[i])) / F.lit(width[i]) * levels).cast("int")))
    return df.withColumn("nib", F.array(*(one(i) for i in range(dims))))


# --- masked volumes: array<int> of 2,048 bytes, position x * 256 + y * 32 + z


def in_mask(position: Column, mask: tuple[int, int, int]) -> Column:
    x, y, z = mask
    bit = lambda m, at: F.call_function("shiftrightunsigned", F.lit(m).cast("long"), at.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return bit(x, F.floor(position / 256)) & bit(y, F.floor(position / 32) % 8) & bit(z, position % 32)


def _inside(mask: tuple[int, int, int]) -> Column:
    """in_mask of the 2,048 positions as one constant, so that a position is looked up and not worked out in each row."""
    x, y, z = mask
    return F.array(*(F.lit(bool(x >> (i // 256) & y >> (i // 32 % 8) & z >> (i % 32) & 1)) for i in range(2048)))


def focus(a: Column | str, b: Column | str, mask: tuple[int, int, int], op: str) -> Column:
    """`xor`, `add` or `sub` (modulo 256) of b into a within the mask; `read` keeps a there and 0 elsewhere."""
    ops = {
        "xor": lambda p, q: p.bitwiseXOR(q),
        "add": lambda p, q: F.pmod(p + q, F.lit(256)),
        "sub": lambda p, q: F.pmod(p - q, F.lit(256)),
        "read": lambda p, q: p,
    }
    pairs = F.arrays_zip(col(a).alias("p"), col(b).alias("q"))
    inside = _inside(mask)
    outside = (lambda e: F.lit(0)) if op == "read" else (lambda e: e["p"])
    return F.transform(pairs, lambda e, i: F.when(F.get(inside, i), ops[op](e["p"], e["q"])).otherwise(outside(e)))


def focus_distance(a: Column | str, b: Column | str, mask: tuple[int, int, int]) -> Column:
    """struct<hamming, l1, size> within the mask."""
    inside = _inside(mask)
    pairs = F.transform(F.arrays_zip(col(a).alias("p"), col(b).alias("q")), lambda e, i: F.struct(e["p"].alias("p"), e["q"].alias("q"), F.get(inside, i).alias("m")))
    zero = F.struct(*(F.lit(0).cast("long").alias(n) for n in ("hamming", "l1", "size")))

    def step(s: Column, e: Column) -> Column:
        after = F.struct((s["hamming"] + F.bit_count(e["p"].bitwiseXOR(e["q"]))).alias("hamming"), (s["l1"] + F.abs(e["p"] - e["q"])).alias("l1"), (s["size"] + 1).alias("size"))
        return F.when(e["m"], after).otherwise(s)

    return F.aggregate(pairs, zero, step)


def mask_overlap(a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
    """Positions that two masks share: the product of the shared bits of each axis."""
    n = 1
    for p, q in zip(a, b, strict=True):
        n *= (p & q).bit_count()
    return n

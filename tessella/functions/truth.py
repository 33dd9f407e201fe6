"""Truth values (frequency f, confidence c), membership classes and path algebra as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def truth(f: Column, c: Column) -> Column:
    return F.struct(_clamp(f, 0.0, 1.0).alias("f"), _clamp(c, 0.0, 1.0).alias("c"))


def expectation(t: Column) -> Column:
    return t["c"] * (t["f"] - 0.5) + 0.5


def revise(a: Column, b: Column) -> Column:
    """Pools the evidence w = c / (1 - c) of both; (0.5, 0) where there is none."""
    wa, wb = a["c"] / (1.0 - a["c"] + 1e-9), b["c"] / (1.0 - b["c"] + 1e-9)
    w = wa + wb
    return F.when(w < 1e-9, truth(F.lit(0.5), F.lit(0.0))).otherwise(truth((wa * a["f"] + wb * b["f"]) / w, w / (w + 1.0)))


def _chain(f: Column, a: Column, b: Column) -> Column:
    c = a["f"] * b["f"] * a["c"] * b["c"]
    return truth(f, c / (c + 1e-3))


def deduction(a: Column, b: Column) -> Column:
    return _chain(a["f"] * b["f"], a, b)


def abduction(a: Column, b: Column) -> Column:
    return _chain(a["f"], a, b)


def induction(a: Column, b: Column) -> Column:
    return _chain(b["f"], a, b)


#: Fixed names of the eight classes by membership in the planes S, P and O.
HALOS = {(1, 1, 1): "core", (1, 1, 0): "sp", (1, 0, 1): "so", (0, 1, 1): "po", (1, 0, 0): "free_s", (0, 1, 0): "free_p", (0, 0, 1): "free_o", (0, 0, 0): "noise"}


def halo(s: Column, p: Column, o: Column) -> Column:
    """The class of an entry from three booleans."""
    out = F.lit("noise")
    for (x, y, z), name in HALOS.items():
        if name != "noise":
            out = F.when((s == bool(x)) & (p == bool(y)) & (o == bool(z)), name).otherwise(out)
    return out


def halo_by_distance(ds: Column, dp: Column, do: Column, limit: float = 0.3) -> Column:
    """core if all are under the limit; else the farthest axis is left out of the name."""
    far = F.greatest(ds, dp, do)
    return F.when(far < limit, "core").when(do == far, "sp").when(dp == far, "so").otherwise("po")


# --- 16-bit paths in a binary tree: bits (int, the first step is the highest bit) and depth


def path_range(bits: Column, depth: Column) -> tuple[Column, Column]:
    """Lowest and highest full path below the prefix."""
    free = F.call_function("shiftleft", F.lit(1), (16 - depth).cast("int")) - 1
    low = bits.bitwiseAND(F.bitwise_not(free)).bitwiseAND(F.lit(0xFFFF))
    return low, low.bitwiseOR(free)


def truncate(bits: Column, depth: Column) -> Column:
    return path_range(bits, depth)[0]


def flip_at(bits: Column, level: Column) -> Column:
    """The path that parts from this one at the level (0 is the first step)."""
    return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1), (15 - level).cast("int")))


def sibling(bits: Column, depth: Column) -> Column:
    return F.when(depth > 0, flip_at(bits, depth - 1)).otherwise(bits)


def common_depth(a: Column, da: Column, b: Column, db: Column) -> Column:
    """Steps that both paths share."""
    d = a.bitwiseXOR(b)
    shared = F.when(d == 0, 16).otherwise(15 - F.floor(F.log2(d + F.lit(1e-9))).cast("int"))
    return F.least(da, db, shared)


def lineage_distance(a: Column, da: Column, b: Column, db: Column) -> Column:
    return da + db - 2 * common_depth(a, da, b, db)


def parse_address(address: Column) -> Column:
    """struct<bits, depth> of `ada:clam:a:b:c:d`, one hex nibble a segment, at most four; else null."""
    parts = F.filter(F.slice(F.split(address, ":"), 3, 99), lambda s: s != "*")
    good = address.rlike(r"^ada:clam(:[0-9a-fA-F]){1,4}(:\*)?$")
    digits = F.rpad(F.array_join(parts, ""), 4, "0")
    return F.when(good, F.struct(F.conv(digits, 16, 10).cast("int").alias("bits"), (F.size(parts) * 4).alias("depth")))


def to_address(bits: Column, depth: Column) -> Column:
    digits = F.substring(F.lower(F.lpad(F.hex(bits.cast("long")), 4, "0")), F.lit(1), F.ceil(depth / 4).cast("int"))
    return F.concat(F.lit("ada:clam:"), F.array_join(F.split(F.regexp_replace(digits, "(.)(?=.)", "$1:"), ":"), ":"))

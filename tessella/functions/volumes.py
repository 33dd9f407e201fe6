"""Volumes of 8 x 8 x 32 bytes, position x * 256 + y * 32 + z, as array<int>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import col, elementwise, let

SIZE = 2048


def delta_xor(a: Column | str, b: Column | str) -> Column:
    """The relation of two fields; of a field with itself all zeros."""
    return elementwise(a, b, lambda x, y: x.bitwiseXOR(y))


def recover_xor(stored: Column | str, a: Column | str, b: Column | str) -> Column:
    """The content of a stored relation a ^ b ^ content."""
    return elementwise(stored, delta_xor(a, b), lambda x, y: x.bitwiseXOR(y))


def delta_sub(a: Column | str, b: Column | str) -> Column:
    """Differences of signed bytes, wrapped to -128..127."""
    return elementwise(a, b, lambda x, y: F.pmod(x - y + 128, F.lit(256)) - 128)


def histogram16(x: Column | str) -> Column:
    """Counts of values 0..255 in 16 bins of 16."""
    bins = F.transform(col(x), lambda v: F.floor(v / 16).cast("int"))
    return let(bins, lambda held: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.size(F.filter(held, lambda b: b == k))))


# --- transforms: where each position goes, a list of SIZE numbers


def rotation() -> list[int]:
    """x takes y's place, y the low part of z, and z what is left."""
    return [(i // 32 % 8) * 256 + (i % 8) * 32 + (i // 256) * 4 + (i % 32) // 8 for i in range(SIZE)]


def compose(second: list[int], first: list[int]) -> list[int]:
    """`first`, then `second`."""
    return [second[to] for to in first]


def inverse(places: list[int]) -> list[int]:
    out = [0] * len(places)
    for i, to in enumerate(places):
        out[to] = i
    return out


def bind(x: Column | str, places: list[int]) -> Column:
    """Each value moved to its place; x is computed once, not for each place."""
    back = F.array(*map(F.lit, inverse(places)))
    return let(col(x), lambda held: F.transform(back, lambda i: F.get(held, i)))


def unbind(x: Column | str, places: list[int]) -> Column:
    return bind(x, inverse(places))

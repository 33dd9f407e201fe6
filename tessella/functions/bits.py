"""Expressions over binary fingerprints: arrays of 64-bit words (array<bigint>, unsigned content).

Where the number of words is given, expressions are written out word by word and stay inside
whole-stage code generation; otherwise they fold over the array.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import col, elementwise


#: Up to so many words an expression names each of them; more are folded, so that plans stay short.
NAMED_WORDS = 32


def literal(words: list[int]) -> Column:
    if len(words) > NAMED_WORDS:
        return F.lit(np.array([w - (1 << 64) if w >> 63 else w for w in words], np.int64))
    return F.array(*(F.lit(w - (1 << 64) if w >> 63 else w).cast("long") for w in words))


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0).cast("long"))


def _each(words: int, fn) -> Column:
    return _sum([F.bit_count(fn(i)).cast("long") for i in range(words)])


def popcount(x: Column | str, words: int | None = None) -> Column:
    x = col(x)
    if words:
        return _each(words, lambda i: x[i])
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w))


def xor_bind(a: Column | str, b: Column | str) -> Column:
    return elementwise(a, b, lambda x, y: x.bitwiseXOR(y))


def both(a: Column | str, b: Column | str) -> Column:
    return elementwise(a, b, lambda x, y: x.bitwiseAND(y))


def either(a: Column | str, b: Column | str) -> Column:
    return elementwise(a, b, lambda x, y: x.bitwiseOR(y))


def invert(x: Column | str) -> Column:
    return F.transform(col(x), F.bitwise_not)


def hamming(a: Column | str, b: Column | str, words: int | None = None) -> Column:
    """Differing bits, of the first `words` words if given; lengths must be equal without."""
    a, b = col(a), col(b)
    if words and words > NAMED_WORDS:
        return popcount(xor_bind(F.slice(a, 1, words), F.slice(b, 1, words)))
    if words:
        return _each(words, lambda i: a[i].bitwiseXOR(b[i]))
    return popcount(xor_bind(a, b))


def similarity(a: Column | str, b: Column | str, bits: int, words: int | None = None) -> Column:
    """1 - distance / bits; 1 for no bits at all."""
    return F.lit(1.0) if bits == 0 else 1.0 - hamming(a, b, words) / F.lit(float(bits))


def sign_lanes(x: Column | str, lanes: int, width: int, first: int = 0) -> Column:
    """Bit i of lane w is 1 where x[first + width*w + i] >= 0."""
    x = col(x)
    lane = lambda w: _sum([F.when(x[first + width * w + i] >= 0, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(width)])
    return F.array(*(lane(w) for w in range(lanes)))


def permute(x: Column | str, k: int, lanes: int, width: int = 64) -> Column:
    """Circular rotation by k bits of the whole fingerprint: bit p goes to (p + k) mod n.

    For lanes narrower than 64 bits the unused high bits stay 0.
    """
    x, n = col(x), lanes * width
    k %= n
    jump, part = divmod(k, width)
    mask = F.lit((1 << width) - 1 if width < 64 else -1).cast("long")

    def lane(w: int) -> Column:
        here, before = x[(w - jump) % lanes], x[(w - jump - 1) % lanes]
        if not part:
            return here
        return F.shiftleft(here, part).bitwiseAND(mask).bitwiseOR(F.shiftrightunsigned(before, width - part))

    return F.array(*(lane(w) for w in range(lanes)))


def bit_at(x: Column | str, pos: Column, width: int) -> Column:
    word = F.get(col(x), F.floor(pos / width).cast("int"))
    return F.call_function("shiftrightunsigned", word, (pos % width).cast("int")).bitwiseAND(F.lit(1).cast("long"))


def or_mask_bound(query: Column | str, mask: Column | str, words: int) -> Column:
    """popcount(q & ~mask): no member under the mask can be nearer."""
    q, m = col(query), col(mask)
    return _each(words, lambda i: q[i].bitwiseAND(F.bitwise_not(m[i])))


# --- energy, gates and tiers


def energy(a: Column | str, b: Column | str, words: int) -> Column:
    """struct<conflict, energy_a, energy_b, agreement>: bits that differ, are set, are set in both."""
    a, b = col(a), col(b)
    return F.struct(
        hamming(a, b, words).alias("conflict"),
        popcount(a, words).alias("energy_a"),
        popcount(b, words).alias("energy_b"),
        _each(words, lambda i: a[i].bitwiseAND(b[i])).alias("agreement"),
    )


def agreement_ratio(e: Column) -> Column:
    return F.coalesce(F.try_divide(e["agreement"], F.least(e["energy_a"], e["energy_b"])), F.lit(0.0))


def conflict_density(e: Column, bits: int) -> Column:
    return e["conflict"] / F.lit(float(bits))


@dataclass(frozen=True)
class SliceGate:
    """Integer thresholds of the kernel stages and score bands.

    Fixed values: hot .10, mid .30, cold .49, anti .90, safety margin 1.5; probes of 64 and 512 bits.
    """

    bits: int
    hot: int
    mid: int
    cold: int
    anti: int
    k0: int
    k1: int


def slice_gate(bits: int, hot: float = 0.10, mid: float = 0.30, cold: float = 0.49, anti: float = 0.90, margin: float = 1.5, probe0: int = 64, probe1: int = 512) -> SliceGate:
    probe = lambda n: math.ceil(n * cold * margin)
    return SliceGate(bits, int(bits * hot), int(bits * mid), int(bits * cold), math.ceil(bits * anti), probe(probe0), probe(probe1))


def hdr_score(conflict: Column, gate: SliceGate) -> Column:
    """3 under hot, 2 more under mid, 1 more under cold; strict comparisons, 0 to 6."""
    one = lambda limit, points: F.when(conflict < limit, points).otherwise(0)
    return one(gate.hot, 3) + one(gate.mid, 2) + one(gate.cold, 1)


def sigma_score(conflict: Column, bits: int) -> Column:
    """struct<z, tier>: z = (mean - distance) / deviation of random fingerprints; tiers at 3, 2.5, 2
    and 1.5 deviations, named from the rarest down."""
    mu, sigma = bits / 2.0, math.sqrt(bits / 4.0)
    z = (F.lit(mu) - conflict) / F.lit(sigma)
    tier = F.when(conflict < mu - 3 * sigma, "discovery").when(conflict < mu - 2.5 * sigma, "strong").when(conflict < mu - 2 * sigma, "evidence").when(conflict < mu - 1.5 * sigma, "hint").otherwise("noise")
    return F.struct(z.alias("z"), tier.alias("tier"))


# --- 16-bit float lanes (array<int>, 0..65535)


@dataclass(frozen=True)
class LaneWeights:
    sign: int = 256
    exponent: int = 16
    mantissa: int = 1


def lane_distance(a: Column | str, b: Column | str, weights: LaneWeights = LaneWeights()) -> Column:
    """Weighted differing bits of bf16 lanes: sign, 8 exponent bits, 7 mantissa bits."""

    def one(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        return (
            F.shiftright(d, 15).bitwiseAND(F.lit(1)) * weights.sign
            + F.bit_count(F.shiftright(d, 7).bitwiseAND(F.lit(255))) * weights.exponent
            + F.bit_count(d.bitwiseAND(F.lit(127))) * weights.mantissa
        ).cast("long")

    return F.aggregate(elementwise(a, b, one), F.lit(0).cast("long"), lambda s, v: s + v)


def structural_diff(a: Column | str, b: Column | str) -> Column:
    """struct<sign_flips, exponent_bits, mantissa_bits, flipped_dims, wide_dims>: wide where 2 or more exponent bits differ."""
    d = elementwise(a, b, lambda x, y: x.bitwiseXOR(y))
    zero = F.lit(0).cast("long")
    exponent = lambda v: F.bit_count(F.shiftright(v, 7).bitwiseAND(F.lit(255))).cast("long")
    sign = lambda v: F.shiftright(v, 15).bitwiseAND(F.lit(1)).cast("long")
    numbered = F.transform(d, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    return F.struct(
        F.aggregate(d, zero, lambda s, v: s + sign(v)).alias("sign_flips"),
        F.aggregate(d, zero, lambda s, v: s + exponent(v)).alias("exponent_bits"),
        F.aggregate(d, zero, lambda s, v: s + F.bit_count(v.bitwiseAND(F.lit(127))).cast("long")).alias("mantissa_bits"),
        F.transform(F.filter(numbered, lambda e: sign(e["v"]) == 1), lambda e: e["i"]).alias("flipped_dims"),
        F.transform(F.filter(numbered, lambda e: exponent(e["v"]) >= 2), lambda e: e["i"]).alias("wide_dims"),
    )


# --- signed bytes (array<int>)


def l1_distance(a: Column | str, b: Column | str) -> Column:
    """Sum of absolute differences; the 1-Wasserstein distance where both are sorted."""
    return F.aggregate(elementwise(a, b, lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)


def circular_distance(a: Column | str, b: Column | str) -> Column:
    """Sum of differences on a circle of 256."""
    one = lambda x, y: F.least(F.abs(x - y), 256 - F.abs(x - y)).cast("long")
    return F.aggregate(elementwise(a, b, one), F.lit(0).cast("long"), lambda s, v: s + v)


def symbol_distance(a: Column | str, b: Column | str) -> Column:
    """Positions that differ."""
    return F.size(F.filter(elementwise(a, b, lambda x, y: x != y), lambda v: v)).cast("long")


def dot_i8(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(elementwise(a, b, lambda x, y: x.cast("long") * y), F.lit(0).cast("long"), lambda s, v: s + v)


def cosine_i8(a: Column | str, b: Column | str) -> Column:
    """0 where a norm is 0."""
    return F.coalesce(F.try_divide(dot_i8(a, b).cast("double"), F.sqrt(dot_i8(a, a).cast("double")) * F.sqrt(dot_i8(b, b).cast("double"))), F.lit(0.0))


def phase_bind(a: Column | str, b: Column | str) -> Column:
    return elementwise(a, b, lambda x, y: F.pmod(x + y, F.lit(256)))


def phase_unbind(a: Column | str, b: Column | str) -> Column:
    return elementwise(a, b, lambda x, y: F.pmod(x - y, F.lit(256)))


def symbol_bind(a: Column | str, b: Column | str, base: str, levels: int = 256) -> Column:
    """By base: `binary` XOR, `unsigned` sum modulo levels, `signed` sum clamped to +-(levels - 1) / 2."""
    limit = (levels - 1) // 2
    ops = {
        "binary": lambda x, y: x.bitwiseXOR(y),
        "unsigned": lambda x, y: F.pmod(x + y, F.lit(levels)),
        "signed": lambda x, y: F.least(F.lit(limit), F.greatest(F.lit(-limit), x + y)),
    }
    return elementwise(a, b, ops[base])


def to_signs(x: Column | str, bits: int, width: int = 64) -> Column:
    """Bits as +1 and -1."""
    pos = F.sequence(F.lit(0), F.lit(bits - 1))
    return F.transform(pos, lambda p: F.when(bit_at(x, p, width) == 1, 1).otherwise(-1))


def from_signs(x: Column | str, lanes: int, width: int) -> Column:
    """Positive values as set bits, least significant first; missing values are 0."""
    x = col(x)
    one = lambda p: F.when(F.coalesce(F.get(x, F.lit(p)), F.lit(0)) > 0, F.lit(1 << (p % width) if p % width < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.array(*(reduce(lambda a, b: a.bitwiseOR(b), [one(w * width + i) for i in range(width)]) for w in range(lanes)))


def partial_hamming(a: list[Column], b: list[Column], words: int, n_bits: int) -> Column:
    """Differing bits in the first n_bits (whole words, one at least) of each channel."""
    n = max(1, min(words, -(-n_bits // 64)))
    return _sum([hamming(x, y, n) for x, y in zip(a, b, strict=True)])


def partial_similarity(a: list[Column], b: list[Column], words: int, n_bits: int) -> Column:
    n = max(1, min(words, -(-n_bits // 64)))
    return 1.0 - partial_hamming(a, b, words, n_bits) / F.lit(float(64 * n * len(a)))


def pack_states(states: Column | str) -> Column:
    """States 0 to 3, four in a byte, the first in the highest bits."""
    x = col(states)
    at = lambda i: F.coalesce(F.get(x, i), F.lit(0))
    byte = lambda k: at(4 * k) * 64 + at(4 * k + 1) * 16 + at(4 * k + 2) * 4 + at(4 * k + 3)
    count = F.ceil(F.size(x) / 4).cast("int")
    return F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), byte))


def unpack_states(packed: Column | str, n: int) -> Column:
    x = col(packed)
    byte = lambda i: F.get(x, F.floor(i / 4).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.call_function("shiftright", byte(i), (6 - i % 4 * 2).cast("int")).bitwiseAND(F.lit(3)))


def pack_five(states: Column | str) -> Column:
    """States 0 to 4, three in a byte: 25 a + 5 b + c, missing ones 2 (the silent state)."""
    x = col(states)
    at = lambda i: F.coalesce(F.get(x, i), F.lit(2))
    byte = lambda k: at(3 * k) * 25 + at(3 * k + 1) * 5 + at(3 * k + 2)
    count = F.ceil(F.size(x) / 3).cast("int")
    return F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), byte))


def unpack_five(packed: Column | str, n: int) -> Column:
    x = col(packed)
    byte = lambda i: F.get(x, F.floor(i / 3).cast("int"))
    one = lambda i: F.when(i % 3 == 0, F.floor(byte(i) / 25)).when(i % 3 == 1, F.floor(byte(i) / 5) % 5).otherwise(byte(i) % 5).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)


def signal_quality(x: Column | str, words: int) -> Column:
    """Variance of the words' set bits: low for noise."""
    counts = [F.bit_count(col(x)[i]).cast("double") for i in range(words)]
    mean = reduce(lambda a, b: a + b, counts) / float(words)
    return reduce(lambda a, b: a + b, [c * c for c in counts]) / float(words) - mean * mean


def refine_cold(a: Column | str, b: Column | str) -> Column:
    """Score band of an uncertain match from its lanes: 2 where under 4 signs and under 4 exponent bits
    differ, else 1."""
    d = structural_diff(a, b)
    return F.when((d["sign_flips"] < 4) & (d["exponent_bits"] < 4), 2).otherwise(1)

"""Awareness of superposed vectors, plastic states, masks, layers, binary neurons, binding cubes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.vectors import let
from .search import kernel_pipeline

#: Fixed thresholds: sign consensus of 192 in 255, over 2 exponent bits, over 1 mantissa bit.
CONSENSUS, EXPONENT, MANTISSA = 192, 2, 1


def superposition(vectors: list[Column]) -> Column:
    """array<string>: for each dimension of 2 or 3 vectors of 16-bit float lanes, `tensioned` where
    signs disagree, `uncertain` where exponents spread, `noise` where only mantissas do, else
    `crystallized`."""
    if not 2 <= len(vectors) <= 3:
        raise ValueError("2 or 3 vectors")
    pairs = [(i, j) for i in range(len(vectors)) for j in range(i + 1, len(vectors))]
    names = [f"v{i}" for i in range(len(vectors))]
    rows = F.arrays_zip(*(v.alias(n) for v, n in zip(vectors, names, strict=True)))

    def one(e: Column) -> Column:
        lanes = [e[n] for n in names]
        return let(F.array(*(lanes[i].bitwiseXOR(lanes[j]) for i, j in pairs)), state)

    def state(x: Column) -> Column:
        agree = F.size(F.filter(x, lambda v: v.bitwiseAND(F.lit(0x8000)) == 0))
        consensus = F.floor(agree * 255 / len(pairs))
        spread = F.array_max(F.transform(x, lambda v: F.bit_count(F.shiftright(v, 7).bitwiseAND(F.lit(0xFF)))))
        noisy = F.exists(x, lambda v: F.bit_count(v.bitwiseAND(F.lit(0x7F))) > MANTISSA)
        return (
            F.when(consensus < CONSENSUS, "tensioned")
            .when(spread > EXPONENT, "uncertain")
            .when(noisy & (spread == 0) & (consensus == 255), "noise")
            .otherwise("crystallized")
        )

    return F.transform(rows, one)


def fractions(states: Column) -> Column:
    share = lambda name: (F.size(F.filter(states, lambda s: s == name)) / F.size(states)).alias(name)
    return F.struct(*map(share, ("crystallized", "tensioned", "uncertain", "noise")))


# --- plastic states: struct<efficacy, theta, maturity>


def deposit(state: Column, evidence: Column) -> Column:
    """The state after one piece of evidence (-128..127): strengthened above the sliding threshold,
    weakened between half of it and it, learned freely below; damped by maturity (up to 15)."""
    e, theta, m = state["efficacy"], state["theta"], state["maturity"]
    magnitude = F.abs(e)
    weaken = -F.signum(e.cast("double")).cast("int") * F.greatest(F.lit(1), F.floor(F.abs(evidence) / 2).cast("int"))
    phi = F.when((magnitude > F.floor(theta / 2)) & (magnitude <= theta), weaken).otherwise(evidence)
    towards_zero = lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("int")
    delta = towards_zero(phi * (16 - m) / 16)
    clamp = lambda x, low, high: F.least(F.lit(high), F.greatest(F.lit(low), x))
    after = F.struct(
        clamp(e + delta, -128, 127).alias("efficacy"),
        clamp(theta + clamp(magnitude - theta, -2, 2), 0, 255).alias("theta"),
        F.when((delta != 0) & (m < 15), m + 1).otherwise(m).alias("maturity"),
    )
    return F.when(evidence == 0, state).otherwise(after)


def soak(evidence: Column, theta: int = 0) -> Column:
    """The state after a row's ordered evidence (array<int>)."""
    start = F.struct(F.lit(0).alias("efficacy"), F.lit(theta).alias("theta"), F.lit(0).alias("maturity"))
    return F.aggregate(evidence, start, deposit)


def five_state(state: Column) -> Column:
    """-2, -1, 0, 1, 2: silent at or below half the threshold; strong above it and at maturity 8."""
    magnitude = F.abs(state["efficacy"])
    strong = (magnitude > state["theta"]) & (state["maturity"] >= 8)
    return F.when(magnitude <= F.floor(state["theta"] / 2), 0).otherwise(F.signum(state["efficacy"].cast("double")).cast("int") * F.when(strong, 2).otherwise(1))


def attention(mask: Column | str, concept: Column | str, dims: int, limit: float = 0.3) -> Column:
    """struct<projection, kind>: dot / dims, and resonance, conflict or novel by the limit."""
    p = bits.dot_i8(concept, mask) / F.lit(float(dims))
    return F.struct(p.alias("projection"), F.when(p > limit, "resonance").when(p < -limit, "conflict").otherwise("novel").alias("kind"))


# --- layers of XOR deltas: array<array<bigint>>, one for each writer


def max_conflict(deltas: Column, lanes: int) -> Column:
    """Most bits that two writers both change; 0 for fewer than two. Writers are few: one row's array."""
    overlap = lambda a, b: sum((F.bit_count(a[i].bitwiseAND(b[i])).cast("long") for i in range(lanes)), F.lit(0).cast("long"))
    later = lambda i: F.slice(deltas, i + 2, F.greatest(F.size(deltas) - i - 1, F.lit(0)))
    return F.coalesce(F.array_max(F.flatten(F.transform(deltas, lambda a, i: F.transform(later(i), lambda b: overlap(a, b))))), F.lit(0).cast("long"))


def layer_gate(deltas: Column, lanes: int, limit: int) -> Column:
    """block over the limit, hold where nothing changes, else flow."""
    changed = F.aggregate(deltas, F.lit(0).cast("long"), lambda s, d: s + sum((F.bit_count(d[i]).cast("long") for i in range(lanes)), F.lit(0).cast("long")))
    return F.when(max_conflict(deltas, lanes) > limit, "block").when(changed == 0, "hold").otherwise("flow")


# --- binary neurons


def bnn_score(a: Column | str, b: Column | str, bits_: int, words: int) -> Column:
    """2 match / bits - 1."""
    return 2.0 * (bits_ - bits.hamming(a, b, words)) / F.lit(float(bits_)) - 1.0


def bnn_winner(inputs: DataFrame, weights: list[list[int]], bits_: int, words: int, fp: str = "fp") -> DataFrame:
    """inputs plus winner (index of the largest score, the first among equals) and score."""
    scored = F.array(*(F.struct((-bnn_score(fp, bits.literal(w), bits_, words)).alias("minus"), F.lit(i).alias("i")) for i, w in enumerate(weights)))
    return inputs.withColumn("best", F.array_min(scored)).withColumn("winner", F.col("best.i")).withColumn("score", -F.col("best.minus")).drop("best")


def bnn_conv1d(inputs: DataFrame, kernel: list[int], stride: int, bits_: int, position: str, fp: str = "fp") -> DataFrame:
    """Scores at every stride-th position."""
    return inputs.where(F.col(position) % stride == 0).withColumn("score", bnn_score(fp, bits.literal(kernel), bits_, len(kernel)))


# --- binding cube


def _rotations(words: list[int], width: int, resolution: int) -> list[list[int]]:
    n = len(words) * width
    whole = sum(w << (width * i) for i, w in enumerate(words))
    step, full, lane = (n // resolution if resolution > 1 else 0), (1 << n) - 1, (1 << width) - 1
    turned = [((whole << k) | (whole >> (n - k))) & full if k else whole for k in (i * step % n for i in range(resolution))]
    return [[t >> (width * i) & lane for i in range(len(words))] for t in turned]


def binding_cube(spark: SparkSession, x: list[int], y: list[int], z: list[int], resolution: int, width: int = 64) -> DataFrame:
    """(i, j, k, popcount) of x, y and z rotated by i, j and k steps and bound: resolution^3 rows,
    computed from the row number; the rotations of the three vectors are literals."""
    tables = [F.array(*(bits.literal(w) for w in _rotations(v, width, resolution))) for v in (x, y, z)]
    cells = spark.range(resolution**3)
    index = [F.floor(F.col("id") / resolution**2), F.floor(F.col("id") / resolution) % resolution, F.col("id") % resolution]
    cells = cells.select(*(c.cast("int").alias(n) for c, n in zip(index, "ijk", strict=True)))
    picked = [F.get(t, F.col(n)) for t, n in zip(tables, "ijk", strict=True)]
    count = sum((F.bit_count(picked[0][w].bitwiseXOR(picked[1][w]).bitwiseXOR(picked[2][w])).cast("long") for w in range(len(x))), F.lit(0).cast("long"))
    return cells.select("i", "j", "k", count.alias("popcount"))


def spots(cube: DataFrame, bits_: int, near: bool = True) -> DataFrame:
    """Cells within one deviation of half the bits, nearest first; or beyond two, farthest first."""
    z = F.abs(F.col("popcount") - bits_ / 2) / F.lit((bits_ / 4) ** 0.5)
    rows = cube.withColumn("z", z)
    return rows.where("z < 1").orderBy("z", "i", "j", "k") if near else rows.where("z > 2").orderBy(F.desc("z"), "i", "j", "k")


# --- layers over a ground truth, and cascades of binary neurons


def read_through(ground: Column | str, deltas: Column | str, layer: Column | int | None = None) -> Column:
    """The ground XOR its layers from the first to `layer` (all of them if None)."""
    ground, deltas = (F.col(x) if isinstance(x, str) else x for x in (ground, deltas))
    used = deltas if layer is None else F.slice(deltas, 1, layer + 1)
    return F.aggregate(used, ground, lambda a, d: F.zip_with(a, d, lambda x, y: x.bitwiseXOR(y)))


def collapse_layer(ground: Column | str, deltas: Column | str, layer: int) -> Column:
    """struct<ground, deltas>: one layer XORed into the ground and taken out of the stack."""
    ground, deltas = (F.col(x) if isinstance(x, str) else x for x in (ground, deltas))
    rest = F.filter(deltas, lambda _, i: i != layer)
    merged = F.zip_with(ground, F.get(deltas, layer), lambda x, y: x.bitwiseXOR(y))
    return F.struct(merged.alias("ground"), rest.alias("deltas"))


def changed_bits(ground: Column | str, deltas: Column | str, lanes: int) -> Column:
    """Bits in which the ground and what is read through all layers differ."""
    return bits.hamming(ground, read_through(ground, deltas), lanes)


def bnn_cascade_search(weights: DataFrame, query: list[int], k: int, gate: bits.SliceGate, n_bits: int, fp: str = "fp", id_col: str = "vec_id", probe0: int = 1, probe1: int = 8) -> DataFrame:
    """The kernel pipeline over a table of weights, then the k best scores, with matches and score."""
    kept = kernel_pipeline(weights, query, gate, fp, probe0, probe1)
    kept = kept.withColumn("matches", F.lit(n_bits) - F.col("energy.conflict"))
    return kept.withColumn("score", 2.0 * F.col("matches") / F.lit(float(n_bits)) - 1.0).orderBy(F.desc("score"), id_col).limit(k)


def bnn_conv1d_channels(inputs: DataFrame, kernels: dict[str, list[int]], stride: int, n_bits: int, position: str) -> DataFrame:
    """Scores over several channels as one vector of bits, at every stride-th position."""
    d = sum((bits.hamming(c, bits.literal(k), len(k)) for c, k in kernels.items()), F.lit(0).cast("long"))
    return inputs.where(F.col(position) % stride == 0).withColumn("score", 2.0 * (n_bits - d) / F.lit(float(n_bits)) - 1.0)

"""Versioned XOR overlays over a table of fingerprints.

base: (id, fp); deltas: (id, writer, version, delta), arrays of as many words. A version is a number
that grows; a snapshot is the latest, and rewinding forgets what came after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits


def snapshot(deltas: DataFrame) -> int:
    """The latest version, -1 without one."""
    found = deltas.agg(F.max("version")).first()[0]
    return -1 if found is None else found


def rewind(deltas: DataFrame, version: int) -> DataFrame:
    return deltas.where(F.col("version") <= version)


def _merged(deltas: DataFrame, by: list[str], lanes: int) -> DataFrame:
    """(by, delta): all deltas of a group in one, word by word, combined before the shuffle."""
    words = [F.bit_xor(F.col("delta")[i]).alias(f"w{i}") for i in range(lanes)]
    return deltas.groupBy(*by).agg(*words).select(*by, F.array(*(F.col(f"w{i}") for i in range(lanes))).alias("delta"))


def read_full(base: DataFrame, deltas: DataFrame, lanes: int) -> DataFrame:
    """base with all deltas applied; rows without one stay as they are."""
    merged = _merged(deltas, ["id"], lanes)
    fp = F.when(F.col("delta").isNull(), F.col("fp")).otherwise(bits.xor_bind("fp", "delta"))
    return base.join(merged, "id", "left").select("id", fp.alias("fp"))


def flush(base: DataFrame, deltas: DataFrame, lanes: int) -> tuple[DataFrame, DataFrame]:
    """The base with all deltas applied, and no deltas."""
    return read_full(base, deltas, lanes), deltas.limit(0)


def _twice(deltas: Column, lanes: int) -> Column:
    """Bits that two of a row's writers change: one pass over the writers, who are few."""
    zero = F.array_repeat(F.lit(0).cast("long"), lanes)
    both = lambda a, d, op: F.zip_with(a, d, op)
    step = lambda a, d: F.struct(both(a["seen"], d, lambda x, y: x.bitwiseOR(y)).alias("seen"), both(a["twice"], both(a["seen"], d, lambda x, y: x.bitwiseAND(y)), lambda x, y: x.bitwiseOR(y)).alias("twice"))
    return F.aggregate(deltas, F.struct(zero.alias("seen"), zero.alias("twice")), step)


def conflict_map(deltas: DataFrame, lanes: int, limit: int) -> DataFrame:
    """(id, conflict, bits, gate): the bits that two writers both change, how many they are, and whether
    the id blocks (over the limit), holds (nothing changes) or flows."""
    own = _merged(deltas, ["id", "writer"], lanes)
    rows = own.groupBy("id").agg(F.collect_list("delta").alias("deltas")).select("id", _twice(F.col("deltas"), lanes).alias("t"))
    rows = rows.select("id", F.col("t.twice").alias("conflict"), bits.popcount(F.col("t.twice"), lanes).alias("bits"), bits.popcount(F.col("t.seen"), lanes).alias("changed"))
    gate = F.when(F.col("bits") > limit, "block").when(F.col("changed") == 0, "hold").otherwise("flow")
    return rows.select("id", "conflict", "bits", gate.alias("gate"))


def commit(base: DataFrame, deltas: DataFrame, lanes: int, limit: int) -> DataFrame:
    """base with the deltas of the ids that flow."""
    flows = conflict_map(deltas, lanes, limit).where("gate = 'flow'").select("id")
    return read_full(base, deltas.join(flows, "id", "left_semi"), lanes)

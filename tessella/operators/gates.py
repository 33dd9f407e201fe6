"""Gated coordinates: tables of packed vectors (resonance, magnitude) with a gate, searched by a literal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits

#: Fixed names, in the order of severity.
GATES = ("flow", "hold", "block")


def is_gated(gate: Column) -> Column:
    return gate != "flow"


def severity(gate: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, GATES)), gate) - 1


def gated(df: DataFrame, gate: str = "gate") -> DataFrame:
    """The rows that hold or block."""
    return df.where(is_gated(F.col(gate)))


def open_rows(df: DataFrame, gate: str = "gate") -> DataFrame:
    return df.where(~is_gated(F.col(gate)))


def gate_distribution(df: DataFrame, gate: str = "gate") -> DataFrame:
    """One row: flow, hold, block."""
    return df.agg(*(F.count_if(F.col(gate) == g).alias(g) for g in GATES))


def _literal(query: list[int]) -> Column:
    return F.array(*map(F.lit, query))


def locate(df: DataFrame, query: list[int], k: int, id_col: str = "vec_id") -> DataFrame:
    """The k rows of least L1 distance, with d, the smaller id among equals."""
    return df.withColumn("d", bits.l1_distance("resonance", _literal(query))).orderBy("d", id_col).limit(k)


def locate_within(df: DataFrame, query: list[int], radius: int) -> DataFrame:
    return df.withColumn("d", bits.l1_distance("resonance", _literal(query))).where(F.col("d") <= radius)


def locate_resonant(df: DataFrame, query: list[int], magnitude: float, k: int, id_col: str = "vec_id") -> DataFrame:
    """The k rows of largest dot product of the hydrated vectors, with dot."""
    dot = bits.dot_i8("resonance", _literal(query)).cast("double") * (F.col("magnitude") * F.lit(magnitude))
    return df.withColumn("dot", dot).orderBy(F.desc("dot"), id_col).limit(k)


def nearest_gated(df: DataFrame, query: list[int], limit: int, id_col: str = "vec_id") -> DataFrame:
    """The nearest gated row within the limit, or none."""
    return locate(gated(locate_within(df, query, limit)).drop("d"), query, 1, id_col)

"""Queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prints(spark: SparkSession, sf_dir: str, lanes: int = 2, width: int = 32) -> DataFrame:
    """(vec_id, label, fp): signs of the first lanes * width dimensions."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", bits.sign_lanes("embedding", lanes, width).alias("fp"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, meta, cam, btree, embed): four blocks of 16 dimensions, a lane each."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", *(bits.sign_lanes("embedding", 1, 16, 16 * i).alias(c) for i, c in enumerate(("meta", "cam", "btree", "embed"))))


def first_row(df: DataFrame, column: str, vec_id: int = 0) -> list:
    """The query: one row's value."""
    return list(df.where(F.col("vec_id") == vec_id).select(column).first()[0])


def signed8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, v array<int>): dimensions times 127, rounded half away from zero."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: F.round(x.cast("double") * 127).cast("int")).alias("v"))


# --- the same in SQL


def lane(w: int, width: int = 32, first: int = 0, e: str = "embedding") -> str:
    terms = [f"CASE WHEN {e}[{first + width * w + i + 1}] >= 0 THEN {1 << i}::BIGINT ELSE 0 END" for i in range(width)]
    return "CAST(" + " + ".join(terms) + " AS BIGINT)"


FP2 = f"fp2 AS (SELECT vec_id, label, {lane(0)} AS a, {lane(1)} AS b FROM embeddings)"
CH4 = "ch4 AS (SELECT vec_id, " + ", ".join(f"{lane(0, 16, 16 * i)} AS {c}" for i, c in enumerate(("meta", "cam", "btree", "embed"))) + " FROM embeddings)"
INT8 = "int8 AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 127) AS INTEGER)) AS v FROM embeddings)"


def ham(x: str, y: str) -> str:
    return f"CAST(bit_count(xor({x}.a, {y}.a)) + bit_count(xor({x}.b, {y}.b)) AS BIGINT)"

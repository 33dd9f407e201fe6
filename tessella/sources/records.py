"""Tables of four-channel records, nodes, edges and attention masks as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed widths: bytes of a record channel, of a plane, positions of a soaking vector.
CHANNEL_BYTES, PLANE_BYTES, SOAKING = 4096, 2048, 10_000
CHANNELS = ("meta", "cam", "btree", "embed")


def _fields(*items: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*x) for x in items])


RECORDS = _fields(*((c, T.BinaryType(), False) for c in CHANNELS))
_soak = T.ArrayType(T.ByteType())
NODES = _fields(
    ("addr", T.IntegerType(), False), ("label", T.StringType(), True),
    ("s_binary", T.BinaryType(), False), ("p_binary", T.BinaryType(), False), ("o_binary", T.BinaryType(), False),
    ("s_soaking", _soak, True), ("p_soaking", _soak, True), ("o_soaking", _soak, True),
    ("spo_binary", T.BinaryType(), True),
    ("s_sigma", T.ShortType(), False), ("p_sigma", T.ShortType(), False), ("o_sigma", T.ShortType(), False),
    ("nars_f", T.FloatType(), False), ("nars_c", T.FloatType(), False), ("evidence_count", T.LongType(), False),
    ("s_gate", T.ShortType(), False), ("p_gate", T.ShortType(), False), ("o_gate", T.ShortType(), False),
    ("role_provenance", T.ShortType(), False), ("qidx", T.ShortType(), False), ("parent", T.IntegerType(), True),
    ("depth", T.ShortType(), False), ("rung", T.ShortType(), False), ("is_spine", T.BooleanType(), False),
    ("dn_path", T.LongType(), True), ("payload", T.BinaryType(), True), ("updated_at", T.LongType(), False),
)
EDGES = _fields(
    ("from_addr", T.IntegerType(), False), ("to_addr", T.IntegerType(), False), ("verb_addr", T.IntegerType(), False),
    ("edge_s", T.BinaryType(), False), ("edge_p", T.BinaryType(), False), ("edge_o", T.BinaryType(), False), ("fingerprint", T.BinaryType(), False),
    ("weight", T.FloatType(), False), ("nars_f", T.FloatType(), False), ("nars_c", T.FloatType(), False),
)
ATTENTION = _fields(("mask", _soak, False), ("concept_count", T.LongType(), False), ("min_sigma", T.ShortType(), False), ("rebuilt_at", T.LongType(), False), ("version", T.LongType(), False))


def checked(df: DataFrame, schema: T.StructType, widths: dict[str, int]) -> DataFrame:
    """df in the schema's columns; a value of another width, or a null where none may be, raises."""
    out = []
    for f in schema:
        x = F.col(f.name).cast(f.dataType)
        if f.name in widths:
            x = F.when(x.isNull() | (F.length(x) == widths[f.name]), x).otherwise(F.raise_error(F.lit(f"{f.name} is not {widths[f.name]} bytes wide")))
        if not f.nullable:
            x = F.coalesce(x, F.raise_error(F.lit(f"{f.name} is null")))
        out.append(x.alias(f.name))
    return df.select(*out)


def write_records(df: DataFrame, path: str, width: int = CHANNEL_BYTES) -> None:
    """Creates the dataset; an existing one is an error."""
    checked(df, RECORDS, dict.fromkeys(CHANNELS, width)).write.mode("errorifexists").parquet(path)


def append_records(df: DataFrame, path: str, width: int = CHANNEL_BYTES) -> None:
    checked(df, RECORDS, dict.fromkeys(CHANNELS, width)).write.mode("append").parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORDS).parquet(path)


def words(column: str, n: int):
    """The first n little-endian 64-bit words of a binary column, as array<bigint>."""
    return F.array(*(_word(column, i) for i in range(n)))


def _word(column: str, i: int):
    # conv() gives the unsigned value as text; halves keep it within bigint.
    byte = lambda k: F.substring(F.hex(column), 2 * (8 * i + k) + 1, 2)
    half = lambda lo: F.conv(F.concat(*(byte(k) for k in range(lo + 3, lo - 1, -1))), 16, 10).cast("long")
    return F.shiftleft(half(4), 32).bitwiseOR(half(0))


def write_csv(df: DataFrame, path: str) -> None:
    """A table of plain columns as CSV files with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def named_values(text: Column | str, names: list[str]) -> Column:
    """The values of a JSON object's numbers in the order of names; 0 where one is missing."""
    found = F.from_json(F.col(text) if isinstance(text, str) else text, "map<string,double>")
    return F.transform(F.array(*map(F.lit, names)), lambda n: F.coalesce(F.element_at(found, n), F.lit(0.0)))

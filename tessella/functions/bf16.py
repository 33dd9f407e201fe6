"""16-bit floats: the upper half of a 32-bit one, as whole Arrow arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType


def _lists(x: pa.Array, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """values in lists as long as those of x."""
    sizes = np.asarray(pc.list_value_length(x).fill_null(0), np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind), mask=x.is_null())


def _bits(x: pa.Array) -> np.ndarray:
    return x.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).astype("<f4").view("<u4")


@F.arrow_udf(ArrayType(IntegerType()))
def truncated(x: pa.Array) -> pa.Array:
    """array<float> to lanes 0..65535, rounded towards zero. A null array stays null."""
    return _lists(x, (_bits(x) >> 16).astype(np.int32), pa.int32())


@F.arrow_udf(ArrayType(IntegerType()))
def rounded(x: pa.Array) -> pa.Array:
    """array<float> to lanes, rounded to the nearest, ties to even."""
    v = _bits(x).astype(np.uint64)
    return _lists(x, ((v + 0x7FFF + ((v >> 16) & 1)) >> 16 & 0xFFFF).astype(np.int32), pa.int32())


@F.arrow_udf(ArrayType(DoubleType()))
def widened(x: pa.Array) -> pa.Array:
    """Lanes to the doubles that they stand for."""
    v = x.flatten().cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.uint32)
    return _lists(x, (v << 16).view("<f4").astype(float), pa.float64())


def dot(a: Column, b: Column) -> Column:
    """Dot product of two lane arrays, added up in doubles."""
    from .vectors import dot as plain

    return plain(widened(a), widened(b))

"""SQL names for the fingerprint functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, FloatType, LongType

#: Temporary SQL functions over array<bigint> words; null in, null out.
ON_WORDS = {
    "hamming": "(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS BIGINT RETURN aggregate(zip_with(a, b, (x, y) -> bit_count(x ^ y)), 0L, (s, v) -> s + v)",
    "popcount": "(a ARRAY<BIGINT>) RETURNS BIGINT RETURN aggregate(a, 0L, (s, v) -> s + bit_count(v))",
    "xor_bind": "(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS ARRAY<BIGINT> RETURN zip_with(slice(a, 1, least(size(a), size(b))), slice(b, 1, least(size(a), size(b))), (x, y) -> x ^ y)",
    "similarity": "(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS DOUBLE RETURN if(size(a) = 0, 1.0D, 1.0D - aggregate(zip_with(a, b, (x, y) -> bit_count(x ^ y)), 0L, (s, v) -> s + v) / (64.0D * size(a)))",
}


def _rows(x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all values, and where each begins and how long it is; a null is empty."""
    x = x.fill_null(b"").cast(pa.binary())
    sizes = pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x)].astype(np.int64)
    return np.frombuffer(x.buffers()[2] or b"", np.uint8), offsets, sizes


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    upto = np.cumsum(sizes)
    return flat[np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)]


def _null(*xs: pa.Array) -> pa.Array:
    return pa.array(np.logical_or.reduce([np.asarray(x.is_null()) for x in xs]))


def _xored(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """a ^ b over the length that both have: all bytes, and the sizes."""
    (fa, sa, na), (fb, sb, nb) = _rows(a), _rows(b)
    n = np.minimum(na, nb)
    return _gather(fa, sa, n) ^ _gather(fb, sb, n), n


def _counts(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Set bits of each run of bytes."""
    upto = np.concatenate([[0], np.cumsum(np.bitwise_count(flat), dtype=np.int64)])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def register_all(spark: SparkSession) -> list[str]:
    """Registers the words' functions and, over binary columns, bin_hamming, bin_popcount,
    bin_similarity and bin_xor_bind (whole Arrow batches: Spark's ^ takes no binary). Null in, null
    out; bin_hamming raises where lengths differ, the others use the length that both have."""

    @F.arrow_udf(BinaryType())
    def bin_xor_bind(a: pa.Array, b: pa.Array) -> pa.Array:
        flat, n = _xored(a, b)
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        made = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])
        return pc.if_else(_null(a, b), pa.scalar(None, pa.binary()), made)

    @F.arrow_udf(LongType())
    def bin_popcount(a: pa.Array) -> pa.Array:
        flat, starts, n = _rows(a)
        return pc.if_else(_null(a), pa.scalar(None, pa.int64()), pa.array(_counts(_gather(flat, starts, n), n)))

    @F.arrow_udf(LongType())
    def bin_hamming(a: pa.Array, b: pa.Array) -> pa.Array:
        if pc.any(pc.not_equal(pc.binary_length(a), pc.binary_length(b))).as_py():
            raise ValueError("fingerprints differ in length")
        return pc.if_else(_null(a, b), pa.scalar(None, pa.int64()), pa.array(_counts(*_xored(a, b))))

    @F.arrow_udf(FloatType())
    def bin_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
        flat, n = _xored(a, b)
        alike = np.where(n == 0, 1.0, 1.0 - _counts(flat, n) / np.maximum(1, 8.0 * n)).astype(np.float32)
        return pc.if_else(_null(a, b), pa.scalar(None, pa.float32()), pa.array(alike))

    for name, body in ON_WORDS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    udfs = {"bin_xor_bind": bin_xor_bind, "bin_popcount": bin_popcount, "bin_hamming": bin_hamming, "bin_similarity": bin_similarity}
    for name, udf in udfs.items():
        spark.udf.register(name, udf)
    return [*ON_WORDS, *udfs]

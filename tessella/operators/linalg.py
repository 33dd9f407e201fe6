"""Matrices in coordinate form (i, j, v) as joins and grouped sums; dense factorizations by group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def _plus(product: DataFrame, alpha: float, beta: float, c: DataFrame | None, keys: list[str]) -> DataFrame:
    out = product if alpha == 1 else product.withColumn("v", F.col("v") * F.lit(alpha))
    if c is None or beta == 0:
        return out
    return out.unionByName(c.select(*keys, (F.col("v") * F.lit(beta)).alias("v"))).groupBy(*keys).agg(F.sum("v").alias("v"))


def gemm(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 0.0, c: DataFrame | None = None, grid: int = 1) -> DataFrame:
    """alpha A B + beta C. Both sides meet on the inner index and partial sums are combined before
    the second shuffle; absent cells are zeros.

    A small side is broadcast by Spark. For two large sides with long columns set grid: rows of A
    and columns of B are dealt to grid blocks each, so the products of one inner index are spread
    over grid^2 tasks, for grid copies of each side.
    """
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    on = ["k"]
    if grid > 1:
        block = lambda x: F.pmod(F.xxhash64(x), F.lit(grid)).cast("int")
        every = F.explode(F.array(*(F.lit(g) for g in range(grid))))
        left, right = left.withColumn("bi", block("i")).withColumn("bj", every), right.withColumn("bj", block("j")).withColumn("bi", every)
        on = ["k", "bi", "bj"]
    product = left.join(right, on).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    return _plus(product, alpha, beta, c, ["i", "j"])


def gemv(a: DataFrame, x: DataFrame, alpha: float = 1.0, beta: float = 0.0, y: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """alpha A x + beta y; vectors are (i, v). `by` names the columns that tell many matrices apart."""
    by = by or []
    product = a.join(x.select(*by, F.col("i").alias("j"), F.col("v").alias("x")), [*by, "j"]).groupBy(*by, "i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))
    return _plus(product, alpha, beta, y, [*by, "i"])


def ger(x: list[float] | Column, y: list[float] | Column, a: DataFrame, alpha: float = 1.0) -> DataFrame:
    """A + alpha x y^T, added in place cell by cell; absent cells are not made. A vector is a literal
    or an expression of the cell's row or column."""
    at = lambda v, index: v if isinstance(v, Column) else F.get(F.array(*map(F.lit, v)), F.col(index).cast("int"))
    return a.select("i", "j", (F.col("v") + F.lit(alpha) * at(x, "i") * at(y, "j")).alias("v"))


def syrk(a: DataFrame, alpha: float = 1.0) -> DataFrame:
    """The upper triangle (i <= j) of alpha A A^T: the join's filter halves the products."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = a.select(F.col("i").alias("i2"), F.col("j").alias("k"), F.col("v").alias("y"))
    return left.join(right, "k").where("i <= i2").groupBy("i", F.col("i2").alias("j")).agg((F.lit(alpha) * F.sum(F.col("x") * F.col("y"))).alias("v"))


def mirror(upper: DataFrame) -> DataFrame:
    """A symmetric matrix from one triangle."""
    return upper.unionByName(transpose(upper.where("i <> j")))


def symm(upper: DataFrame, b: DataFrame) -> DataFrame:
    return gemm(mirror(upper), b)


def triangle(a: DataFrame, lower: bool = True, unit: bool = False) -> DataFrame:
    kept = a.where("j <= i" if lower else "i <= j")
    return kept.withColumn("v", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.col("v"))) if unit else kept


def trmv(a: DataFrame, x: DataFrame, lower: bool = True, unit: bool = False, by: list[str] | None = None) -> DataFrame:
    return gemv(triangle(a, lower, unit), x, by=by)


def gemm_i32(a: DataFrame, b: DataFrame) -> DataFrame:
    """Integer product; values are widened, so no sum wraps."""
    widen = lambda m: m.withColumn("v", F.col("v").cast("long"))
    return gemm(widen(a), widen(b)).withColumn("v", F.col("v").cast("long"))


def gemm_u8_i8(a: DataFrame, b: DataFrame, scale_a: float, zero_a: int, scale_b: float) -> DataFrame:
    """Product of quantized matrices: the zero point times B's column sums is taken off, both scales are put on."""
    columns = b.groupBy("j").agg(F.sum(F.col("v").cast("long")).alias("s"))
    raw = gemm_i32(a, b)
    return raw.join(columns, "j").select("i", "j", ((F.col("v") - F.lit(zero_a) * F.col("s")) * F.lit(scale_a * scale_b)).alias("v"))


def pruned_gemm(a: DataFrame, b: DataFrame, prune: float) -> DataFrame:
    """The product for rows of A whose L2 norm reaches the prune-quantile of all norms."""
    norms = a.groupBy("i").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    limit = norms.agg(F.percentile("norm", F.lit(prune))).first()[0]
    return gemm(a.join(norms.where(F.col("norm") >= F.lit(limit)).select("i"), "i", "left_semi"), b)


def gram(rows: DataFrame, vector: str, n: int) -> DataFrame:
    """X^T X of a table of array rows of n values: (i, j, v) with i <= j.

    Each task adds up the products of its Arrow batches, an n x n matrix, and sends n (n + 1) / 2
    cells, so the table is read once and never joined. Null rows and rows of another length raise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, n).astype(float)
            total += x.T @ x
        i, j = np.triu_indices(n)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    return rows.select(vector).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


# --- dense matrices by group: (matrix, i, j, v) -> one NumPy call a matrix, so a matrix must fit in a task


def _dense(pdf: pd.DataFrame) -> np.ndarray:
    out = np.zeros((int(pdf["i"].max()) + 1, int(pdf["j"].max()) + 1))
    out[pdf["i"].to_numpy(), pdf["j"].to_numpy()] = pdf["v"].to_numpy()
    return out


def _cells(matrix, part: str, a: np.ndarray, info: int = 0) -> pd.DataFrame:
    a = np.atleast_2d(a)
    i, j = np.indices(a.shape)
    return pd.DataFrame({"matrix": matrix, "part": part, "i": i.ravel(), "j": j.ravel(), "v": a.ravel(), "info": info})


def _lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Packed LU with partial pivoting, pivots, and k + 1 at the first zero pivot (else 0)."""
    a, pivots, info = a.copy(), np.arange(min(a.shape)), 0
    for k in range(min(a.shape)):
        p = k + int(np.argmax(np.abs(a[k:, k])))
        pivots[k] = p
        if a[p, k] == 0:
            info = info or k + 1
            continue
        a[[k, p]] = a[[p, k]]
        a[k + 1 :, k] /= a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return a, pivots, info


def by_matrix(df: DataFrame, fn: Callable[[object, np.ndarray], pd.DataFrame]) -> DataFrame:
    kind = df.schema["matrix"].dataType.simpleString()

    def run(key, pdf):
        return fn(key[0], _dense(pdf))

    return df.groupBy("matrix").applyInPandas(run, f"matrix {kind}, part string, i long, j long, v double, info long")


def lu(df: DataFrame) -> DataFrame:
    def one(m, a):
        packed, pivots, info = _lu(a)
        return pd.concat([_cells(m, "lu", packed, info), _cells(m, "pivots", pivots.astype(float), info)])

    return by_matrix(df, one)


def cholesky(df: DataFrame) -> DataFrame:
    """Lower factor; info is k + 1 at the first pivot that is not positive, and the factor null."""

    def one(m, a):
        low = np.zeros_like(a)
        for k in range(len(a)):
            pivot = a[k, k] - low[k, :k] @ low[k, :k]
            if not pivot > 0:
                return _cells(m, "l", np.full(a.shape, np.nan), k + 1)
            low[k, k] = pivot**0.5
            low[k + 1 :, k] = (a[k + 1 :, k] - low[k + 1 :, :k] @ low[k, :k]) / low[k, k]
        return _cells(m, "l", low)

    return by_matrix(df, one)


def qr(df: DataFrame) -> DataFrame:
    def one(m, a):
        q, r = np.linalg.qr(a)
        return pd.concat([_cells(m, "q", q), _cells(m, "r", r)])

    return by_matrix(df, one)


def solve_triangular(df: DataFrame, rhs_columns: int, lower: bool = True) -> DataFrame:
    """The last rhs_columns columns are right-hand sides of the triangle before them."""

    def one(m, a):
        t, b = a[:, :-rhs_columns], a[:, -rhs_columns:].copy()
        order = range(len(t)) if lower else range(len(t) - 1, -1, -1)
        for k in order:
            done = slice(0, k) if lower else slice(k + 1, len(t))
            b[k] = (b[k] - t[k, done] @ b[done]) / t[k, k]
        return _cells(m, "x", b)

    return by_matrix(df, one)


def solve(df: DataFrame, rhs_columns: int) -> DataFrame:
    def one(m, a):
        return _cells(m, "x", np.linalg.solve(a[:, :-rhs_columns], a[:, -rhs_columns:]))

    return by_matrix(df, one)


def fft(df: DataFrame, vector: str, id_col: str, inverse: bool = False) -> DataFrame:
    """(id, k, re, im) of real vectors of one length, a power of two; the inverse takes (re, im)
    interleaved and is scaled by 1/n. Arrow batches are transformed as one matrix."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            x = x[:, 0::2] + 1j * x[:, 1::2] if inverse else x
            n = x.shape[1]
            if n & (n - 1):
                raise ValueError("the length is no power of two")
            y = np.fft.ifft(x) if inverse else np.fft.fft(x)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), n)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(n), b.num_rows)), pa.array(y.real.ravel()), pa.array(y.imag.ravel())], names=["id", "k", "re", "im"])

    return df.select(id_col, vector).mapInArrow(run, f"id {kind}, k long, re double, im double")


# --- tall tables: n columns, any number of rows


def _gram_matrix(df: DataFrame, vector: str, n: int) -> np.ndarray:
    """X^T X on the driver: n x n numbers, whatever the rows."""
    out = np.zeros((n, n))
    for r in gram(df, vector, n).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def times(df: DataFrame, vector: str, matrix: np.ndarray, id_col: str, name: str = "q") -> DataFrame:
    """(id, name): each row's vector times a small matrix, by Arrow batch."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, matrix.shape[0])
            y = x @ matrix
            offsets = np.arange(len(y) + 1, dtype=np.int32) * matrix.shape[1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(y.ravel()))], names=["id", name])

    return df.select(id_col, vector).mapInArrow(run, f"id {kind}, {name} array<double>")


def tall_qr(df: DataFrame, vector: str, n: int, id_col: str) -> tuple[DataFrame, np.ndarray]:
    """Q (id, q array<double>) and R (n x n, upper) of a table of n columns with full rank.

    R is the Cholesky factor of the Gram matrix, and Q = X R^-1; both once more on Q, since the
    Gram matrix squares the condition. The rows are read, never gathered; a table without full rank raises.
    """
    first = np.linalg.cholesky(_gram_matrix(df, vector, n)).T
    q = times(df, vector, np.linalg.inv(first), id_col)
    second = np.linalg.cholesky(_gram_matrix(q, "q", n)).T
    return times(q, "q", np.linalg.inv(second), "id"), second @ first


def condition_number(df: DataFrame, vector: str, n: int) -> float:
    """Largest over least singular value of a table of n columns; infinite without full rank."""
    values = np.linalg.eigvalsh(_gram_matrix(df, vector, n))
    return float(np.sqrt(values[-1] / values[0])) if values[0] > 0 else float("inf")


def least_squares(df: DataFrame, vector: str, target: str, n: int) -> np.ndarray:
    """The n coefficients that minimise the sum of (x . beta - target)^2: two grouped sums over the rows."""
    both = df.select(F.concat(F.col(vector).cast("array<double>"), F.array(F.col(target).cast("double"))).alias("row"))
    g = _gram_matrix(both, "row", n + 1)
    return np.linalg.solve(g[:n, :n], g[:n, n])

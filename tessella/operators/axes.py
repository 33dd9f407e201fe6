"""Axis crystallization: the leading axes of a symmetric matrix that is a table of coordinates.

A block of vectors is multiplied by the matrix (a join and grouped sums) and made orthonormal by a
small factor from its Gram matrix; the block is a table with a row for each index, so the matrix may
be as wide as a table is long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cut import stored
from .linalg import gram


@dataclass(frozen=True)
class Axes:
    """vectors: (i, a0, a1, ...), a unit column for each axis; values: their eigenvalues, the largest
    size first; errors: the length of M a - value a; rounds: products that were made."""

    vectors: DataFrame
    values: list[float]
    errors: list[float]
    rounds: int


def correlation(counts: DataFrame) -> DataFrame:
    """(i, j, w) of symmetric counts (i, j, n): n over the root of the product of both totals."""
    totals = counts.groupBy("i").agg(F.sum("n").alias("t"))
    both = counts.join(totals, "i").join(totals.select(F.col("i").alias("j"), F.col("t").alias("u")), "j")
    return both.where("t > 0 and u > 0").select("i", "j", (F.col("n") / F.sqrt(F.col("t").cast("double") * F.col("u"))).alias("w"))


def second_moments(df: DataFrame, vector: str, size: int) -> DataFrame:
    """(i, j, w) of a table of vectors of that size: the mean of x_i x_j, by one pass (linalg.gram)."""
    rows = df.where(F.col(vector).isNotNull())
    n = rows.count()
    upper = gram(rows, vector, size).select("i", "j", (F.col("v") / F.lit(float(max(n, 1)))).alias("w"))
    return upper.unionByName(upper.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def _columns(n: int) -> list[str]:
    return [f"q{k}" for k in range(n)]


def _combined(rows: DataFrame, columns: list[str], factor: np.ndarray, names: list[str]) -> DataFrame:
    """rows (i, columns) times a small matrix: (i, names)."""
    one = lambda k: sum((F.col(c) * F.lit(float(factor[r, k])) for r, c in enumerate(columns) if factor[r, k]), F.lit(0.0))
    return rows.select("i", *(one(k).alias(n) for k, n in enumerate(names)))


def _moments(rows: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """The small matrix of sums of products of columns: partial sums in each task, one row to the driver."""
    row = rows.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"m{i}_{j}") for i, a in enumerate(left) for j, b in enumerate(right))).first()
    return np.array([[row[f"m{i}_{j}"] or 0.0 for j in range(len(right))] for i in range(len(left))])


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """A factor that makes columns of that Gram matrix orthonormal; directions that add nothing are left out."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > max(values.max(initial=0.0), 0.0) * 1e-13
    return vectors[:, keep] / np.sqrt(values[keep])


def crystallize(matrix: DataFrame, k: int = 3, spare: int = 5, steps: int = 2, tolerance: float = 1e-8, max_rounds: int = 100, seed: int = 1) -> Axes:
    """The k axes of largest eigenvalue, by size, of a symmetric matrix (i, j, w), absent cells 0.

    Randomized block power iteration with k + spare vectors: `steps` products, made orthonormal
    after each one, then a small eigenproblem (Rayleigh, Ritz) that tells the axes and their
    errors, until each error is at most tolerance times the largest value. A round's work is the
    matrix's cells; the driver holds matrices of k + spare. Signs are fixed: the entry of largest size, the
    smallest i among equals, is positive. A matrix without cells has no axes, one of lower rank fewer than k.
    """
    if k < 1 or spare < 0 or steps < 1:
        raise ValueError("k and steps must be 1 or more, spare 0 or more")
    cells = stored(matrix.where("i is not null and j is not null and w <> 0").groupBy("i", "j").agg(F.sum("w").cast("double").alias("w")), "axes-cells")
    start = cells.select("i").unionByName(cells.select(F.col("j").alias("i"))).distinct()
    # A number from each index's hash, so that a start is the same however rows are dealt.
    block = stored(start.select("i", *((F.xxhash64("i", F.lit(seed), F.lit(c)) / F.lit(float(1 << 63))).alias(n) for c, n in enumerate(_columns(k + spare)))), "axes-start")
    names, rounds, values, errors = _columns(k + spare), 0, np.empty(0), np.empty(0)
    factor = _orthonormal(_moments(block, names, names))
    while True:
        names, before = _columns(factor.shape[1]), names
        if not names:
            return Axes(block.select("i").limit(0), [], [], rounds)
        block = stored(_combined(block, before, factor, names), "axes-block")
        product = cells.join(block.withColumnRenamed("i", "j"), "j").groupBy("i").agg(*(F.sum(F.col("w") * F.col(n)).alias(f"z{n}") for n in names))
        both = stored(block.join(product, "i", "left").select("i", *names, *(F.coalesce(f"z{n}", F.lit(0.0)).alias(f"z{n}") for n in names)), "axes-product")
        rounds, images = rounds + 1, [f"z{n}" for n in names]
        gram = _moments(both, images, images)
        if rounds % steps == 0 or rounds >= max_rounds:
            inner = _moments(both, names, images)
            found, mix = np.linalg.eigh((inner + inner.T) / 2)
            order = np.argsort(-np.abs(found), kind="stable")[:k]
            values, mix = found[order], mix[:, order]
            errors = np.sqrt(np.maximum(np.einsum("rk,rs,sk->k", mix, gram, mix) - values**2, 0.0))
            if (errors <= tolerance * max(np.abs(values).max(initial=0.0), 1e-300)).all() or rounds >= max_rounds:
                break
        block, factor = both.select("i", *(F.col(z).alias(n) for z, n in zip(images, names, strict=True))), _orthonormal(gram)
    real = np.abs(values) > 1e-12 * max(np.abs(values).max(initial=0.0), 1e-300)
    values, errors, mix = values[real], errors[real], mix[:, real]
    axes = [f"a{n}" for n in range(len(values))]
    vectors = stored(_combined(both.select("i", *names), names, mix, axes), "axes-vectors")
    if axes:
        tops = vectors.agg(*(F.max_by(F.col(a), F.struct(F.round(F.abs(a), 9), -F.col("i"))).alias(a) for a in axes)).first()
        vectors = vectors.select("i", *((F.col(a) * F.lit(-1.0 if tops[a] is not None and tops[a] < 0 else 1.0)).alias(a) for a in axes))
    return Axes(vectors, values.tolist(), errors.tolist(), rounds)


def grid(matrix: DataFrame, axes: Axes, size: int = 256) -> DataFrame:
    """(i, c0, c1, ...): each index's projection M a on each axis, put linearly on 0 to size - 1."""
    names = [c for c in axes.vectors.columns if c != "i"]
    if not names:
        return axes.vectors
    put = matrix.join(axes.vectors.withColumnRenamed("i", "j"), "j").groupBy("i").agg(*(F.sum(F.col("w") * F.col(a)).alias(a) for a in names))
    put = stored(put, "axes-grid")
    ends = put.agg(*(f(a).alias(f"{t}{a}") for a in names for f, t in ((F.min, "lo"), (F.max, "hi")))).first()
    place = lambda a: F.round((F.col(a) - ends[f"lo{a}"]) / max(ends[f"hi{a}"] - ends[f"lo{a}"], 1e-10) * (size - 1)).cast("int")
    return put.select("i", *(place(a).alias(f"c{n}") for n, a in enumerate(names)))

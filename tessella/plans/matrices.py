"""Matrices in coordinate form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linalg, stats
from ..functions.vectors import rounded
from ._registry import INT8, query, signed8, table

_COO = "coo AS (SELECT vec_id AS i, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)"
#: A fixed 64 x 64 matrix to multiply with, and a vector of 64.
_B = "b AS (SELECT i, j, (((i * 7 + j * 3) % 11) - 5)::DOUBLE / 8 AS v FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(64)) AS j))"
_X = "x AS (SELECT i, ((i % 5) - 2)::DOUBLE / 4 AS v FROM (SELECT unnest(range(64)) AS i))"


def _coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as an n x 64 matrix."""
    return stats.long_form(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("j", F.col("j").cast("long"))


def _b(spark: SparkSession) -> DataFrame:
    cells = spark.range(64 * 64).select(F.floor(F.col("id") / 64).alias("i"), (F.col("id") % 64).alias("j"))
    return cells.withColumn("v", ((F.col("i") * 7 + F.col("j") * 3) % 11 - 5).cast("double") / 8)


def _vector(spark: SparkSession) -> DataFrame:
    return spark.range(64).select(F.col("id").alias("i"), ((F.col("id") % 5 - 2).cast("double") / 4).alias("v"))


def _r(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.withColumn("v", rounded("v", digits) + 0.0)


@query(f"WITH {_COO}, {_B} SELECT a.i, b.j, round(2 * sum(a.v * b.v), 5)::DOUBLE + 0 AS v FROM coo a JOIN b ON a.j = b.i GROUP BY a.i, b.j")
def gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(linalg.gemm(_coo(spark, sf_dir), _b(spark), alpha=2.0))


@query(f"WITH {_COO}, {_X} SELECT a.i, round(sum(a.v * x.v) + 0.5 * max(c.v), 5)::DOUBLE + 0 AS v FROM coo a JOIN x ON a.j = x.i JOIN coo c ON c.i = a.i AND c.j = 1 GROUP BY a.i")
def gemv(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _coo(spark, sf_dir)
    return _r(linalg.gemv(a, _vector(spark), 1.0, 0.5, a.where("j = 1").select("i", "v")))


@query(f"WITH {_COO} SELECT a.j AS i, b.j, round(sum(a.v * b.v), 4)::DOUBLE + 0 AS v FROM coo a JOIN coo b ON a.i = b.i WHERE a.j <= b.j GROUP BY a.j, b.j")
def syrk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(linalg.syrk(linalg.transpose(_coo(spark, sf_dir))), 4)


@query(f"WITH {_COO}, {_B} SELECT s.i, b.j, round(sum(s.v * b.v), 4)::DOUBLE + 0 AS v FROM (SELECT a.j AS i, c.j, sum(a.v * c.v) AS v FROM coo a JOIN coo c ON a.i = c.i GROUP BY a.j, c.j) s JOIN b ON s.j = b.i GROUP BY s.i, b.j")
def symm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(linalg.symm(linalg.syrk(linalg.transpose(_coo(spark, sf_dir))), _b(spark)), 4)


@query(f"WITH {_COO} SELECT i, j, round(v + 0.1 * i * (j + 1), 5)::DOUBLE + 0 AS v FROM coo")
def ger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(linalg.ger(F.col("i").cast("double"), [float(j + 1) for j in range(64)], _coo(spark, sf_dir), 0.1))


@query(f"WITH {_COO}, m AS (SELECT i // 64 AS matrix, i % 64 AS i, j, v FROM coo) SELECT a.matrix, a.i, round(sum(CASE WHEN a.i = a.j THEN 1 ELSE a.v END * b.v), 5)::DOUBLE + 0 AS v FROM m a JOIN m b ON a.matrix = b.matrix AND a.j = b.i AND b.j = 0 WHERE a.j <= a.i GROUP BY a.matrix, a.i")
def trmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One triangle for each block of 64 vectors; the last block may have fewer."""
    a = _coo(spark, sf_dir).select(F.floor(F.col("i") / 64).alias("matrix"), (F.col("i") % 64).alias("i"), "j", "v")
    return _r(linalg.trmv(a, a.where("j = 0").select("matrix", "i", "v"), lower=True, unit=True, by=["matrix"]))


_C8 = "c AS (SELECT vec_id AS i, unnest(range(64)) AS j, unnest(v) AS v FROM int8), b8 AS (SELECT i, j, CAST(v * 8 AS BIGINT) AS v FROM b)"


def _cells8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signed8(spark, sf_dir).select(F.col("vec_id").alias("i"), F.posexplode("v").alias("j", "v")).withColumn("j", F.col("j").cast("long"))


def _b8(spark: SparkSession) -> DataFrame:
    return _b(spark).withColumn("v", (F.col("v") * 8).cast("int"))


@query(f"WITH {INT8}, {_B}, {_C8} SELECT a.i, b.j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM c a JOIN b8 b ON a.j = b.i GROUP BY a.i, b.j")
def int8_gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.gemm_i32(_cells8(spark, sf_dir), _b8(spark))


@query(f"WITH {INT8}, {_B}, {_C8}, u AS (SELECT i, j, v + 128 AS v FROM c), s AS (SELECT j, sum(v) AS s FROM b8 GROUP BY j) SELECT a.i, b.j, round((sum(a.v * b.v) - 128 * max(s.s)) * 0.02, 4)::DOUBLE + 0 AS v FROM u a JOIN b8 b ON a.j = b.i JOIN s ON s.j = b.j GROUP BY a.i, b.j")
def int8_gemm_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(linalg.gemm_u8_i8(_cells8(spark, sf_dir).withColumn("v", F.col("v") + 128), _b8(spark), 0.2, 128, 0.1), 4)


@query(f"WITH {_COO}, {_B}, w AS (SELECT i, j, v * (1 + (i % 7)) AS v FROM coo), n AS (SELECT i, sqrt(sum(v * v)) AS norm FROM w GROUP BY i), k AS (SELECT i FROM n WHERE norm >= (SELECT quantile_cont(norm, 0.8) FROM n)) SELECT a.i, b.j, round(sum(a.v * b.v), 4)::DOUBLE + 0 AS v FROM w a JOIN b ON a.j = b.i WHERE a.i IN (SELECT i FROM k) GROUP BY a.i, b.j")
def pruned_gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _coo(spark, sf_dir).withColumn("v", F.col("v") * (1 + F.col("i") % 7))
    return _r(linalg.pruned_gemm(w, _b(spark), 0.8), 4)


@query("WITH x AS (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT CAST(a.j AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, round(sum(a.v * b.v), 4)::DOUBLE + 0 AS v FROM x a JOIN x b USING (vec_id) WHERE a.j <= b.j GROUP BY a.j, b.j")
def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(linalg.gram(table(spark, sf_dir, "embeddings"), "embedding", 64), 4)


def _dense(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """One n x n matrix for each full block of n vectors, well conditioned by n on the diagonal."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / n).alias("matrix"), (F.col("vec_id") % n).alias("i"), F.posexplode("embedding").alias("j", "v")).where(F.col("j") < n)
    return e.select("matrix", "i", F.col("j").cast("long").alias("j"), (F.col("v").cast("double") + F.when(F.col("i") == F.col("j"), float(n)).otherwise(0.0)).alias("v"))


@query("WITH x AS (SELECT vec_id // 8 AS matrix, vec_id % 8 AS i, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT matrix, i, j, round(v + CASE WHEN i = j THEN 8 ELSE 0 END, 6)::DOUBLE AS v FROM x WHERE j < 8")
def lu_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P^-1 L U of each matrix: the matrix again. The diagonal dominates, so no row is exchanged."""
    parts = linalg.lu(_dense(spark, sf_dir, 8)).where("part = 'lu'")
    low = parts.where("j <= i").select("matrix", "i", F.col("j").alias("k"), F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("v")).alias("x"))
    up = parts.where("i <= j").select("matrix", F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return _r(low.join(up, ["matrix", "k"]).groupBy("matrix", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v")), 6)


@query()
def qr_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.qr(_dense(spark, sf_dir, 8))


@query("WITH x AS (SELECT vec_id, unnest(range(64)) AS t, unnest(embedding)::DOUBLE AS v FROM embeddings), k AS (SELECT range AS k FROM range(64)) SELECT vec_id AS id, k, CASE WHEN round(sum(v * cos(2 * pi() * k * t / 64)), 4) = 0 THEN 0 ELSE round(sum(v * cos(2 * pi() * k * t / 64)), 4)::DOUBLE END AS re, CASE WHEN round(-sum(v * sin(2 * pi() * k * t / 64)), 4) = 0 THEN 0 ELSE round(-sum(v * sin(2 * pi() * k * t / 64)), 4)::DOUBLE END AS im FROM x, k GROUP BY vec_id, k")
def fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linalg.fft(table(spark, sf_dir, "embeddings"), "embedding", "vec_id")
    zero = lambda c: F.when(F.round(c, 4) == 0, 0.0).otherwise(F.round(c, 4))
    return out.select("id", "k", zero(F.col("re")).alias("re"), zero(F.col("im")).alias("im"))


@query("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM (SELECT unnest(range(16)) AS i), (SELECT unnest(range(16)) AS j) WHERE i <= j")
def tall_qr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q^T Q of the whole table's first 16 dimensions (the matrix is that wide): the identity."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 16).alias("x"))
    q, _ = linalg.tall_qr(e, "x", 16, "vec_id")
    return _r(linalg.gram(q, "q", 16), 6)


@query("WITH d AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: x::DOUBLE) AS x FROM embeddings), b AS (SELECT list_transform(range(16), lambda i: (i % 5 - 2) / 4.0::DOUBLE) AS b) SELECT vec_id, round(list_sum(list_transform(list_zip(x, b), lambda t: t[1] * t[2])), 6)::DOUBLE + 0 AS fitted FROM d, b")
def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients found again from exact targets, shown by what they fit."""
    beta = [(i % 5 - 2) / 4.0 for i in range(16)]
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 16).alias("x"))
    x = x.withColumn("y", F.aggregate(F.zip_with("x", F.array(*map(F.lit, beta)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    found = linalg.least_squares(x, "x", "y", 16)
    fitted = linalg.times(x, "x", found.reshape(-1, 1), "vec_id", "f")
    return fitted.select(F.col("id").alias("vec_id"), (rounded(F.col("f")[0], 6) + 0.0).alias("fitted"))

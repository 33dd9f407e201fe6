"""Arrays by row: constructors, layout, BLAS level 1, 16-bit floats, coarse statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bf16, bits
from ..functions import vectors as V
from ..operators import linalg, search, stats, sweeps
from ..operators._cut import shared_folder
from ..sources import records
from ..functions.vectors import rounded
from ._registry import query, table

_E = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x, list_reverse(list_transform(embedding, lambda x: x::DOUBLE)) AS y FROM embeddings)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector and the same one backwards."""
    return table(spark, sf_dir, "embeddings").select("vec_id", V.doubles("embedding").alias("x"), F.reverse(V.doubles("embedding")).alias("y"))


def _zip(op: str, a: str = "x", b: str = "y") -> str:
    return f"list_transform(list_zip({a}, {b}), lambda t: {op})"


def _round(expr: str, digits: int = 6) -> str:
    return f"list_transform({expr}, lambda v: round(v, {digits})::DOUBLE + 0)"


def _rounded(x, digits: int = 6):
    return F.transform(x, lambda v: rounded(v, digits) + 0.0)


@query("SELECT [0.0, 0.0, 0.0]::DOUBLE[] AS z, [1.0, 1.0]::DOUBLE[] AS o, [2, 3]::INTEGER[] AS shape, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]::DOUBLE[] AS data, [3, 2]::INTEGER[] AS reshaped, [6]::INTEGER[] AS squeezed, [3.0, 4.0, 5.0]::DOUBLE[] AS row1, [2.0, 5.0]::DOUBLE[] AS column2, [3.0, 4.0, 5.0, 0.0, 1.0, 2.0]::DOUBLE[] AS down, [2.0, 1.0, 0.0, 5.0, 4.0, 3.0]::DOUBLE[] AS back, [0.0, 1.0, 2.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 3.0, 4.0, 5.0]::DOUBLE[] AS beside, [4, 3]::INTEGER[] AS below")
def matrix_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.range(1).select(V.with_shape(V.arange(0, 6, 1.0), [2, 3]).alias("m"))
    flat = V.squeeze(V.reshape(F.col("m"), [1, 6, 1]))
    return m.select(
        V.zeros(3).alias("z"), V.ones(2).alias("o"), F.col("m.shape").cast("array<int>").alias("shape"), F.col("m.data").alias("data"),
        V.reshape(F.col("m"), [3, 2])["shape"].cast("array<int>").alias("reshaped"), flat["shape"].cast("array<int>").alias("squeezed"),
        V.row_slice(F.col("m"), 1).alias("row1"), V.column_slice(F.col("m"), 2).alias("column2"),
        V.flip_axis(F.col("m"), 0)["data"].alias("down"), V.flip_axis(F.col("m"), 1)["data"].alias("back"),
        V.concatenate_axis(F.col("m"), F.col("m"), 1)["data"].alias("beside"), V.concatenate_axis(F.col("m"), F.col("m"), 0)["shape"].cast("array<int>").alias("below"),
    )


@query(f"WITH {_E} SELECT vec_id, x[4] AS one, x[11:14] AS part, list_concat(x[1:2], [9.0::DOUBLE], x[4:6]) AS changed FROM e")
def row_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _pairs(spark, sf_dir)
    return x.select("vec_id", V.item(V.take("x", 3, 4)).alias("one"), V.take("x", 10, 14).alias("part"), V.put(V.take("x", 0, 6), 2, 9.0).alias("changed"))


@query(f"WITH {_E} SELECT vec_id, {_round(_zip('2.5 * t[1] + t[2]'))} AS axpy, {_round('list_transform(x, lambda v: v * 3)')} AS scaled, round(list_sum(list_transform(x, lambda v: abs(v))), 6)::DOUBLE AS asum, round(sqrt(list_sum(list_transform(x, lambda v: v * v))), 6)::DOUBLE AS nrm2, CAST(list_position(list_transform(x, lambda v: abs(v)), list_max(list_transform(x, lambda v: abs(v)))) - 1 AS BIGINT) AS iamax, round(list_sum({_zip('t[1] * t[2]')}), 6)::DOUBLE + 0 AS dot FROM e")
def blas_level1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.select(
        "vec_id", _rounded(V.axpy(2.5, "x", "y")).alias("axpy"), _rounded(V.scale("x", 3.0)).alias("scaled"), rounded(V.norm("x", 1), 6).alias("asum"),
        rounded(V.norm("x", 2), 6).alias("nrm2"), V.iamax("x").cast("long").alias("iamax"), (rounded(V.dot("x", "y"), 6) + 0.0).alias("dot"),
    )


@query(f"WITH {_E} SELECT vec_id, {_round(_zip('t[1] + t[2]'))} AS added, {_round(_zip('t[1] - t[2]'))} AS taken, {_round(_zip('t[1] * t[2]'))} AS product, {_round(_zip('t[1] / (abs(t[2]) + 1)'))} AS ratio, {_round('list_transform(x, lambda v: sin(v))')} AS s, {_round('list_transform(x, lambda v: cos(v))')} AS c, {_round('list_transform(x, lambda v: pow(abs(v), 1.5))')} AS p FROM e")
def vector_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    whole = V.shift(V.each("y", F.abs), 1.0)
    out = {"added": V.add("x", "y"), "taken": V.sub("x", "y"), "product": V.mul("x", "y"), "ratio": V.div(F.col("x"), whole), "s": V.each("x", F.sin), "c": V.each("x", F.cos), "p": V.each("x", lambda v: F.pow(F.abs(v), F.lit(1.5)))}
    return p.select("vec_id", *(_rounded(v).alias(k) for k, v in out.items()))


#: floor(|x| / 2^(e - 7)) * 2^(e - 7), e the exponent of x, is x cut to 8 bits.
_UNIT = "pow(2.0::DOUBLE, floor(log2(abs(v))) - 7)"


@query(f"WITH {_E} SELECT vec_id, list_transform(x, lambda v: CASE WHEN v = 0 THEN 0.0 ELSE sign(v) * floor(abs(v) / {_UNIT}) * {_UNIT} END::DOUBLE) AS cut, list_transform(x, lambda v: CASE WHEN v = 0 THEN 0.0 ELSE sign(v) * round_even(abs(v) / {_UNIT}, 0) * {_UNIT} END::DOUBLE) AS near FROM e")
def bf16_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    zero = lambda x: F.transform(x, lambda v: v + 0.0)
    return e.select("vec_id", zero(bf16.widened(bf16.truncated("embedding"))).alias("cut"), zero(bf16.widened(bf16.rounded("embedding"))).alias("near"))


@query(f"WITH {_E}, c AS (SELECT vec_id, list_transform(x, lambda v: CASE WHEN v = 0 THEN 0.0 ELSE sign(v) * floor(abs(v) / {_UNIT}) * {_UNIT} END::DOUBLE) AS x FROM e) SELECT a.vec_id, round(list_sum({_zip('t[1] * t[2]', 'a.x', 'b.x')}), 5)::DOUBLE + 0 AS dot FROM c a, c b WHERE b.vec_id = 0")
def bf16_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lanes = table(spark, sf_dir, "embeddings").select("vec_id", bf16.truncated("embedding").alias("lanes"))
    q = F.array(*map(F.lit, lanes.where("vec_id = 0").first()["lanes"]))
    return lanes.select("vec_id", (rounded(bf16.dot(F.col("lanes"), q), 5) + 0.0).alias("dot"))


_TOP = "list_max(list_transform(x, lambda v: abs(v)))"


@query(f"WITH {_E}, n AS (SELECT vec_id, sqrt(list_sum(list_transform(x, lambda v: pow(round(v / ({_TOP} / 127)), 2)))) * ({_TOP} / 127) AS norm FROM (SELECT vec_id, list_transform(x, lambda v: v * (1 + vec_id % 7)) AS x FROM e)) SELECT vec_id, round(norm, 6)::DOUBLE AS norm FROM n ORDER BY n.norm DESC, vec_id LIMIT 20")
def top_rows_by_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _pairs(spark, sf_dir).select("vec_id", F.transform("x", lambda v: v * (1 + F.col("vec_id") % 7)).alias("x"))
    return sweeps.top_rows_by_norm(x, 20, "x").select("vec_id", rounded("norm", 6).alias("norm"))


_WIDE = "((list_max(x) - list_min(x)) / 255)"
_LEVEL = f"list_transform(x, lambda v: round((v - list_min(x)) * (1 / {_WIDE})))"


@query(f"WITH {_E}, l AS (SELECT vec_id, {_LEVEL} AS q, list_min(x) AS low, {_WIDE} AS wide FROM e) SELECT vec_id, round(list_sum(q) / 64 * wide + low, 6)::DOUBLE + 0 AS mean, round(sqrt(greatest(0, list_sum(list_transform(q, lambda v: v * v)) / 64 - pow(list_sum(q) / 64, 2))) * wide, 6)::DOUBLE AS std FROM l")
def approx_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _pairs(spark, sf_dir).withColumn("s", sweeps.approx_mean_std("x"))
    return s.select("vec_id", (rounded("s.mean", 6) + 0.0).alias("mean"), rounded("s.std", 6).alias("std"))


@query("WITH x AS (SELECT unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings), b AS (SELECT j, min(v) AS low, (max(v) - min(v)) / 255 AS wide FROM x GROUP BY j), q AS (SELECT j, wide, round((v - low) * (1 / wide)) AS q FROM x JOIN b USING (j)) SELECT CAST(j AS INTEGER) AS j, round(sqrt(greatest(0, sum(q * q) / count(*) - pow(sum(q) / count(*), 2))) * max(wide), 6)::DOUBLE AS std FROM q GROUP BY j")
def approx_column_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.approx_column_std(table(spark, sf_dir, "embeddings"), "embedding").withColumn("std", rounded("std", 6))


_Q = "q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 127) AS INTEGER) + 128) AS v FROM embeddings)"


@query(f"WITH {_Q} SELECT vec_id, list_sort(v) AS sorted, v AS back FROM q")
def sort_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: F.round(x.cast("double") * 127).cast("int") + 128)
    s = table(spark, sf_dir, "embeddings").select("vec_id", V.sort_with_places(v).alias("s"))
    return s.select("vec_id", F.col("s.sorted").alias("sorted"), V.unsort(F.col("s.sorted"), F.col("s.places")).alias("back"))


@query(f"WITH {_Q}, s AS (SELECT vec_id, list_sort(v) AS v FROM q), d AS (SELECT a.vec_id, CAST(list_sum({_zip('abs(t[1] - t[2])', 'a.v', 'b.v')}) AS BIGINT) AS d FROM s a, s b WHERE b.vec_id = 0) SELECT vec_id, d FROM d WHERE d <= 220")
def wasserstein_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-Wasserstein distance of sorted values to those of one row, within a limit."""
    v = F.transform("embedding", lambda x: F.round(x.cast("double") * 127).cast("int") + 128)
    s = table(spark, sf_dir, "embeddings").select("vec_id", F.array_sort(v).alias("v"))
    q = F.array(*map(F.lit, s.where("vec_id = 0").first()["v"]))
    return search.within(s, bits.l1_distance("v", q), 220).select("vec_id", "d")


_STATES = "list_transform(embedding, lambda x: CAST(floor(abs(x::DOUBLE) * 16) AS INTEGER) % 4)"


@query(f"WITH s AS (SELECT vec_id, {_STATES} AS s FROM embeddings) SELECT vec_id, list_transform(range(16), lambda k: CAST(s[4 * k + 1] * 64 + s[4 * k + 2] * 16 + s[4 * k + 3] * 4 + s[4 * k + 4] AS INTEGER)) AS packed, s AS back FROM s")
def packed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 16).cast("int") % 4)
    p = table(spark, sf_dir, "embeddings").select("vec_id", bits.pack_states(s).alias("packed"))
    return p.select("vec_id", "packed", bits.unpack_states("packed", 64).alias("back"))


@query(f"WITH {_Q}, p AS (SELECT vec_id, list_transform(v, lambda x: x - 128) AS v FROM q) SELECT vec_id, list_transform(range(160), lambda j: v[CAST(least(floor(j / 2.5::DOUBLE), 63) AS INTEGER) + 1] * (1.0::DOUBLE - (j / 2.5::DOUBLE - floor(j / 2.5::DOUBLE))) + v[CAST(least(floor(j / 2.5::DOUBLE) + 1, 63) AS INTEGER) + 1] * (j / 2.5::DOUBLE - floor(j / 2.5::DOUBLE))) AS up, list_transform(range(16), lambda i: CAST(least(7, greatest(-7, round(list_sum(v[4 * i + 1:4 * i + 4]) / 4.0::DOUBLE))) AS INTEGER)) AS down FROM p")
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: F.round(x.cast("double") * 127))
    p = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    return p.select("vec_id", V.upsample("v", 160, 64).alias("up"), V.downsample("v", 16, 64, -7, 7).alias("down"))


_FIVE = "list_transform(embedding, lambda x: CAST(floor(abs(x::DOUBLE) * 20) AS INTEGER) % 5)"


@query(f"WITH s AS (SELECT vec_id, list_append(list_append({_FIVE}, 2), 2) AS t, {_FIVE} AS s FROM embeddings) SELECT vec_id, list_transform(range(22), lambda k: CAST(t[3 * k + 1] * 25 + t[3 * k + 2] * 5 + t[3 * k + 3] AS INTEGER)) AS packed, s AS back FROM s")
def packed_five_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 20).cast("int") % 5)
    p = table(spark, sf_dir, "embeddings").select("vec_id", bits.pack_five(s).alias("packed"))
    return p.select("vec_id", "packed", bits.unpack_five("packed", 64).alias("back"))


@query("SELECT p.vec_id, round(list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5)::DOUBLE + 0 AS cos FROM embeddings p, embeddings q WHERE q.vec_id = 0 AND list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.1")
def cosine_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = [float(x) for x in e.where("vec_id = 0").first()["embedding"]]
    return search.cosine_within(e, q, 0.1).select("vec_id", (rounded("cos", 5) + 0.0).alias("cos"))


@query(f"WITH {_E}, c AS (SELECT vec_id AS i, unnest(range(64)) AS k, unnest(list_transform(x, lambda v: CASE WHEN v = 0 THEN 0.0 ELSE sign(v) * floor(abs(v) / {_UNIT}) * {_UNIT} END::DOUBLE)) AS v FROM e), b AS (SELECT k, j, (((k * 7 + j * 3) % 11) - 5)::DOUBLE / 8 AS v FROM (SELECT unnest(range(64)) AS k), (SELECT unnest(range(8)) AS j)) SELECT i, j, round(sum(c.v * b.v), 4)::DOUBLE + 0 AS v FROM c JOIN b USING (k) GROUP BY i, j")
def bf16_gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table cut to 16-bit floats, times a fixed 64 x 8 matrix; sums in doubles."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", bf16.widened(bf16.truncated("embedding")).alias("x"))
    a = stats.long_form(e, "vec_id", "x").withColumn("j", F.col("j").cast("long"))
    b = spark.range(64 * 8).select(F.floor(F.col("id") / 8).alias("i"), (F.col("id") % 8).alias("j"))
    b = b.withColumn("v", ((F.col("i") * 7 + F.col("j") * 3) % 11 - 5).cast("double") / 8)
    return linalg.gemm(a, b).withColumn("v", rounded("v", 4) + 0.0)


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey * 1.5::DOUBLE AS score FROM nation")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table through CSV files in the shared folder."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") * 1.5).alias("score"))
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    records.write_csv(n, path)
    return records.read_csv(spark, path, "id int, name string, score double")


@query("SELECT vec_id, [label::DOUBLE, 0.0, vec_id::DOUBLE]::DOUBLE[] AS v FROM embeddings")
def named_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a JSON object by name, in a fixed order."""
    text = F.to_json(F.create_map(F.lit("a"), F.col("label").cast("double"), F.lit("c"), F.col("vec_id").cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", records.named_values(text, ["a", "b", "c"]).alias("v"))

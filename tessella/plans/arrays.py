"""Arrays: element-wise functions, reductions, ordering, quantization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import stats
from ..functions.vectors import rounded
from ._registry import query, table

X = "list_transform(embedding, lambda x: x::DOUBLE)"


def _x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles("embedding").alias("x"))


def _rounded(x, digits: int = 5):
    return F.transform(x, lambda v: rounded(v, digits))


def _list(expr: str, digits: int = 5) -> str:
    return f"list_transform({expr}, lambda y: round(y, {digits})::DOUBLE)"


@query(f"WITH e AS (SELECT vec_id, {X} AS x FROM embeddings) SELECT vec_id, {_list('list_transform(x, lambda v: 2 * v + 0.5)')} AS axpy, {_list('list_transform(x, lambda v: v * v)')} AS mul, {_list('list_transform(x, lambda v: exp(v))')} AS exps, {_list('list_transform(x, lambda v: ln(abs(v) + 1))')} AS logs, {_list('list_transform(x, lambda v: 1 / (1 + exp(-v)))')} AS sigmoids FROM e")
def elementwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _x(spark, sf_dir)
    return x.select(
        "vec_id",
        _rounded(V.shift(V.scale("x", 2.0), 0.5)).alias("axpy"),
        _rounded(V.mul("x", "x")).alias("mul"),
        _rounded(V.each("x", F.exp)).alias("exps"),
        _rounded(V.log(V.shift(V.each("x", F.abs), 1.0))).alias("logs"),
        _rounded(V.sigmoid("x")).alias("sigmoids"),
    )


@query(f"WITH e AS (SELECT vec_id, {X} AS x FROM embeddings) SELECT vec_id, {_list('list_transform(x, lambda v: exp(v - list_max(x)) / list_sum(list_transform(x, lambda u: exp(u - list_max(x)))))', 7)} AS softmax, {_list('list_transform(x, lambda v: v - list_max(x) - ln(list_sum(list_transform(x, lambda u: exp(u - list_max(x))))))', 6)} AS log_softmax FROM e")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _x(spark, sf_dir).select("vec_id", _rounded(V.softmax("x"), 7).alias("softmax"), _rounded(V.log_softmax("x"), 6).alias("log_softmax"))


@query(f"WITH e AS (SELECT vec_id, {X} AS x FROM embeddings) SELECT vec_id, round(list_sum(list_transform(x, lambda v: abs(v))), 5)::DOUBLE AS l1, round(sqrt(list_sum(list_transform(x, lambda v: v * v))), 5)::DOUBLE AS l2, round(list_avg(x), 5)::DOUBLE AS mean, round(list_var_pop(x), 5)::DOUBLE AS var, round(list_stddev_pop(x), 5)::DOUBLE AS std, list_min(x) AS low, list_max(x) AS high, CAST(list_position(x, list_min(x)) - 1 AS BIGINT) AS argmin, CAST(list_position(x, list_max(x)) - 1 AS BIGINT) AS argmax FROM e")
def row_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c, name: rounded(c, 5).alias(name)
    return _x(spark, sf_dir).select(
        "vec_id", r(V.l1("x"), "l1"), r(V.l2("x"), "l2"), r(V.mean("x"), "mean"), r(V.var("x"), "var"), r(V.std("x"), "std"),
        F.array_min("x").alias("low"), F.array_max("x").alias("high"), V.argmin("x").alias("argmin"), V.argmax("x").alias("argmax"),
    )


@query(f"WITH e AS (SELECT vec_id, unnest({X}) AS v FROM embeddings) SELECT vec_id, round(median(v), 6)::DOUBLE AS median, round(quantile_cont(v, 0.9), 6)::DOUBLE AS p90 FROM e GROUP BY vec_id")
def row_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _x(spark, sf_dir).select("vec_id", rounded(V.median("x"), 6).alias("median"), rounded(V.percentile("x", 90.0), 6).alias("p90"))


@query("WITH e AS (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS j FROM embeddings) SELECT CAST(j AS INTEGER) AS j, round(avg(v), 5)::DOUBLE AS mean, min(v) AS low, max(v) AS high, round(var_pop(v), 5)::DOUBLE AS var, round(stddev_pop(v), 5)::DOUBLE AS std FROM e GROUP BY j")
def axis_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.column_stats(table(spark, sf_dir, "embeddings"), "embedding")
    return s.select("j", rounded("mean", 5).alias("mean"), F.col("min").alias("low"), F.col("max").alias("high"), rounded("var", 5).alias("var"), rounded("std", 5).alias("std"))


@query("SELECT event_type, round(quantile_cont(value, 0.25), 4)::DOUBLE AS p25, round(median(value), 4)::DOUBLE AS median, round(var_pop(value), 3)::DOUBLE AS var, round(stddev_pop(value), 3)::DOUBLE AS std, count(*) AS n FROM events GROUP BY event_type")
def grouped_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    sums = e.groupBy("event_type").agg(rounded(F.var_pop("value"), 3).alias("var"), rounded(F.stddev_pop("value"), 3).alias("std"), F.count("*").alias("n"))
    found = stats.quantiles(e, ["event_type"], "value", {"p25": 0.25, "median": 0.5})
    return sums.join(found, "event_type").select("event_type", rounded("p25", 4).alias("p25"), rounded("median", 4).alias("median"), "var", "std", "n")


@query("SELECT user_id, arg_max(event_id, struct_pack(v := value, b := -event_id)) AS id, max(value) AS value FROM events GROUP BY user_id")
def argmax_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.first_extreme(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(25)


@query(f"WITH e AS (SELECT vec_id, unnest({X}) AS v, unnest(range(64)) AS j FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, j) AS k FROM e) SELECT vec_id, list(CAST(j AS INTEGER) ORDER BY k) AS best FROM r WHERE k <= 5 GROUP BY vec_id")
def row_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _x(spark, sf_dir).select("vec_id", F.transform(V.top_k("x", 5), lambda e: e["index"]).alias("best"))


@query(f"WITH e AS (SELECT vec_id, {X} AS x FROM embeddings) SELECT vec_id, {_list('list_transform(range(1, 65), lambda i: list_sum(list_slice(x, 1, i)))')} AS cumsum, list_slice(list_reverse(x), 1, 3) AS flipped, list_concat(list_slice(x, 1, 2), list_slice(x, 63, 64)) AS joined FROM e")
def row_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _x(spark, sf_dir).select("vec_id", _rounded(V.cumsum("x")).alias("cumsum"), V.take(V.flip("x"), 0, 3).alias("flipped"), V.concatenate(V.take("x", 0, 2), V.take("x", 62, 64)).alias("joined"))


_S8 = "CASE WHEN list_max(list_transform(x, lambda v: abs(v))) > 0 THEN list_max(list_transform(x, lambda v: abs(v))) / 127 ELSE 1 END"


@query(f"WITH e AS (SELECT vec_id, {X} AS x FROM embeddings), s AS (SELECT *, {_S8} AS s FROM e) SELECT vec_id, list_transform(x, lambda v: CAST(least(127, greatest(-128, round(v / s))) AS INTEGER)) AS q, round(s, 8)::DOUBLE AS scale FROM s")
def int8_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _x(spark, sf_dir).withColumn("z", V.quantize_i8("x"))
    return q.select("vec_id", "z.q", rounded("z.scale", 8).alias("scale"))


@query(f"WITH e AS (SELECT vec_id, {X} AS x FROM embeddings), s AS (SELECT *, (list_max(x) - list_min(x)) / 255 AS s FROM e), z AS (SELECT *, CAST(least(255, greatest(0, round(-list_min(x) / s))) AS INTEGER) AS zero FROM s) SELECT vec_id, list_transform(x, lambda v: CAST(least(255, greatest(0, round(v / s) + zero)) AS INTEGER)) AS q, zero FROM z")
def minmax_u8_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _x(spark, sf_dir).withColumn("z", V.quantize_u8("x"))
    return q.select("vec_id", "z.q", "z.zero")


@query(f"WITH e AS (SELECT vec_id, {X} AS x FROM embeddings), s AS (SELECT *, list_max(list_transform(x, lambda v: abs(v))) / 7 AS s FROM e) SELECT vec_id, list_transform(x, lambda v: round(CAST(least(7, greatest(-8, round(v / s))) AS INTEGER) * s, 6)::DOUBLE) AS back FROM s")
def int4_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _x(spark, sf_dir).withColumn("z", V.quantize_i4("x"))
    return q.select("vec_id", _rounded(V.dequantize_i4(F.col("z.packed"), F.col("z.scale"), 64), 6).alias("back"))


@query("SELECT i::BIGINT AS i, round(1 + 0.25 * i, 6)::DOUBLE AS a, round(2.0 * i / 7, 6)::DOUBLE AS l FROM range(8) t(i)")
def constructors(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.range(1).select(F.arrays_zip(V.arange(1, 3, 0.25).alias("a"), V.linspace(0, 2, 8).alias("l")).alias("z"))
    return one.select(F.posexplode("z").alias("i", "e")).select(F.col("i").cast("long").alias("i"), F.round("e.a", 6).alias("a"), F.round("e.l", 6).alias("l"))

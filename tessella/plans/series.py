"""Ordered series and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats, temporal
from ..operators._cut import shared_folder
from ..streaming import shift
from ..functions.vectors import rounded
from ._registry import FP2, prints, query, table

_EDGES = [-10.0, 10.0, 50.0]


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3)::DOUBLE AS cumsum FROM events")
def cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.running_sum(table(spark, sf_dir, "events"), "value", ["ts", "event_id"], ["user_id"]).select("event_id", rounded("cumsum", 3).alias("cumsum"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2)::DOUBLE AS cumsum FROM events")
def cumsum_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five long keys, each in many ranges."""
    out = temporal.running_sum_split(table(spark, sf_dir, "events"), "value", ["ts", "event_id"], ["event_type"])
    return out.select("event_id", rounded("cumsum", 2).alias("cumsum"))


def _pair(t: int) -> str:
    return f"coalesce(avg(CASE WHEN l{t} IS NOT NULL THEN abs(a - l{t}) - abs(b - l{t}) END), 0)"


_GR = "g AS (SELECT user_id, value AS a, event_id % 100 AS b, " + ", ".join(f"lead(event_id % 100, {t}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l{t}" for t in (1, 2, 3)) + " FROM events)"


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("a"), (F.col("event_id") % 100).alias("b"))


@query(f"WITH {_GR} SELECT user_id, round({_pair(2)}, 4)::DOUBLE AS signal FROM g GROUP BY user_id")
def granger(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.granger_signal(_series(spark, sf_dir), "a", "b", 2, ["user_id"], ["ts", "event_id"], lambda x, y: F.abs(x - y))
    return out.withColumn("signal", rounded("signal", 4))


@query(f"WITH {_GR}, s AS (SELECT user_id, {_pair(1)} AS s1, {_pair(2)} AS s2, {_pair(3)} AS s3 FROM g GROUP BY user_id) SELECT user_id, CASE WHEN s1 <= s2 AND s1 <= s3 THEN 1 WHEN s2 <= s3 THEN 2 ELSE 3 END AS lag, round(least(s1, s2, s3), 4)::DOUBLE AS signal FROM s")
def granger_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.granger_scan(_series(spark, sf_dir), "a", "b", 3, ["user_id"], ["ts", "event_id"], lambda x, y: F.abs(x - y))
    return out.withColumn("signal", rounded("signal", 4))


@query(f"WITH {FP2}, s AS (SELECT *, lag(a, 2) OVER o AS pa, lag(b, 2) OVER o AS pb FROM fp2 WINDOW o AS (PARTITION BY label ORDER BY vec_id)) SELECT label, vec_id, CAST(bit_count(xor(a, pa)) + bit_count(xor(b, pb)) AS BIGINT) AS changed FROM s WHERE pa IS NOT NULL")
def state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.state_diff(prints(spark, sf_dir), "fp", 2, ["label"], "vec_id").select("label", "vec_id", "changed")


@query(f"WITH {FP2}, s AS (SELECT *, lag(a, 1) OVER o AS pa, lag(b, 1) OVER o AS pb FROM fp2 WINDOW o AS (PARTITION BY label ORDER BY vec_id)), d AS (SELECT label, vec_id, 1.0 - 2.0 * (bit_count(xor(a, pa)) + bit_count(xor(b, pb))) / 64 AS s FROM s WHERE pa IS NOT NULL), f AS (SELECT *, abs(CASE WHEN s >= 0 THEN s ELSE 0.25 * s END) AS fw, abs(CASE WHEN -s >= 0 THEN -s ELSE -0.25 * s END) AS bw FROM d) SELECT label, vec_id, CASE WHEN coalesce(fw / nullif(fw + bw, 0), 0.5) > 0.7 THEN 'forward' WHEN coalesce(fw / nullif(fw + bw, 0), 0.5) < 0.3 THEN 'backward' WHEN fw + bw > 0.5 THEN 'contested' ELSE 'symmetric' END AS arrow FROM f")
def causal_arrows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = temporal.state_diff(prints(spark, sf_dir), "fp", 2, ["label"], "vec_id", back=1)
    return d.select("label", "vec_id", temporal.causal_arrow(F.col("changed"), 64)["arrow"].alias("arrow"))


@query("WITH l AS (SELECT user_id, event_id, event_type AS now, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) SELECT * FROM l WHERE was IS NOT NULL AND was <> now")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.transitions(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


_BAND = "(value >= -10)::INTEGER + (value >= 10)::INTEGER + (value >= 50)::INTEGER"
_HIST = f"h AS (SELECT date_trunc('day', ts) AS start, {_BAND} AS band, count(*) AS n FROM events GROUP BY 1, 2)"


@query(f"WITH {_HIST} SELECT CAST(epoch(start) AS BIGINT) AS start, band, n FROM h")
def shift_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = temporal.shift_histogram(table(spark, sf_dir, "events"), "ts", "value", "1 day", _EDGES)
    return h.withColumn("start", F.unix_timestamp("start"))


@query(f"WITH {_HIST}, m AS (SELECT start, sum(band * n)::DOUBLE / sum(n)::DOUBLE / 3.0::DOUBLE AS mass FROM h GROUP BY start), b AS (SELECT *, lag(mass) OVER (ORDER BY start) AS before FROM m) SELECT CAST(epoch(start) AS BIGINT) AS start, mass, CASE WHEN mass - before > 0.02::DOUBLE THEN 'up' WHEN mass - before < -0.02::DOUBLE THEN 'down' ELSE 'stable' END AS shift FROM b")
def shift_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = temporal.shift_histogram(table(spark, sf_dir, "events"), "ts", "value", "1 day", _EDGES)
    s = temporal.shift_detect(h, 4, 0.02)
    return s.select(F.unix_timestamp("start").alias("start"), "mass", "shift")


@query(f"WITH {_HIST} SELECT CAST(epoch(start) AS BIGINT) AS start, band, n FROM h")
def shift_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram as a stream with a watermark, run over what is there; complete mode."""
    batch = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    windows = shift.shift_windows(stream, "ts", "value", "1 day", _EDGES, "1 day")
    base = shared_folder(spark)
    out = shift.run_available(windows, "complete", f"{base}/stream-{uuid.uuid4().hex}")
    return out.withColumn("start", F.unix_timestamp("start"))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, count(*) AS n, round(avg(value), 4)::DOUBLE AS mean, min(value) AS min, max(value) AS max, max(CASE WHEN rn = n * 25 // 100 THEN value END) AS p25, max(CASE WHEN rn = n * 50 // 100 THEN value END) AS p50, max(CASE WHEN rn = n * 75 // 100 THEN value END) AS p75 FROM r GROUP BY event_type")
def cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.profile(table(spark, sf_dir, "events"), ["event_type"], "value").drop("std").withColumn("mean", rounded("mean", 4))

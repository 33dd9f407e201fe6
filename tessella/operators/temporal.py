"""Ordered series: running sums, lagged comparisons, differences of states, shifts between windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits
from ._cut import stored


def running_sum(df: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    """df plus cumsum, the sum of each key's values up to the row. A key is one task's work; where one
    may be very long use running_sum_split."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumsum", F.sum(value).over(w))


def running_sum_split(df: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    """running_sum for keys of any length: rows are dealt by ranges of (key, order), so a long key has
    many ranges; each range is summed by itself and the sums of the ranges before it are added.

    The dealt rows are written once, so that both passes see the same ranges.
    """
    rows = stored(df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()), "running-ranges")
    sums = rows.groupBy(*by, "__range").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*by, "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0.0)).alias("__carry"))
    inside = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("cumsum", F.sum(value).over(inside)).join(carry, [*by, "__range"])
    return out.withColumn("cumsum", F.col("__carry") + F.col("cumsum")).select(*df.columns, "cumsum")


def granger_signal(df: DataFrame, a: str, b: str, tau: int, by: list[str], order: list[str], distance) -> DataFrame:
    """Mean over t of d(A_t, B_{t+tau}) - d(B_t, B_{t+tau}); 0 for a series not longer than tau."""
    later = F.lead(b, tau).over(Window.partitionBy(*by).orderBy(*order))
    rows = df.withColumn("later", later)
    signal = F.avg(F.when(F.col("later").isNotNull(), distance(F.col(a), F.col("later")) - distance(F.col(b), F.col("later"))))
    return rows.groupBy(*by).agg(F.coalesce(signal, F.lit(0.0)).alias("signal"))


def granger_scan(df: DataFrame, a: str, b: str, max_lag: int, by: list[str], order: list[str], distance) -> DataFrame:
    """The lag from 1 to max_lag of least signal, the shorter among equals. One window serves all lags."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumns({f"l{t}": F.lead(b, t).over(w) for t in range(1, max_lag + 1)})

    def signal(t: int) -> Column:
        later = F.col(f"l{t}")
        return F.coalesce(F.avg(F.when(later.isNotNull(), distance(F.col(a), later) - distance(F.col(b), later))), F.lit(0.0))

    lags = [F.struct(signal(t).alias("signal"), F.lit(t).alias("lag")) for t in range(1, max_lag + 1)]
    best = rows.groupBy(*by).agg(*(x.alias(f"s{i}") for i, x in enumerate(lags)))
    least = F.array_min(F.array(*(F.col(f"s{i}") for i in range(max_lag))))
    return best.withColumn("best", least).select(*by, F.col("best.lag").alias("lag"), F.col("best.signal").alias("signal"))


def state_diff(df: DataFrame, fp: str, lanes: int, by: list[str], order: str, back: int = 2) -> DataFrame:
    """XOR with the state `back` steps before, as diff and changed bits; the first steps have none."""
    was = F.lag(fp, back).over(Window.partitionBy(*by).orderBy(order))
    rows = df.withColumn("was", was).where("was is not null")
    diff = [F.col(fp)[i].bitwiseXOR(F.col("was")[i]) for i in range(lanes)]
    changed = sum((F.bit_count(x).cast("long") for x in diff), F.lit(0).cast("long"))
    return rows.withColumn("diff", F.array(*diff)).withColumn("changed", changed).drop("was")


def causal_arrow(changed: Column, bits: int) -> Column:
    """struct<stability, forward, backward, arrow> from the number of changed bits.

    Fixed values: slopes 1 and .25, ratios .7 and .3, sum .5.
    """
    stability = 1.0 - 2.0 * changed / F.lit(float(bits))
    slope = lambda x: F.abs(F.when(x >= 0, x).otherwise(x * 0.25))
    forward, backward = slope(stability), slope(-stability)
    ratio = F.coalesce(F.try_divide(forward, forward + backward), F.lit(0.5))
    arrow = F.when(ratio > 0.7, "forward").when(ratio < 0.3, "backward").when(forward + backward > 0.5, "contested").otherwise("symmetric")
    return F.struct(stability.alias("stability"), forward.alias("forward"), backward.alias("backward"), arrow.alias("arrow"))


def transitions(df: DataFrame, key: list[str], order: str, column: str) -> DataFrame:
    """Rows whose class differs from the one before, as (key, order, was, now)."""
    was = F.lag(column).over(Window.partitionBy(*key).orderBy(order))
    return df.withColumn("was", was).where(F.col("was").isNotNull() & (F.col("was") != F.col(column))).select(*key, order, "was", F.col(column).alias("now"))


def stripes(value: Column, edges: list[float]) -> Column:
    """Bin 0 below the first edge, one more for each edge reached."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))


def shift_histogram(df: DataFrame, ts: str, value: str, window: str, edges: list[float]) -> DataFrame:
    """(start, band, n): counts of bands in tumbling windows."""
    return df.groupBy(F.window(ts, window).alias("w"), stripes(F.col(value), edges).alias("band")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "band", "n")


def shift_detect(histogram: DataFrame, bands: int, limit: float = 0.15) -> DataFrame:
    """(start, mass, before, shift): the mean band of each window and whether it moved by more than limit."""
    mass = histogram.groupBy("start").agg((F.sum(F.col("band") * F.col("n")) / F.sum("n") / F.lit(float(max(1, bands - 1)))).alias("mass"))
    w = Window.orderBy("start")  # a row for each window of time, not for each event
    rows = mass.withColumn("before", F.lag("mass").over(w))
    moved = F.col("mass") - F.col("before")
    return rows.withColumn("shift", F.when(moved > limit, "up").when(moved < -limit, "down").otherwise("stable"))


def ewm_correction(states: DataFrame, key: list[str], order: str, fp: str, words: int, width: int = 64) -> DataFrame:
    """(key, order, correction, total, tier): for each state the bits of each word that changed since
    the one before, their sum, and its tier by deviations (a small change is a rare one)."""
    before = F.lag(fp).over(Window.partitionBy(*key).orderBy(order))
    rows = states.withColumn("before", before).where(F.col("before").isNotNull())
    changed = F.array(*(F.bit_count(F.col(fp)[i].bitwiseXOR(F.col("before")[i])).cast("long") for i in range(words)))
    rows = rows.withColumn("correction", changed).withColumn("total", F.aggregate("correction", F.lit(0).cast("long"), lambda a, x: a + x))
    return rows.select(*key, order, "correction", "total", bits.sigma_score(F.col("total"), words * width)["tier"].alias("tier"))


def causal_links(activity: DataFrame, key: list[str], order: str, planes: dict[str, str], n_bits: int) -> DataFrame:
    """(key, order, cause, effect, confidence): a plane whose activity falls to less than half between
    two successive rows is the cause of one whose activity grows to more than twice as much."""
    w = Window.partitionBy(*key).orderBy(order)
    rows = activity.select(*key, order, *(F.col(c).alias(f"early_{p}") for p, c in planes.items()), *(F.lead(c).over(w).alias(f"late_{p}") for p, c in planes.items()))
    falls = lambda p: F.col(f"early_{p}") > 2 * F.col(f"late_{p}")
    grows = lambda p: F.col(f"late_{p}") > 2 * F.col(f"early_{p}")
    link = lambda a, b: F.when(falls(a) & grows(b), F.struct(F.lit(a).alias("cause"), F.lit(b).alias("effect"), (F.col(f"early_{a}") / F.lit(float(n_bits))).alias("confidence")))
    links = F.array(*(link(a, b) for a in planes for b in planes if a != b))
    return rows.select(*key, order, F.inline(F.filter(links, lambda e: e.isNotNull())))


def saliency(corrections: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, word, first, last, turns, trend) of ewm_correction's rows: `contested` where a word's
    corrections turn twice or more, `crystallizing` where they fall by more than 2, `dissolving` where
    they grow by more than 2, else `steady`. Keys with a single correction have no row."""
    long = corrections.select(*key, order, F.posexplode("correction").alias("word", "value"))
    w = Window.partitionBy(*key, "word").orderBy(order)
    rows = long.withColumn("p", F.lag("value", 1).over(w)).withColumn("q", F.lag("value", 2).over(w))
    turned = (F.col("value") != F.col("p")) & ((F.col("value") > F.col("p")) != (F.col("p") > F.col("q")))
    out = rows.groupBy(*key, "word").agg(
        F.min_by("value", order).alias("first"), F.max_by("value", order).alias("last"), F.count_if(turned).alias("turns"), F.count("*").alias("n")
    ).where("n > 1").drop("n")
    trend = F.when(F.col("turns") >= 2, "contested").when(F.col("last") + 2 < F.col("first"), "crystallizing").when(F.col("last") > F.col("first") + 2, "dissolving")
    return out.withColumn("trend", trend.otherwise("steady"))

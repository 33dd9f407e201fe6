"""Statistics over tables: axis reductions, rank correlation, co-occurrence, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_form(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, j, v) of array rows."""
    return df.select(F.col(id_col).alias("i"), F.posexplode(vector).alias("j", "v")).withColumn("v", F.col("v").cast("double"))


def column_stats(df: DataFrame, vector: str) -> DataFrame:
    """(j, mean, min, max, var, std) over the rows for each position: summed by position before the
    shuffle, so a task sends one row for each."""
    v = F.col("v").cast("double")
    long = df.select(F.posexplode(vector).alias("j", "v"))
    return long.groupBy("j").agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.var_pop(v).alias("var"), F.stddev_pop(v).alias("std"))


def first_extreme(df: DataFrame, by: list[str], id_col: str, value: str, largest: bool = True) -> DataFrame:
    """(by, id, value): the row of largest or least value, the smaller id among equals."""
    pick = F.max_by if largest else F.min_by
    order = F.struct(F.col(value), -F.col(id_col)) if largest else F.struct(F.col(value), F.col(id_col))
    return df.groupBy(*by).agg(pick(F.struct(F.col(id_col).alias("id"), F.col(value).alias("value")), order).alias("e")).select(*by, "e.id", "e.value")


def kendall_tau(df: DataFrame, by: list[str], a: str, b: str, item: str) -> DataFrame:
    """(concordant - discordant) / pairs within each group; equal signs, both 0 included, agree.

    Pairs are the statistic itself; groups are lists of ranked items. Each pair is made once.
    """
    keep = [F.col(c) for c in by]
    left = df.select(*keep, F.col(item).alias("p"), F.col(a).alias("pa"), F.col(b).alias("pb"))
    right = df.select(*keep, F.col(item).alias("q"), F.col(a).alias("qa"), F.col(b).alias("qb"))
    pairs = left.join(right, by).where("p < q")
    agree = F.signum(F.col("pa") - F.col("qa")) == F.signum(F.col("pb") - F.col("qb"))
    return pairs.groupBy(*by).agg((F.sum(F.when(agree, 1).otherwise(-1)) / F.count("*")).alias("tau"))


def ranks(df: DataFrame, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def spearman_footrule(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Sum of rank differences over its maximum, n^2 / 2 (floor)."""
    return df.groupBy(*by).agg((F.sum(F.abs(F.col(a) - F.col(b))) / F.greatest(F.lit(1), F.floor(F.count("*") * F.count("*") / 2))).alias("footrule"))


def cooccurrence(df: DataFrame, sequence: list[str], order: str, item: str, reach: int) -> DataFrame:
    """(i, j, n, score): pairs i < j of items at most `reach` steps apart, with n / sqrt(total_i total_j).

    Neighbours come from lead(), so the rows made are `reach` times the input, whatever the groups.
    """
    w = Window.partitionBy(*sequence).orderBy(order)
    rows = df.select(F.col(item).alias("x"), F.array(*(F.lead(item, k).over(w) for k in range(1, reach + 1))).alias("ys"))
    pairs = rows.select("x", F.explode("ys").alias("y")).where("y is not null and x <> y")
    counts = pairs.groupBy(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).agg(F.count("*").alias("n"))
    ends = counts.select(F.col("i").alias("item"), "n").unionByName(counts.select(F.col("j").alias("item"), "n")).groupBy("item").agg(F.sum("n").alias("total"))
    one, two = ends.select(F.col("item").alias("i"), F.col("total").alias("ti")), ends.select(F.col("item").alias("j"), F.col("total").alias("tj"))
    return counts.join(one, "i").join(two, "j").select("i", "j", "n", (F.col("n") / F.sqrt(F.col("ti").cast("double") * F.col("tj"))).alias("score"))


def values_at(df: DataFrame, by: list[str], value: str, ranks: DataFrame, buckets: int = 32) -> DataFrame:
    """(by, tag, value): the values that stand at given ranks (from 0) of each group in ascending order.

    ranks: (by, tag, rank), a few rows for each group. No group is sorted in one task: a sketch of
    each group, merged from all tasks, cuts its values into buckets; rows are counted by bucket;
    only the buckets that hold a wanted rank are ordered, each for itself. Exact whatever the
    sketch says. Null values do not count; values that are all equal stay in one bucket.
    """
    rows = df.select(*by, F.col(value).alias("value")).where("value is not null")
    cuts = rows.groupBy(*by).agg(F.percentile_approx("value", [i / buckets for i in range(1, buckets)], 1000).alias("cuts"))
    placed = rows.join(cuts, by).withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*by, "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    wanted = counts.join(ranks, by).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
    wanted = wanted.select(*by, "bucket", "tag", (F.col("rank") - F.col("before") + 1).alias("place"))
    held = placed.join(wanted.select(*by, "bucket").distinct(), [*by, "bucket"], "left_semi")
    ordered = held.withColumn("place", F.row_number().over(Window.partitionBy(*by, "bucket").orderBy("value")))
    return ordered.join(wanted, [*by, "bucket", "place"]).select(*by, "tag", "value")


def quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """(by, a column for each name in probs): quantiles with linear interpolation on (n - 1) p."""
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"))
    at = lambda name, p, fn: F.struct(F.concat(F.lit(name), F.lit("<" if fn is F.floor else ">")).alias("tag"), fn((F.col("n") - 1) * F.lit(p)).alias("rank"))
    ranks = sizes.select(*by, F.inline(F.array(*(at(k, p, fn) for k, p in probs.items() for fn in (F.floor, F.ceil)))))
    found = values_at(df, by, value, ranks).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("tag", "value"))).alias("at"))

    def between(name: str, p: float) -> Column:
        low, high, rank = F.col("at")[name + "<"], F.col("at")[name + ">"], (F.col("n") - 1) * F.lit(p)
        return (low + (high - low) * (rank - F.floor(rank))).alias(name)

    return sizes.join(found, by).select(*by, *(between(k, p) for k, p in probs.items()))


def profile(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, deviation, least, largest and quartiles; the quartiles are the values at index n q / 100, not interpolated.

    The values are found by counting (values_at), so no group is gathered or sorted in one task.
    """
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    at = lambda q: F.struct(F.lit(f"p{q}").alias("tag"), F.least(F.col("n") - 1, F.floor(F.col("n") * q / 100)).alias("rank"))
    ranks = sums.select(*by, F.inline(F.array(at(25), at(50), at(75))))
    found = values_at(df, by, value, ranks).groupBy(*by).agg(*(F.max(F.when(F.col("tag") == t, F.col("value"))).alias(t) for t in ("p25", "p50", "p75")))
    return sums.join(found, by, "left")

"""Places of rows in one order over the whole table, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._cut import stored


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df written by ranges of its order, plus __range and __row, the place within it.

    Rows should differ in `order`, so that a task that is run again deals the same places.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    return stored(rows, "ranged").withColumns({"__range": F.shiftrightunsigned("__at", 33).cast("int"), "__row": F.col("__at").bitwiseAND((1 << 33) - 1)}).drop("__at")


def _before(ranges: DataFrame, value, name: str) -> DataFrame:
    """The aggregate of `value` over all ranges before: a row for each range, so one task is enough."""
    return ranges.select("__range", value.over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias(name))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df plus rank, from 0, in that order."""
    rows = ranged(df, *order)
    sizes = _before(rows.groupBy("__range").agg(F.count("*").alias("n")), F.sum("n"), "__first")
    out = rows.join(F.broadcast(sizes), "__range")
    return out.withColumn("rank", F.coalesce("__first", F.lit(0)) + F.col("__row")).drop("__range", "__row", "__first")


def running_max(df: DataFrame, value: str, *order: str) -> DataFrame:
    """df with `value` replaced by its largest so far in that order, its own row included."""
    rows = ranged(df, *order)
    tops = _before(rows.groupBy("__range").agg(F.max(value).alias("m")), F.max("m"), "__top")
    here = F.max(value).over(Window.partitionBy("__range").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn(value, here).join(F.broadcast(tops), "__range")
    return out.withColumn(value, F.greatest(value, "__top")).drop("__range", "__row", "__top")

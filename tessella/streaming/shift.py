"""Structured Streaming twins of the windowed and stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.temporal import stripes


def shift_windows(events: DataFrame, ts: str, value: str, window: str, edges: list[float], late: str) -> DataFrame:
    """A stream's (start, band, n): counts of bands in tumbling windows, late rows up to `late`."""
    rows = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), stripes(F.col(value), edges).alias("band"))
    return rows.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "band", "n")


def soak(events: DataFrame, key: str, order: str, value: str, limit: int = 127) -> DataFrame:
    """A stream's (key, level, n): a saturating sum of rounded values for each key, kept as state and
    updated in `order` within each batch."""
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, n = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(order)
        for v in rows[value]:
            level, n = max(-limit - 1, min(limit, level + int(round(v)))), n + 1
        state.update((level, n))
        yield pd.DataFrame({key: [k[0]], "level": [level], "n": [n]})

    return events.select(key, order, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, level long, n long", "level long, n long", "update", GroupStateTimeout.NoTimeout)


def normalize(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """A stream's (key, order, value, out): values less a running mean over a running deviation.

    Fixed values: mean += .1 d, var = .9 var + .1 d^2 with d against the old mean, eps 1e-5.
    """
    kind, when = events.schema[key].dataType.simpleString(), events.schema[order].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, var = state.get if state.exists else (0.0, 1.0)
        rows, out = pd.concat(list(batches)).sort_values(order), []
        for v in rows[value]:
            d = v - mean
            mean, var = mean + 0.1 * d, 0.9 * var + 0.1 * d * d
            out.append((v - mean) / (var + 1e-5) ** 0.5)
        state.update((mean, var))
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), value: rows[value].to_numpy(), "out": out})

    return events.select(key, order, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {order} {when}, {value} double, out double", "mean double, var double", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now into Parquet beside its checkpoint, and reads that.

    Each micro-batch has a folder of its own, so one that is run again replaces itself; in complete
    mode the latest replaces all. Nothing of the result passes through the driver.
    """
    path = f"{checkpoint}-rows"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    if not query.recentProgress:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/*")

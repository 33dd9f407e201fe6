"""Trajectories of states, recorded in order from a stream that is not, and the gate that each ends with."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import bits

PLANES = ("s", "p", "o")
#: A plane has settled if at most so many bits change; a plane is contested if more words than this go back.
SETTLED, CONTESTED = 100, 10
COUNTS = ["n", "supports", "undermines", "contradicts", "gate"]


def _gate(converged, supports, undermines, contradicts):
    """Flow if it has settled and more speaks for it than against, block if more planes are contested
    than steps support it, hold otherwise; columns or numbers."""
    return (F.when(converged & (supports > undermines + contradicts), "flow").when(contradicts > supports, "block").otherwise("hold")
            if not isinstance(converged, (bool, np.bool_)) else
            "flow" if converged and supports > undermines + contradicts else "block" if contradicts > supports else "hold")


def gates(df: DataFrame, lanes: int, settled: int = SETTLED, contested: int = CONTESTED) -> DataFrame:
    """(key, n, supports, undermines, contradicts, gate) of whole trajectories (key, iter, s, p, o), each
    plane an array of `lanes` words.

    From one iteration to the next, in order of iter, a plane has settled if `settled` bits at most
    change; a step with more settled planes than the step before supports, one with fewer
    undermines. A word that returns to its value of two iterations ago is contested; planes with
    more than `contested` of them contradict. converged means that the last step has settled in all
    planes. Repeated iterations count once (the least planes); null keys and iterations are left out.
    """
    rows = df.where("key is not null and iter is not null").groupBy("key", "iter").agg(F.min(F.struct(*PLANES)).alias("x")).select("key", "iter", "x.*")
    by = Window.partitionBy("key").orderBy("iter")
    steps = rows.withColumns({f"{c}{k}": F.lag(c, k).over(by) for c in PLANES for k in (1, 2)}).withColumn("at", F.row_number().over(by))
    for c in PLANES:
        back = lambda i, c=c: ((F.col(c)[i] == F.col(f"{c}2")[i]) & (F.col(c)[i] != F.col(f"{c}1")[i])).cast("int")
        steps = steps.withColumns({f"settled_{c}": bits.hamming(c, f"{c}1", lanes) <= settled, f"back_{c}": sum((F.coalesce(back(i), F.lit(0)) for i in range(lanes)), F.lit(0))})
    level = sum((F.col(f"settled_{c}").cast("int") for c in PLANES), F.lit(0))
    steps = steps.withColumn("level", level).withColumn("before", F.lag("level").over(by))
    sums = steps.groupBy("key").agg(
        F.count("*").alias("n"), F.count_if(F.col("level") > F.col("before")).alias("supports"), F.count_if(F.col("level") < F.col("before")).alias("undermines"),
        *(F.sum(f"back_{c}").alias(f"back_{c}") for c in PLANES), F.max_by("level", "iter").alias("last"),
    )
    contradicts = sum(((F.col(f"back_{c}") > contested).cast("long") for c in PLANES), F.lit(0).cast("long"))
    sums = sums.withColumn("contradicts", contradicts)
    converged = F.coalesce(F.col("last") == len(PLANES), F.lit(False))
    return sums.withColumn("gate", _gate(converged, F.col("supports"), F.col("undermines"), F.col("contradicts"))).select("key", *COUNTS)


_WORDS = ArrayType(LongType())
_SNAPSHOT = StructType([StructField("iter", LongType()), *(StructField(c, _WORDS) for c in PLANES)])
_PROGRESS = StructType([StructField(c, LongType()) for c in ("n", "supports", "undermines", "level", "b0", "b1", "b2", "iter")])


class Recorder(StatefulProcessor):
    """A trajectory's snapshots wait in a list until the watermark has passed them; then they are taken
    in order. When nothing has come for `idle_ms` of event time, the gate is told and the state goes.

    The state holds what has not been passed yet, the last two snapshots and eight numbers.
    """

    def __init__(self, idle_ms: int, settled: int = SETTLED, contested: int = CONTESTED):
        self.idle_ms, self.settled, self.contested = idle_ms, settled, contested

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([StructField("ms", LongType()), *_SNAPSHOT.fields]))
        self.recent = handle.getListState("recent", _SNAPSHOT)
        self.progress = handle.getValueState("progress", _PROGRESS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, latest = timerValues.getCurrentWatermarkInMs(), 0
        for b in rows:
            for r in b.itertuples(index=False):
                if pd.isna(r.iter):
                    continue
                ms = int(pd.Timestamp(r.ts).value // 1_000_000)
                self.waiting.appendValue((ms, int(r.iter), *([int(x) for x in getattr(r, c)] for c in PLANES)))
                latest = max(latest, ms)
        if latest:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            last = max(w[0] for w in self.waiting.get())
            self.handle.registerTimer(max(last, mark) + self.idle_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._take(timerValues.getCurrentWatermarkInMs())
        if self.waiting.exists():  # rows that came with the timer and are later than the watermark
            last = max(w[0] for w in self.waiting.get())
            self.handle.registerTimer(last + self.idle_ms)
            return iter(())
        n, supports, undermines, level, *back, _ = self.progress.get() if self.progress.exists() else (0, 0, 0, -1, 0, 0, 0, -1)
        contradicts = sum(x > self.contested for x in back)
        self.waiting.clear()
        self.recent.clear()
        self.progress.clear()
        row = (key[0], n, supports, undermines, contradicts, _gate(level == len(PLANES), supports, undermines, contradicts))
        return iter([pd.DataFrame({c: pd.Series([x], dtype=object) for c, x in zip(("key", *COUNTS), row, strict=True)})])

    def _take(self, mark: int) -> None:
        """The waiting snapshots that the watermark has passed, in order."""
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted({(int(r[1]), *(tuple(map(int, x)) for x in r[2:])) for r in rows if r[0] <= mark})
        left = [r for r in rows if r[0] > mark]
        recent = [(int(r[0]), *(tuple(map(int, x)) for x in r[1:])) for r in self.recent.get()] if self.recent.exists() else []
        n, supports, undermines, level, *back, last = map(int, self.progress.get()) if self.progress.exists() else (0, 0, 0, -1, 0, 0, 0, -1)
        for snap in ready:
            if n and snap[0] <= last:
                continue  # an iteration that is there already
            if recent:
                change = [np.bitwise_xor(np.array(a, np.int64), np.array(b, np.int64)) for a, b in zip(snap[1:], recent[-1][1:], strict=True)]
                now = sum(int(np.bitwise_count(c.view(np.uint64)).sum()) <= self.settled for c in change)
                if level >= 0:
                    supports, undermines = supports + (now > level), undermines + (now < level)
                level = now
                if len(recent) == 2:
                    for i, c in enumerate(change):
                        same = np.array(snap[1 + i], np.int64) == np.array(recent[0][1 + i], np.int64)
                        back[i] += int((same & (c != 0)).sum())
            recent, n, last = [*recent[-1:], snap], n + 1, snap[0]
        if left:
            self.waiting.put([tuple(r) for r in left])
        else:
            self.waiting.clear()
        if recent:
            self.recent.put([(r[0], *(list(x) for x in r[1:])) for r in recent])
        if n:
            self.progress.update((n, int(supports), int(undermines), level, *back, last))

    def close(self) -> None:
        pass


def record(stream: DataFrame, delay: str = "1 minute", idle: str = "5 minutes", key: str = "string", settled: int = SETTLED, contested: int = CONTESTED) -> DataFrame:
    """The same counts and gates as `gates`, from a stream (key, ts, iter, s, p, o) in any order within
    the delay. A trajectory ends when no row of it has come for `idle` of event time; then its row is
    told once. Rows later than the delay are left out, as the watermark has it.
    """
    kinds = {"string": StringType(), "long": LongType(), "int": IntegerType()}
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    out = StructType([StructField("key", kinds[key]), *(StructField(c, LongType()) for c in COUNTS[:-1]), StructField("gate", StringType())])
    rows = stream.where("key is not null").select("key", "ts", "iter", *PLANES).withWatermark("ts", delay)
    return rows.groupBy("key").transformWithStateInPandas(Recorder(ms, settled, contested), outputStructType=out, outputMode="Append", timeMode="EventTime")

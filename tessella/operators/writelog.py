"""A log of writes into containers: appended by batches, replayed from a snapshot, compacted.

A log is a folder (see _versions) of segments. A batch belongs to it once its manifest is there; a
batch that a writer sends again counts once, and one whose writer was killed before that is not there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _versions

#: Plasticity by number of writes (up to and with the first), and of what was not written lately.
CURVE = ((2, 0.5), (5, 0.8), (20, 1.0), (50, 0.5), (200, 0.2))
ANCIENT, DECAYED = 0.1, 0.3
ORDER = ["segment", "seq", "concept", "amplitude"]
STATE = "cells array<int>, coefficients array<double>, counts array<long>, last array<long>, clock long"


def append(df: DataFrame, path: str, writer: str, batch: int, tries: int = 20) -> int:
    """Add a batch (key, seq, concept, amplitude) of a writer; returns the version that holds it.

    Batches of a writer are numbered upwards; one that is not above the writer's last is there
    already and changes nothing. Another writer's commit in between is no conflict: this one's
    manifest is made anew after it.
    """
    spark, name = df.sparkSession, None
    for _ in range(tries):
        version, m = _versions.read(spark, path)
        m = m or {"snapshot": None, "segments": [], "writers": {}, "next": 0}
        if m["writers"].get(writer, -1) >= batch:
            return version
        name = name or _versions.write(df.select("key", "seq", "concept", F.col("amplitude").cast("double").alias("amplitude")), path, "segment")
        one = {"name": name, "no": m["next"]}
        try:
            return _versions.commit(spark, path, version, m | {"segments": [*m["segments"], one], "writers": m["writers"] | {writer: batch}, "next": m["next"] + 1})
        except RuntimeError:
            continue
    raise RuntimeError(f"no turn to write to {path} in {tries} tries")


def writes(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """(key, segment, seq, concept, amplitude) since the snapshot; None for a log without any."""
    _, m = _versions.read(spark, path, version)
    out = None
    for s in m.get("segments", []):
        one = _versions.table(spark, path, s["name"]).select("key", F.lit(s["no"]).alias("segment"), "seq", "concept", "amplitude")
        out = one if out is None else out.unionByName(one)
    return out


def plasticity(count: Column) -> Column:
    """The multiplier of a concept that was just written for the count-th time."""
    out = F.lit(ANCIENT)
    for upto, value in reversed(CURVE):
        out = F.when(count <= upto, value).otherwise(out)
    return out


def with_plasticity(log: DataFrame, key: str = "key", concept: str = "concept", order: list[str] | None = None) -> DataFrame:
    """log plus clock (the container's writes so far), count (the concept's among them) and plasticity."""
    order = order or ORDER
    clock = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    count = F.row_number().over(Window.partitionBy(key, concept).orderBy(*order))
    return log.withColumns({"clock": clock.cast("long"), "count": count.cast("long")}).withColumn("plasticity", plasticity(F.col("count")))


@dataclass(frozen=True)
class Concepts:
    """Templates by concept number (rows of `templates`), each freed of the others in turn, what was
    taken away, and the positions that each may write: those of its channel."""

    templates: np.ndarray
    orthogonal: np.ndarray
    projections: np.ndarray
    positions: list[np.ndarray]

    @staticmethod
    def of(templates: np.ndarray, channels: int) -> Concepts:
        t = np.asarray(templates, float)
        norms = (t * t).sum(axis=1)
        free, taken = t.copy(), np.zeros((len(t), len(t)))
        for c in range(len(t)):
            for i in range(len(t)):
                if i != c and norms[i] >= 1e-10:
                    taken[c, i] = free[c] @ t[i] / norms[i]
                    free[c] -= taken[c, i] * t[i]
        at = [np.flatnonzero(np.arange(t.shape[1]) % channels == c % channels) for c in range(len(t))]
        return Concepts(t, free, taken, at)


class _Container:
    """One container's state: cells, coefficients and the counts that plasticity needs."""

    def __init__(self, concepts: Concepts, rate: float, decay: int, saved=None):
        self.of, self.rate, self.decay, k = concepts, rate, decay, len(concepts.templates)
        self.cells, self.coefficients = np.zeros(concepts.templates.shape[1], np.int64), np.zeros(k)
        self.counts, self.last, self.clock = np.zeros(k, np.int64), np.zeros(k, np.int64), 0
        if saved is not None:
            self.cells, self.coefficients, self.counts, self.last = (np.array(saved[c]) for c in ("cells", "coefficients", "counts", "last"))
            self.clock = int(saved["clock"])

    def plastic(self) -> np.ndarray:
        out = np.full(len(self.counts), ANCIENT)
        for upto, value in reversed(CURVE):
            out[self.counts <= upto] = value
        out[self.clock - self.last > self.decay] = DECAYED
        return out

    def write(self, concept: int, amplitude: float) -> float:
        self.clock += 1
        self.counts[concept] += 1
        self.last[concept] = self.clock
        plastic, at = self.plastic(), self.of.positions[concept]
        amplitude *= plastic[concept]
        full = amplitude * self.of.orthogonal[concept][at]
        real = full * (1 - np.abs(self.cells[at]) / 127.0)
        moved = self.cells[at] + real
        self.cells[at] = np.clip(np.trunc(moved + np.copysign(0.5, moved)), -128, 127).astype(np.int64)
        total = np.abs(full).sum()
        absorbed = float(np.abs(real).sum() / total) if total > 1e-10 else 1.0
        gain = self.rate * plastic * self.of.projections[concept]
        gain[concept] = amplitude * absorbed
        self.coefficients += gain
        return absorbed


def replay(spark: SparkSession, path: str, templates: list[list[int]], channels: int = 4, rate: float = 0.1, decay: int = 100, each: bool = False, version: int | None = None) -> DataFrame:
    """Each container's state (key, cells, coefficients, counts, last, clock) after all writes, from
    the snapshot on; with `each`, instead (key, clock, concept, absorption) of every write since it.

    templates[c] is concept c's (a fixed small list). A write frees its template of all others (in
    turn), adds it to the cells of its channel as far as these have room, times amplitude and
    plasticity, and moves the coefficients by what was taken away. Writes of one container are one
    sequence, so each is one pass over sorted rows that holds one container's state only, however
    many writes it has. Writes of unknown concepts and with nulls are left out.
    """
    _, m = _versions.read(spark, path, version)
    log = writes(spark, path, version)
    saved = _versions.table(spark, path, m["snapshot"]) if m.get("snapshot") else None
    if log is None and saved is None:
        raise ValueError(f"{path} has no writes")
    fields = [f.strip().split(" ", 1) for f in STATE.split(", ")]
    rows = None
    if log is not None:
        rows = log.where(F.col("key").isNotNull() & F.col("amplitude").isNotNull() & F.col("concept").between(0, len(templates) - 1)).select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in fields))
    if saved is not None:
        old = saved.select("key", F.lit(-1).alias("segment"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("int").alias("concept"), F.lit(None).cast("double").alias("amplitude"), *(c for c, _ in fields))
        rows = old if rows is None else rows.unionByName(old)
    kind = rows.schema["key"].dataType.simpleString()
    rows = rows.repartition("key").sortWithinPartitions("key", *ORDER)
    concepts, names = Concepts.of(np.array(templates), channels), [c for c, _ in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                if state is None or r["key"] != now:
                    if state is not None and not each:
                        out.append((now, *(getattr(state, c) for c in names)))
                    now, state = r["key"], _Container(concepts, rate, decay, r if r["segment"] < 0 else None)
                    if r["segment"] < 0:
                        continue
                absorbed = state.write(int(r["concept"]), float(r["amplitude"]))
                if each:
                    out.append((now, state.clock, int(r["concept"]), absorbed))
            yield pd.DataFrame(out, columns=["key", "clock", "concept", "absorption"] if each else ["key", *names])
        if state is not None and not each:
            yield pd.DataFrame([(now, *(getattr(state, c) for c in names))], columns=["key", *names])

    return rows.mapInPandas(run, f"key {kind}, clock long, concept int, absorption double" if each else f"key {kind}, {STATE}")


def compact(spark: SparkSession, path: str, templates: list[list[int]], **how) -> int:
    """Replay into a snapshot, which stands for all segments from now on. Older versions stay readable;
    writers that send a batch again are still known."""
    version, m = _versions.read(spark, path)
    name = _versions.write(replay(spark, path, templates, **how), path, "snapshot")
    return _versions.commit(spark, path, version, m | {"snapshot": name, "segments": []})


def absorption_actions(each: DataFrame, window: int = 16) -> DataFrame:
    """each (key, clock, absorption) plus average and least of the last `window` writes and the action
    they call for: emergency under 0.1 at least, hard under 0.4 on average, soft under 0.7."""
    recent = Window.partitionBy("key").orderBy("clock").rowsBetween(1 - window, 0)
    out = each.withColumns({"average": F.avg("absorption").over(recent), "least": F.min("absorption").over(recent)})
    return out.withColumn("action", F.when(F.col("least") < 0.1, "emergency").when(F.col("average") < 0.4, "hard").when(F.col("average") < 0.7, "soft").otherwise("none"))


def residual(states: DataFrame, templates: list[list[int]], channels: int = 4) -> DataFrame:
    """(key, position, value): each cell less what the coefficients say that the concepts of its channel put there."""
    spark = states.sparkSession
    known = spark.createDataFrame([(c, p, float(x)) for c, t in enumerate(templates) for p, x in enumerate(t) if p % channels == c % channels and x], "concept int, position int, x double")
    cells = states.select("key", F.posexplode("cells").alias("position", "cell"))
    weights = states.select("key", F.posexplode("coefficients").alias("concept", "w"))
    put = weights.join(F.broadcast(known), "concept").groupBy("key", "position").agg(F.sum(F.col("w") * F.col("x")).alias("put"))
    return cells.join(put, ["key", "position"], "left").select("key", "position", (F.col("cell") - F.coalesce("put", F.lit(0.0))).alias("value"))

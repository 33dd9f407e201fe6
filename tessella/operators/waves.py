"""Carriers in signed-byte containers of 2,048 samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLES, AMPLITUDE = 2048, 7.0
#: Containers that are worked on at once: what a task holds beside its batch does not grow with the batch.
ROWS = 256
#: Fixed carrier frequencies, in cycles a container.
FREQUENCIES = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1024)


def basis() -> tuple[np.ndarray, np.ndarray]:
    """Rounded cosines and sines [16, 2048] of the carriers."""
    angle = 2 * np.pi * np.outer(FREQUENCIES, np.arange(SAMPLES)) / SAMPLES
    half_away = lambda x: np.sign(x) * np.floor(np.abs(x) + 0.5)
    return half_away(AMPLITUDE * np.cos(angle)), half_away(AMPLITUDE * np.sin(angle))


def write(df: DataFrame, id_col: str, container: str, carriers: list[tuple[int, float, float]]) -> DataFrame:
    """(id, container) with carriers (index, phase, amplitude) added in order, each sum saturating."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cos, sin = basis()
        for b in (whole.iloc[lo : lo + ROWS] for whole in batches for lo in range(0, len(whole), ROWS)):
            x = np.stack(b[container].to_numpy()).astype(float)
            for k, phase, amplitude in carriers:
                wave = (np.cos(phase) * cos[k] - np.sin(phase) * sin[k]) * (amplitude / AMPLITUDE)
                x = np.clip(x + np.clip(np.sign(wave) * np.floor(np.abs(wave) + 0.5), -128, 127), -128, 127)
            yield pd.DataFrame({"id": b[id_col], "container": list(x.astype(np.int32))})

    return df.select(id_col, container).mapInPandas(run, f"id {kind}, container array<int>")


def read(df: DataFrame, id_col: str, container: str) -> DataFrame:
    """(id, carrier, phase, amplitude) of every carrier: two products with the basis."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cos, sin = basis()
        for b in (whole.iloc[lo : lo + ROWS] for whole in batches for lo in range(0, len(whole), ROWS)):
            x = np.stack(b[container].to_numpy()).astype(float)
            c, s = x @ cos.T / SAMPLES, x @ sin.T / SAMPLES
            n = len(FREQUENCIES)
            yield pd.DataFrame({"id": np.repeat(b[id_col].to_numpy(), n), "carrier": np.tile(np.arange(n), len(b)), "phase": np.mod(np.arctan2(-s, c), 2 * np.pi).ravel(), "amplitude": np.hypot(c, s).ravel()})

    return df.select(id_col, container).mapInPandas(run, f"id {kind}, carrier int, phase double, amplitude double")


def saturating_sum(vectors: Column) -> Column:
    """array<array<int>> folded in order, every partial sum held to -128..127."""
    held = lambda x: F.least(F.lit(127), F.greatest(F.lit(-128), x))
    start = F.transform(F.get(vectors, F.lit(0)), lambda _: F.lit(0))
    return F.aggregate(vectors, start, lambda a, v: F.zip_with(a, v, lambda x, y: held(x + y)))

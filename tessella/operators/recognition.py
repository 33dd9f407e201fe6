"""Sign projections from seeded hyperplanes, and recognition of classes by templates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed thresholds of novelty: least projection, largest residual share.
NOVEL_PROJECTION, NOVEL_RESIDUAL = 0.15, 0.85


def splitmix64(seed: int, n: int) -> np.ndarray:
    """The first n values of the SplitMix64 generator; its state is an arithmetic series."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def uniform_planes(d: int, bits: int, seed: int) -> np.ndarray:
    """[d, bits] values in [-1, 1), row by row."""
    u = (splitmix64(seed, d * bits) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
    return (u * 2 - 1).reshape(d, bits)


def gaussian_planes(d: int, bits: int, seed: int) -> np.ndarray:
    """[d, bits] unit normal vectors, one for each bit (Box-Muller, two draws a value)."""
    f = (splitmix64(seed, 2 * d * bits) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    g = np.sqrt(-2 * np.log(np.maximum(f[0::2], 1e-15))) * np.cos(2 * np.pi * f[1::2])
    g = g.astype(np.float32).reshape(bits, d)
    return (g / np.maximum(np.sqrt((g * g).sum(axis=1, keepdims=True)), 1e-10)).T


def project(df: DataFrame, planes: np.ndarray, id_col: str, vector: str, msb_first: bool, strict: bool = False) -> DataFrame:
    """(id, fp binary): a bit for each plane, set where the dot product is >= 0 (> 0 if strict).

    One matrix product for each Arrow batch; the planes' size is a parameter, not the data's.
    """
    kind, order = df.schema[id_col].dataType.simpleString(), "big" if msb_first else "little"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                dots = np.stack(b[vector].to_numpy()).astype(np.float32) @ planes
                packed = np.packbits(dots > 0 if strict else dots >= 0, axis=1, bitorder=order)
                yield pd.DataFrame({"id": b[id_col], "fp": [r.tobytes() for r in packed]})

    return df.select(id_col, vector).mapInPandas(run, f"id {kind}, fp binary")


def recognize_orthogonal(df: DataFrame, templates: np.ndarray, id_col: str, vector: str) -> DataFrame:
    """(id, best, score, residual, novel): each vector is projected on the templates in order, each
    projection being taken off before the next; best is the largest coefficient by size.

    templates [classes, d] is a list of names' vectors, bounded like a codebook.
    """
    kind, norms = df.schema[id_col].dataType.simpleString(), (templates.astype(float) ** 2).sum(axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            rest = np.stack(b[vector].to_numpy()).astype(float)
            energy, scores = (rest**2).sum(axis=1), np.zeros((len(b), len(templates)))
            for i, (t, n) in enumerate(zip(templates, norms, strict=True)):
                if n >= 1e-10:
                    scores[:, i] = rest @ t / n
                    rest = rest - np.outer(scores[:, i], t)
            best = np.abs(scores).argmax(axis=1)
            score = scores[np.arange(len(b)), best]
            share = np.where(energy > 1e-10, (rest**2).sum(axis=1) / np.maximum(energy, 1e-10), 1.0)
            novel = (np.abs(score) < NOVEL_PROJECTION) | (share > NOVEL_RESIDUAL)
            yield pd.DataFrame({"id": b[id_col], "best": best, "score": score, "residual": share, "novel": novel})

    return df.select(id_col, vector).mapInPandas(run, f"id {kind}, best long, score double, residual double, novel boolean")


def recognize_hamming(prints: DataFrame, classes: list[bytes]) -> DataFrame:
    """(id, best, score) of projected vectors: the class print of most equal bits, (share - .5) * 2."""
    kind, book = prints.schema["id"].dataType.simpleString(), np.stack([np.frombuffer(c, np.uint8) for c in classes])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                fp = np.stack([np.frombuffer(x, np.uint8) for x in b["fp"]])
                far = np.stack([np.bitwise_count(fp ^ c).sum(axis=1) for c in book], axis=1)
                best = far.argmin(axis=1)
                share = 1 - far[np.arange(len(b)), best] / (8 * book.shape[1])
                yield pd.DataFrame({"id": b["id"], "best": best, "score": (share - 0.5) * 2})

    return prints.mapInPandas(run, f"id {kind}, best long, score double")

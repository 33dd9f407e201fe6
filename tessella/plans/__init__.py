"""Registered queries over the driver's tables, with their SQL."""

from __future__ import annotations

from . import arrays, fingerprints, graphs, hypervectors, learned, living, matrices, rows, searches, series, trees  # noqa: F401
from ._registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

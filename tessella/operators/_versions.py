"""Versions of a folder of tables: a manifest for each version, of which the last one counts.

Tables are written under names of their own and belong to a version only once its manifest is there,
so a writer that is killed leaves the version before as it was, and readers of an old version are
never disturbed. A version's manifest is made once: of two writers that start from one version, the
second one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ._cut import shared_folder


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    """The folder's versions, in order."""
    system, where = _system(spark, path)
    if not system.exists(where):
        return []
    names = (s.getPath().getName() for s in system.listStatus(where))
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def read(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    """A version and its manifest, the last one by default; (0, {}) for a folder without any."""
    found = versions(spark, path)
    if version is None and not found:
        return 0, {}
    version = found[-1] if version is None else version
    if version not in found:
        raise ValueError(f"{path} has no version {version}")
    text = "\n".join(r.value for r in spark.read.text(f"{path}/v{version:08d}.json").collect())  # one small file
    return version, json.loads(text)


def commit(spark: SparkSession, path: str, before: int, manifest: dict) -> int:
    """Make the version after `before`, which must still be the last one."""
    if (versions(spark, path) or [0])[-1] != before:
        raise RuntimeError(f"{path} has a version after {before} already")
    system, draft = _system(spark, f"{path}/draft-{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    final = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{before + 1:08d}.json")
    if system.exists(final) or not system.rename(draft, final):
        raise RuntimeError(f"{path} has a version after {before} already")
    return before + 1


def write(df: DataFrame, path: str, label: str) -> str:
    """df as Parquet in the folder; returns the table's name for a manifest."""
    name = f"{label}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    return name


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def new_folder(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, for an index or tree that only this job needs."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

"""Cutting lineage in iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only on a local master one is made where it is
    unset; on a cluster that raises, since executors could not read the driver's own folder."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame, label: str = "") -> DataFrame:
    """df checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: expressions are evaluated once,
    whatever is built on them, and scans of the result read only the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, rows: int = 1 << 20) -> DataFrame:
    """df dealt by its keys, about so many rows to a task: what a task holds of them does not grow with
    the table, whatever spark.sql.shuffle.partitions is. df is counted first."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)

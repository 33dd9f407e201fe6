"""Small helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_made: list[str] = []
_tidied = 0.0


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it, with its scheme: without
    one it is on Spark's default file system, for our own readers and writers as for Spark's.

    Only on a local master a temporary folder is made and set where that setting is absent; on a
    cluster that raises, since executors could not read the driver's own folder.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.getCheckpointDir():
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        base = context.getCheckpointDir()
    return _full(spark, base).rstrip("/")


def _full(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return "file://" + full.removeprefix("file:").removeprefix("//") if full.startswith("file:") else full


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark's own writers would read it, so that every executor opens
    the same place. A path without a scheme that falls on a local disk raises on a cluster: each
    executor would have a disk of its own. A `file:` that is written out is taken as a shared mount.
    """
    full = _full(spark, path)
    if full.startswith("file:") and not path.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{path} is on each machine's own disk; name a shared file system")
    return full


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified path, for Python's own reading and writing, and the place on it."""
    if path.startswith("file:///"):  # as it stands: Spark escapes nothing in it
        return pafs.LocalFileSystem(), path.removeprefix("file://")
    return pafs.FileSystem.from_uri(path)


def by_spark_only(path: str) -> bool:
    """Whether a qualified path is on a file system that Spark opens and Python does not (viewfs, s3a,
    hdfs without its native library)."""
    try:
        opened(path)
    except (ValueError, OSError, NotImplementedError):
        return True
    return False


def new_scratch(spark: SparkSession, label: str) -> str:
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there.

    A lost executor costs only the tasks that it ran; finished parts stay readable for all.
    """
    spark = df.sparkSession
    path = new_scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession, interval_s: float = 10.0) -> None:
    """Let Spark's cleaner drop the shuffle files and broadcasts of plans that are done.

    It finds them when the driver's memory is collected, which by itself happens late (or every
    spark.cleaner.periodicGC.interval, half an hour); a job of many written steps would keep them all.
    """
    global _tidied
    if time.monotonic() - _tidied >= interval_s:
        gc.collect()  # Python's references to plans go first
        spark._jvm.System.gc()
        _tidied = time.monotonic()


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables that this driver made; to be called once results are written."""
    jvm, dropped = spark.sparkContext._jvm, 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        dropped += bool(system.delete(path, True))
    return dropped


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about `limit`, one row at least."""
    upto = np.cumsum(sizes, dtype=np.int64)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + limit, "right")))
        yield lo, hi
        lo = hi


def byte_slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes of text each, one row at least."""
    return row_slices(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), limit)


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; it reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows

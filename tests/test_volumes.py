"""Volumes: what stands inside a lambda is computed once, and few small rows are dealt to several tasks."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessella.functions import qualia, volumes
from tessella.plans import hypervectors


def test_nested_turns_are_computed_once(spark):
    """Three turns, one in the other: as written for each place these were 2,048 cubed evaluations."""
    turn = volumes.rotation()
    x = F.transform(F.sequence(F.lit(0), F.lit(2047)), lambda i: (i * 7 + F.col("id")).cast("int"))
    out = spark.range(2).select(volumes.bind(volumes.bind(volumes.bind(x, turn), turn), turn).alias("x")).first()["x"]
    want = [i * 7 for i in range(2048)]
    for _ in range(3):
        moved = [0] * 2048
        for i, to in enumerate(turn):
            moved[to] = want[i]
        want = moved
    assert out == want


def test_histogram_of_a_computed_array(spark):
    x = F.transform(F.sequence(F.lit(0), F.lit(699)), lambda i: ((i * 7 + F.col("id")) % 256).cast("int"))
    out = spark.range(1).select(volumes.histogram16(x).alias("h")).first()["h"]
    assert out == np.bincount([i * 7 % 256 // 16 for i in range(700)], minlength=16).tolist()


def test_mask_is_looked_up(spark):
    mask = (0b10100110, 0b01110001, 0b11110000111100001111000011110000)
    rows = spark.range(1).select(qualia._inside(mask).alias("a"), F.transform(F.sequence(F.lit(0), F.lit(2047)), lambda i: qualia.in_mask(i, mask)).alias("b"))
    a, b = rows.first()
    assert a == b and sum(a) == qualia.mask_overlap(mask, mask)


def test_suppliers_of_one_file_are_many_tasks(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT i AS s_suppkey FROM range(5000) t(i)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    tasks = hypervectors._volumes(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 4

"""Rounded doubles are the SQL engine's, to the sign of zero."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import plans
from tessella.functions import vectors as V


def test_rounded_equals_sql(spark):
    rng = np.random.default_rng(3)
    near = (np.arange(-3000, 3000) + 0.5) / 1e5
    values = np.concatenate([near, np.nextafter(near, 1), np.nextafter(near, -1), rng.normal(size=3000), [0.0, -0.0, -1e-6, -4.9e-6, 1e-9, 1e308, -1e308, 5e-324, 2.0**52 + 0.5]]).tolist()
    got = [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", V.rounded("v", 5).alias("y")).orderBy("i").collect()]
    want = [duckdb_round for (duckdb_round,) in duckdb.execute("SELECT round(v, 5) FROM (SELECT unnest($1::DOUBLE[]) AS v)", [values]).fetchall()]
    assert list(map(repr, got)) == list(map(repr, want))


def test_rounded_without_a_number(spark):
    r = spark.range(1).select(V.rounded(F.lit(float("nan")), 5), V.rounded(F.lit(float("-inf")), 5), V.rounded(F.lit(None).cast("double"), 5)).first()
    assert math.isnan(r[0]) and r[1] == float("-inf") and r[2] is None


@pytest.mark.parametrize("name", ["elementwise", "row_layout"])
def test_small_negatives_equal_sql(spark, tmp_path, name):
    """A sum or a line's value just under zero rounds to a zero with its sign."""
    rng = np.random.default_rng(5)
    rows = [(i, 0, [float(x) for x in np.float32(rng.normal(size=64) * 1e-5 - (0.25 if i % 2 else 0))]) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duck.execute(plans.oracle_sql()[name] + " ORDER BY vec_id").fetchall()
    got = [tuple(r) for r in plans.queries()[name](spark, str(tmp_path)).orderBy("vec_id").collect()]
    assert repr(got) == repr(want)

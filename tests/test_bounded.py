"""What a task holds is bounded, with the same results."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import graph, hdc, waves


def test_missing_edges_never_shuffles_pairs(spark):
    a = spark.createDataFrame([(1, 0), (2, 0), (2, 0), (3, 1), (None, 0), (4, None)], "src int, block int")
    b = spark.createDataFrame([(10, 0), (10, 0), (11, 0), (12, 1), (None, 1), (13, None)], "dst int, block int")
    e = spark.createDataFrame([(1, 10), (1, 12), (3, 12), (2, None), (None, 11), (1, 10)], "src int, dst int")
    want = a.join(b, "block").join(e, ["src", "dst"], "left_anti").select("src", "dst", "block")
    out = graph.missing_edges(a, b, e)
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate inline")]  # nothing is shuffled once pairs are made


def test_missing_edges_over_several_chunks(spark):
    a, b = spark.range(3).select(F.col("id").alias("src"), F.lit(0).alias("block")), spark.range(3000).select(F.col("id").alias("dst"), F.lit(0).alias("block"))
    e = spark.range(3000).where("id % 3 <> 0").select((F.col("id") % 2).alias("src"), F.col("id").alias("dst"))
    want = a.join(b, "block").join(e, ["src", "dst"], "left_anti").select("src", "dst", "block")
    out = graph.missing_edges(a, b, e)
    assert out.count() == 7000 and out.exceptAll(want).count() == 0


def test_degrees_count_repeated_and_reversed_edges_once(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (1, 3), (4, 4)], "src int, dst int")
    assert {tuple(r) for r in graph.degrees(e).collect()} == {(1, 2), (2, 1), (3, 1), (4, 1)}


def test_votes_of_large_and_small_groups(spark):
    """Groups with many rows in a batch go as counts, others as rows; null and text keys too."""
    rows = spark.range(6000).select(F.when(F.col("id") % 7 < 3, F.lit("hub")).when(F.col("id") % 7 == 3, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("k"), F.array(F.xxhash64("id"), F.xxhash64("id", F.lit(1))).alias("fp"))
    want = sorted(map(str, hdc.bundle_majority(rows, ["k"], 2, 64).collect()))
    for heavy in (1, 32, 10**9):
        assert sorted(map(str, hdc.votes(rows, ["k"], 2, 64, heavy=heavy).drop("agreed").collect())) == want


@pytest.mark.parametrize("step", ["write", "read"])
def test_carriers_take_a_bounded_number_of_rows(step):
    """A batch of 2,000 containers gives several frames, none of over ROWS containers."""

    class Rows:
        schema = {"k": type("T", (), {"dataType": type("D", (), {"simpleString": staticmethod(lambda: "bigint")})})}

        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return list(run(iter([pd.DataFrame({"k": range(2000), "c": [[0] * waves.SAMPLES] * 2000})])))

    parts = waves.write(Rows(), "k", "c", [(3, 0.5, 7.0)]) if step == "write" else waves.read(Rows(), "k", "c")
    assert sum(x["id"].nunique() for x in parts) == 2000 and max(x["id"].nunique() for x in parts) <= waves.ROWS


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_missing_edges_dealt_and_broadcast(spark, monkeypatch, small):
    """Arrays of b's nodes that are shuffled or broadcast; hubs, repeated nodes, nulls, blocks of one side only."""
    for name, value in {"SMALL": small, "CHUNK": 4, "GROUP": 8, "TASK_PAIRS": 500}.items():
        monkeypatch.setattr(graph, name, value, raising=False)
    a = spark.range(90).select(F.when(F.col("id") > 1, F.col("id") % 80).alias("src"), F.when(F.col("id") % 11 > 0, F.col("id") % 3).alias("block"))
    b = spark.range(150).select(F.when(F.col("id") > 1, F.col("id") % 140).alias("dst"), (F.col("id") % 5 % 4).alias("block"))
    e = spark.range(4000).select((F.xxhash64("id") % 80).alias("src"), (F.col("id") % 150).alias("dst")).union(spark.range(140).select(F.lit(7), "id"))
    want = a.join(b, "block").join(e, ["src", "dst"], "left_anti").select("src", "dst", "block")
    out = graph.missing_edges(a, b, e)
    assert out.count() == want.count() > 500 and out.exceptAll(want).count() == 0


def test_missing_edges_come_in_lists_that_repeat(spark, tmp_path):
    """A compressed file of pairs takes a part of a byte a pair, though each node knows one other or more."""
    a = spark.range(3000).select(F.col("id").alias("src"), (F.col("id") % 3).alias("block"))
    b = spark.range(6000).select((F.col("id") * 3).alias("dst"), (F.col("id") % 3).alias("block"))
    e = spark.range(12000).select((F.col("id") % 3000).alias("src"), (F.pmod(F.xxhash64("id"), F.lit(6000)) * 3).alias("dst"))
    out = graph.missing_edges(a, b, e)
    out.write.parquet(str(tmp_path / "out"))
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.6 * out.count()

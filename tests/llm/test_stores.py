"""The shared folder without a scheme on a cluster, and on a file system that only Spark opens."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from tessella.llm import queries

SF = "/root/testdata/sf0.001"
SCRIPT = """
import sys
from pyspark.sql import SparkSession

name, folder = sys.argv[1:]
conf = {"spark.master": "local[2]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.checkpoint.dir": "viewfs://store/shared", "spark.hadoop.fs.viewfs.mounttable.store.link./shared": f"file://{folder}/shared"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
from tessella.llm import queries

queries.QUERIES[name](spark, "SF").write.parquet(f"{folder}/out")
""".replace("SF", SF)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["op6_media", "op7_token_files", "op8_sentencepiece"])
def test_shared_folder_of_a_cluster_without_a_scheme(spark, monkeypatch, name):
    want = rows(queries.QUERIES[name](spark, SF))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    assert rows(queries.QUERIES[name](spark, SF)) == want


@pytest.mark.parametrize("name", ["op6_media", "op7_token_files", "op8_sentencepiece"])
def test_shared_folder_that_only_spark_opens(spark, tmp_path, name):
    (tmp_path / "shared").mkdir()
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(Path(__file__).parents[2]), os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", SCRIPT, name, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert rows(spark.read.parquet(f"file://{tmp_path}/out")) == rows(queries.QUERIES[name](spark, SF))

"""The cluster tree: exact searches through it, equal to brute force, and commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, commands
from ..operators._cut import stored
from ._registry import FP2, first_row, ham, prints, query


#: Trees of this driver's applications, by folder: a tree is built once and asked many times.
_TREES: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[int]]:
    df, key = prints(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir)
    if key not in _TREES:
        c, m = clusters.build(df.select(F.col("vec_id").alias("id"), "fp"), 2, 32, min_size=40, max_depth=4)
        _TREES[key] = stored(c, "tree-clusters"), stored(m, "tree-members")
    return *_TREES[key], first_row(df, "fp", 3)


@query(f"WITH {FP2} SELECT p.vec_id AS id, {ham('p', 'q')} AS d FROM fp2 p, fp2 q WHERE q.vec_id = 3 AND {ham('p', 'q')} <= 24")
def radius_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m, q = _tree(spark, sf_dir)
    return clusters.within(c, m, q, 24, 2).select("id", "d")


@query(f"WITH {FP2} SELECT p.vec_id AS id, {ham('p', 'q')} AS d FROM fp2 p, fp2 q WHERE q.vec_id = 3 ORDER BY d, id LIMIT 12")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m, q = _tree(spark, sf_dir)
    return clusters.nearest(c, m, q, 12, 2).select("id", "d")


@query(f"WITH {FP2} SELECT vec_id AS id, a AS x0, b AS x1 FROM fp2")
def xor_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members compressed to differences from their leaf's centre, and back."""
    c, m, _ = _tree(spark, sf_dir)
    back = clusters.undo_diffs(c, clusters.xor_diffs(c, m, 2), 2)
    return back.select("id", F.col("fp")[0].alias("x0"), F.col("fp")[1].alias("x1"))


@query()
def anomaly_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m, _ = _tree(spark, sf_dir)
    return clusters.anomaly(c, m)


@query()
def command_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m, _ = _tree(spark, sf_dir)
    return commands.execute("SCAN ada:clam:0", c, m)


_KNN = f"WITH {FP2} SELECT p.vec_id AS id, {ham('p', 'q')} AS d FROM fp2 p, fp2 q WHERE q.vec_id = 3 ORDER BY d, id LIMIT 12"


@query(_KNN)
def knn_by_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m, q = _tree(spark, sf_dir)
    return clusters.nearest_by_radius(c, m, q, 12, 2).select("id", "d")


@query(_KNN)
def lod_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m, q = _tree(spark, sf_dir)
    return clusters.lod_nearest(c, m, clusters.lod_masks(m, 2), q, 12, 2).select("id", "d")


@query(f"WITH {FP2} SELECT p.vec_id AS id, {ham('p', 'q')} AS d FROM fp2 p, fp2 q WHERE q.vec_id = 3")
def compressed_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to compressed members, without restoring them."""
    c, m, q = _tree(spark, sf_dir)
    return clusters.diff_distances(c, clusters.xor_diffs(c, m, 2), q, 2)

"""Cleaning a corpus: toxic documents go, repeated lines and near copies go, sources are mixed, texts
are encoded. Each stage takes (spark, docs, sf_dir); its result is written and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import lattice, linededup, mixing, simhash, toxicity, unigram
from tessella.llm._shared import materialize, table

PIECES = "piece_bpe_32k.model"


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.5 go."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of 50 words and more go; every document stays, if with less text."""
    return linededup.dedup(docs).select(*docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, Jaccard similarity 0.8 and more) the document
    with the smallest doc_id stays."""
    return simhash.keep_one(docs, similarity=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, dealt by target weights down the tree of domains, languages and sources;
    each document once at most."""
    plan = mixing.plan(docs, max_epochs=1, weights=mixing.targets(spark))
    return mixing.mix(docs, plan).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, its pieces' ids, their number, and whether they decode to the text."""
    pieces = unigram.load(public_tokenizers.path(PIECES))
    coded = lattice.decode(lattice.encode(docs, pieces), pieces)
    same = (F.xxhash64("decoded") == F.col("th")).alias("round_trip")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), same, "ids")


STAGES = [
    ("toxicity", toxic_out),
    ("line dedup", lines_once),
    ("simhash near-dedup", near_copies_out),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: The fields' weights and the fingerprints' hash have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs

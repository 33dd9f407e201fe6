"""One query for each training-data operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, fim, langid, lattice, licenses, linededup, media, mixing, oracles, quality, simhash, tokenbin, tokencount, toxicity, unigram
from ._shared import held_out, new_scratch, table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("lang_best").alias("lang_pred"), "score", "margin", (F.col("lang") == "und").alias("rejected"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    taken = mixing.mix(docs, mixing.plan(docs, weights=mixing.targets(spark)))
    return taken.select("doc_id", F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"), F.col("__tokens").alias("tokens"), "epoch")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), unigram.load(public_tokenizers.path("piece_bpe_32k.model")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents")).select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), "text")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_scratch(spark, "media")
    manifest = media.write_archives(table(spark, sf_dir, "documents"), path)
    return media.features(media.read_archives(spark, path, manifest))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_scratch(spark, "tokens")
    manifest = tokenbin.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenbin.read_token_files(spark, path, manifest, with_ids=False)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = unigram.load(public_tokenizers.path("piece_bpe_32k.model"))
    coded = lattice.decode(lattice.encode(table(spark, sf_dir, "documents"), pieces), pieces)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), (F.xxhash64("decoded") == F.col("th")).alias("round_trip"), "ids")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.drop("class_js", "word_js")  # so that the last bits of distances are no result


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.restore(fim.transform(table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_media": op6_media,
    "op7_token_files": op7_token_files,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_filter_audit": op12_filter_audit,
    "op13_licenses": op13_licenses,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": oracles.op3(mixing.TARGETS),
    "op5_line_dedup": oracles.OP5,
    "op10_quality": oracles.op10(quality.MAX_CLASS, quality.MAX_WORD),
    "op11_fill_in_middle": oracles.OP11,
    "op12_filter_audit": oracles.OP12,
    "op13_licenses": oracles.op13(licenses.template_rows(), licenses.GRAM, licenses.SIMILARITY),
}

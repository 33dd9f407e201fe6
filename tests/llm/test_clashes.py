"""Extra columns with the plans' own names change nothing: every operator and every stage."""

import random

import public_tokenizers
import pytest

import corpus_pipeline
from tessella.llm import audit, fim, langid, lattice, licenses, linededup, media, mixing, quality, simhash, tokenbin, tokencount, toxicity, unigram

CLASH = (
    "th fp fingerprint component_id gone first no k n seg at size words ids decoded score spans predicted lang_best margin classes lines grams starts "
    "n_words kept budget edge remain whole cut rank bucket start n_tokens name part payload feature root key value hashes bands a b e d w p x y "
    "r level found piece known docs edges common letters form output restored which end second mask good bad word hits template band copies tagged label toxic tokens epoch lost chunks"
).split()
BASE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        words = " ".join(rng.choice(["the", "house", "ran", "blue", "of", "tree", "slur" if i % 4 == 0 else "calm"]) for _ in range(40 + i % 7))
        text = "\n".join([words, " ".join(f"shared{j}" for j in range(55)), words[:50]]) if i % 3 else words
        rows.append((i, None if i == 7 else "" if i == 8 else text, None if i == 9 else "en", f"s{i % 3}", len(text)))
    plain = spark.createDataFrame([*rows, rows[0], rows[1]], BASE).repartition(3).cache()
    extra = spark.createDataFrame([(*r, *range(len(CLASH))) for r in [*rows, rows[0], rows[1]]], BASE + "".join(f", {c} int" for c in CLASH)).repartition(2).cache()
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(60)], "doc_id long, toxic int, quality int")
    return plain, extra, labels


PIECES = unigram.load(public_tokenizers.path("piece_bpe_32k.model"))


def _tokens(docs, tmp_path):
    path = f"file://{tmp_path}/{id(docs)}"
    return tokenbin.read_token_files(docs.sparkSession, path, tokenbin.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), 1))


def _media(docs, tmp_path):
    path = f"file://{tmp_path}/m{id(docs)}"
    return media.features(media.read_archives(docs.sparkSession, path, media.write_archives(docs, path)))


RUNS = {
    "langid": lambda d, labels, t: langid.identify(d, langid.learn(d)),
    "simhash": lambda d, labels, t: simhash.near_duplicates(d),
    "keep_one": lambda d, labels, t: simhash.keep_one(d).select("doc_id", "text"),
    "keep_similar": lambda d, labels, t: simhash.keep_one(d, similarity=0.8).select("doc_id", "text"),
    "mixing": lambda d, labels, t: mixing.mix(d, mixing.plan(d)).select("doc_id", "text", "epoch", "__tokens"),
    "tokencount": lambda d, labels, t: tokencount.count_tokens(d, PIECES),
    "linededup": lambda d, labels, t: linededup.dedup(d).select("doc_id", "text", "n_lines", "n_removed"),
    "media": lambda d, labels, t: _media(d, t),
    "tokenbin": lambda d, labels, t: _tokens(d, t),
    "lattice": lambda d, labels, t: lattice.decode(lattice.encode(d, PIECES), PIECES),
    "toxicity": lambda d, labels, t: toxicity.score(d, toxicity.learn(d, labels)).select("doc_id", "score"),
    "fim": lambda d, labels, t: fim.restore(fim.transform(d)),
    "audit": lambda d, labels, t: audit.audit(d, labels.drop("quality").withColumn("quality", labels["toxic"]), min_words=30),
    "licenses": lambda d, labels, t: licenses.scan(d),
    "quality": lambda d, labels, t: quality.judge(d, min_ref_tokens=10).drop("class_js", "word_js"),
}


def rows(df):
    return sorted((str(r) for r in df.collect()))


@pytest.mark.parametrize("name", sorted(RUNS))
def test_operator(tables, tmp_path, name):
    plain, extra, labels = tables
    assert rows(RUNS[name](extra, labels, tmp_path)) == rows(RUNS[name](plain, labels, tmp_path))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[1:])
def test_stage(spark, tables, name, stage):
    plain, extra, _ = tables
    columns = plain.columns if name != "sentencepiece" else ["doc_id", "n_pieces", "round_trip", "ids"]
    out = stage(spark, extra, "")
    assert rows(out.select(*columns)) == rows(stage(spark, plain, "").select(*columns))
    if name != "sentencepiece":
        assert out.columns == extra.columns


def test_toxicity_stage(spark, tables, tmp_path):
    plain, extra, labels = tables
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    toxic_out = corpus_pipeline.STAGES[0][1]
    out = toxic_out(spark, extra, str(tmp_path))
    assert out.columns == extra.columns and rows(out.select(*plain.columns)) == rows(toxic_out(spark, plain, str(tmp_path)))

"""The registered queries and the pipeline on a small folder of tables, against brute force."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm import langid, queries, toxicity, unigram
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_quality import base
from tests.llm.test_simhash import brute_components, brute_print
from tests.test_plans import rows as normal

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return dict(sorted((r.doc_id, r.text) for r in docs))


def run(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert normal(queries.QUERIES[name](spark, SF).toPandas()) == normal(duck.sql(queries.ORACLE_SQL[name]).df())


def test_simhash(spark, texts):
    got, items = run(spark, "op2_simhash"), [(i, brute_print(t)) for i, t in texts.items()]
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in items}
    assert {i: r.component_id for i, r in got.items()} == brute_components(items)


def test_token_files(spark, texts):
    got, lib, start = run(spark, "op7_token_files"), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for i, t in texts.items():
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_media(spark, texts):
    got = run(spark, "op6_media")
    for i, t in texts.items():
        data = t.encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_counts_and_lattice_agree(spark, texts):
    counts, coded = run(spark, "op4_token_counts"), run(spark, "op8_sentencepiece")
    assert {i: r.n_tokens for i, r in counts.items()} == {i: r.n_pieces for i, r in coded.items()}
    assert all(r.round_trip for i, r in coded.items() if unigram.SPACE not in texts[i]) and coded.keys() == texts.keys()


def test_models_and_quality_rows(spark, texts):
    for name in ("op1_language", "op9_toxicity"):
        got = run(spark, name)
        assert {i: r.held_out for i, r in got.items()} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
        assert all(0 <= r.score <= 1 for r in got.values())
    got = run(spark, "op10_quality")
    assert {i: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for i, r in got.items()} == {i: base(t) for i, t in texts.items()}


def test_language_by_a_plain_loop(spark, texts):
    """The compressed sizes again, text by text and dictionary by dictionary."""
    found = langid.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    tools = []
    for raw in found.texts:
        known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=6)
        tools.append(zstandard.ZstdCompressor(level=6, dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False))
    got = run(spark, "op1_language")
    for i, t in texts.items():
        data = regex.sub(r"[^\p{L}]+", " ", t.lower()).encode()
        sizes = [sum(len(c.compress(data[k : k + 1024])) for k in range(0, len(data), 1024)) for c in tools]
        want = found.names[sizes.index(min(sizes))] if regex.search(r"\p{L}", t) else "und"
        assert got[i].lang_pred == want


def brute_similar(docs):
    """The smallest doc_id reachable over pairs of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more."""

    def grams(t):
        w = t.lower().split() if t.isascii() else "".join(c.lower() if c.isascii() else c for c in t)
        w = regex.findall(r"[^\x20\x09-\x0D]+", w if isinstance(w, str) else " ".join(w))
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets, root = [(i, grams(t or "")) for i, t in docs], {i: i for i, _ in docs}
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted((r.doc_id, r.text) for r in docs.collect())
        path = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if k == len(corpus_pipeline.STAGES) - 1:
            out = docs.collect()
            assert sorted(r.doc_id for r in out) == [i for i, _ in before] and all(r.round_trip for r in out)
            continue
        assert docs.columns == names
        after = sorted((r.doc_id, r.text) for r in docs.collect())
        if name == "toxicity":
            gone = {i for i, _ in before} - {i for i, _ in after}
            assert sum(labels.get(i, 1) == 0 for i in gone) <= 1 and set(after) <= set(before)
        elif name == "line dedup":
            assert after == list(zip([i for i, _ in before], brute_lines(before, 50), strict=True))
        elif name == "simhash near-dedup":
            roots = brute_similar(before)
            assert after == [(i, t) for i, t in before if roots[i] == i]
        else:
            assert set(after) <= set(before) and 0 < sum(len(t.split()) for _, t in after) <= 0.5 * sum(len(t.split()) for _, t in before)


def test_toxicity_by_a_plain_loop(spark, texts):
    """The query's scores again: each whole text's marginals by sums over paths in the log domain, token by token."""
    model = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    step, got = model.step, run(spark, "op9_toxicity")
    for i, t in texts.items():
        found = [w.lower() for w in regex.findall(r"[^\W\d_]+", t or "")]
        own = [model.weight[model.words.get(w, 0)] + model.weight[model.words.get(w[:5] + "+", 0) if len(w) > 5 else 0] for w in found]
        emit = [(0.0, max(-30.0, min(30.0, e))) for e in own]
        ahead, behind = [], [(0.0, 0.0)] * len(emit)
        for k, e in enumerate(emit):
            if k == 0:
                ahead.append((e[0], e[1] + model.start))
            else:
                ahead.append(tuple(e[s] + np.logaddexp(ahead[-1][0] + step[0][s], ahead[-1][1] + step[1][s]) for s in (0, 1)))
        for k in range(len(emit) - 2, -1, -1):
            behind[k] = tuple(np.logaddexp(step[s][0] + emit[k + 1][0] + behind[k + 1][0], step[s][1] + emit[k + 1][1] + behind[k + 1][1]) for s in (0, 1))
        p = [1 / (1 + np.exp(a[0] + b[0] - a[1] - b[1])) for a, b in zip(ahead, behind, strict=True)]
        x = model.blend @ [1.0, np.log1p(sum(p)), float(max(p, default=0.0) >= 0.5)]
        want = 1 / (1 + np.exp(-max(-40, min(40, x))))
        assert abs(got[i].score - want) < 1e-6 and got[i].predicted == int(got[i].score >= 0.5)
        assert got[i].n_spans == sum(v >= 0.5 for v in p) or any(abs(v - 0.5) < 1e-6 for v in p)

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, decoders, models

from tessella.llm import lattice, tokencount, unigram

TEXTS = [
    "The cat sat on the mat.",
    " leading  and   double spaces ",
    "tabs\tand\nnew\n\nlines",
    "ünïcode straße naïve 漢字 😀 mixed漢x",
    "123,456.78 -- ((nested)) 'quotes'",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "▁ literal ▁marks",
    "x",
    " ",
    "",
    None,
    "z" * 700,
    "The cat sat on the mat.",
]


@pytest.fixture(scope="module")
def pieces():
    return unigram.load(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library(pieces):
    """The tokenizers library's unigram model over the same table, bytes at the least score."""
    low = min(s for _, _, s in pieces.rows)
    vocab = [("<unk>", low)] + [(f"<0x{b:02X}>", low) for b in range(256)] + [(p, s) for p, _, s in pieces.rows]
    model = models.Unigram(vocab, unk_id=0, byte_fallback=True)
    ids = [-1, *pieces.byte_ids, *(i for _, i, _ in pieces.rows)]
    tok = Tokenizer(model)
    tok.decoder = decoders.ByteFallback()
    return lambda t: [ids[i] for i in tok.encode(unigram.SPACE + t.replace(" ", unigram.SPACE), add_special_tokens=False).ids] if t else []


def test_counts_and_ids_equal_the_library(spark, pieces, library):
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    want = {i: library(t) for i, t in enumerate(TEXTS)}
    counts = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs, pieces).collect()}
    assert counts == {i: len(x) for i, x in want.items()}
    coded = lattice.decode(lattice.encode(docs, pieces, frequent=8), pieces)
    got = {r.doc_id: r for r in coded.collect()}
    assert {i: got[i].ids for i in want} == want
    # SPACE itself decodes to a space, as in SentencePiece.
    assert {i: got[i].decoded for i in want} == {i: (t or "").replace(unigram.SPACE, " ") for i, t in enumerate(TEXTS)}


def test_repeated_rows_and_empty_table(spark, pieces):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "a b"), (None, None)], "doc_id long, text string")
    rows = sorted((str(r.doc_id), len(r.ids)) for r in lattice.encode(docs, pieces).collect())
    assert rows == [("1", 1), ("1", 2), ("1", 2), ("None", 0), ("None", 2)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lattice.encode(empty, pieces).collect() == [] and tokencount.count_tokens(empty, pieces).collect() == []


def test_long_words(spark, pieces, library):
    """One word of many letters: with and without pieces, cut in blocks, and nothing raised."""
    rng = random.Random(3)
    texts = ["".join(rng.choices(a, k=n)) for a in ("abcdeth", "漢字中国", "aé漢😀") for n in (255, 256, 257, 300, 5000, 40_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in lattice.encode(docs, pieces).collect()}
    assert got == {i: library(t) for i, t in enumerate(texts)}


def test_rare_words_and_clashing_columns(spark, pieces, library):
    """Every word through the lattice but one; columns with the plan's names; a text id."""
    docs = spark.createDataFrame([(f"d{i}", t, 1, "x", 2) for i, t in enumerate(TEXTS)], "doc_id string, text string, dealt int, word string, row int")
    got = {r.doc_id: r.ids for r in lattice.encode(docs, pieces, frequent=1, sample_docs=1).collect()}
    assert got == {f"d{i}": library(t) for i, t in enumerate(TEXTS)}


def test_decode_odd_ids(spark, pieces):
    low = {b: i for b, i in enumerate(pieces.byte_ids)}
    e = [low[b] for b in "aé".encode()]
    rows = [(1, None), (2, []), (3, [0, 1, -5, 10**6, None]), (4, e), (5, [low[32], *e]), (6, [low[32], low[0xC3]])]
    df = spark.createDataFrame([(*r, "old") for r in rows], "k int, ids array<int>, decoded string")
    got = {r.k: r.decoded for r in lattice.decode(df, pieces).collect()}
    assert got == {1: None, 2: "", 3: "", 4: "é", 5: "aé", 6: "\ufffd"}


def test_long_text(spark, pieces, library):
    text = "wordy lines, of prose " * 3000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert lattice.encode(docs, pieces).first().ids == library(text)

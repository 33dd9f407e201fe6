"""Token counts: count-only Viterbi over the vocabulary matches that Aho-Corasick enumerates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .unigram import CHUNK, SPACE, Pieces


class Counter:
    """Numbers of pieces on the best path. The first cache_words chunks keep their count."""

    def __init__(self, pieces: Pieces, cache_words: int = 500_000):
        self.automaton = ahocorasick.Automaton()
        for piece, _, score in pieces.rows:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown, self.cache_words, self.kept = pieces.unknown, cache_words, {}
        self.split = regex.compile(CHUNK)

    def chunk(self, text: str) -> int:
        """For each end, the matches come longest first; a later one wins only if strictly better,
        which is the rule of a lattice filled by rising start. A character without a piece of its
        own may also be spelled in its UTF-8 bytes, at the unknown score."""
        size = len(text)
        best, count, single = [0.0] + [None] * size, [0] * (size + 1), [False] * (size + 1)
        at = 1

        def close(upto: int) -> None:
            nonlocal at
            while at <= upto:  # no more matches end at `at`
                if not single[at]:
                    score = best[at - 1] + self.unknown
                    if best[at] is None or score > best[at]:
                        best[at], count[at] = score, count[at - 1] + len(text[at - 1].encode("utf-8"))
                at += 1

        for last, (length, score) in self.automaton.iter(text):
            end = last + 1
            close(end - 1)
            score += best[end - length]
            single[end] |= length == 1
            if best[end] is None or score > best[end]:
                best[end], count[end] = score, count[end - length] + 1
        close(size)
        return count[size]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        kept, total = self.kept, 0
        for c in self.split.findall(SPACE + text.replace(" ", SPACE)):
            n = kept.get(c)
            if n is None:
                n = self.chunk(c)
                if len(kept) < self.cache_words and len(c) <= 64:
                    kept[c] = n
            total += n
        return total


@lru_cache(maxsize=2)
def worker_counter(pieces: Pieces) -> Counter:
    """One counter for all tasks of a Python worker, so its remembered chunks last."""
    return Counter(pieces)


def count_tokens(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens): one row per row of docs, map only. A null or empty text has 0 tokens.

    The piece table is a vocabulary file's and travels with the task; it does not grow with data.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(pieces)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([counter(x.as_py()) for x in b.column(1)], pa.int64())], names=["doc_id", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long")

"""Language ID by compression: the language whose raw-content dictionary helps zstandard most."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import held_out


NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower case, with one space for each run of anything but letters: what is compressed."""
    return NO_LETTERS.sub(" ", text.lower())


@dataclass(frozen=True)
class Languages:
    """Dictionaries by language, the most frequent language first (it wins ties)."""

    names: tuple[str, ...]
    texts: tuple[bytes, ...]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 128, max_chars: int = 4000, dict_bytes: int = 65_536, max_langs: int = 256) -> Languages:
    """Dictionaries from documents that are not held out and have text and lang.

    The sample is bounded: of each of the max_langs most frequent languages the docs_per_lang
    different texts of 40 to max_chars characters with the smallest hash (of other lengths, by
    their first max_chars characters, where a language has no such text). Their lines that no
    other of these has (so no notices that all languages share) are joined and cut at dict_bytes.
    Equal texts are one hash before the window, which keeps that many rows of each partition
    before it shuffles.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    names = [r.lang for r in counts]
    texts = rows.where(F.col("lang").isin(names)).withColumn("at", F.xxhash64("text"))
    different = texts.groupBy("lang", "at").agg(F.min(~F.length("text").between(40, max_chars)).alias("other"))
    taken = (
        different.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("other", "at")))
        .where(F.col("n") <= docs_per_lang)
        .withColumn("least", F.min("other").over(Window.partitionBy("lang")))
        .where("other = least")
    )
    # At most max_langs * docs_per_lang rows of numbers; only their texts are grouped.
    sample = (
        texts.join(F.broadcast(taken.select("lang", "at", "n")), ["lang", "at"])
        .groupBy("lang", "n")
        .agg(F.min(F.left("text", F.lit(max_chars))).alias("text"))
        .select("lang", "n", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    )
    own = sample.groupBy("line").agg(F.count("*").alias("times"), F.min(F.struct("lang", "n", "k")).alias("at")).where("times = 1")
    joined = (
        own.groupBy("at.lang")
        .agg(F.array_sort(F.collect_list(F.struct("at.n", "at.k", "line"))).alias("all"))
        .select("lang", F.expr(f"left(concat_ws(' ', all.line), {2 * dict_bytes})").alias("text"))
    )
    found = {r.lang: letters(r.text).encode("utf-8")[:dict_bytes] for r in joined.collect()}
    return Languages(tuple(names), tuple(found.get(n, b"") for n in names))


class Classifier:
    def __init__(self, languages: Languages, level: int = 6, chunk: int = 1024):
        self.names, self.chunk, self.tools = languages.names, chunk, []
        for raw in languages.texts:
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None
            if known:
                known.precompute_compress(level=level)
            self.tools.append(zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False))

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of the whole text under each dictionary; each chunk starts afresh, so the dictionary counts to the end of a long text."""
        data = letters(text).encode("utf-8")
        chunks = [data[i : i + self.chunk] for i in range(0, len(data), self.chunk)]
        return [sum(len(c.compress(x)) for x in chunks) for c in self.tools]

    def __call__(self, text: str | None) -> tuple[str | None, float, float]:
        """Best language, score, margin; no language for a text without a letter."""
        if not self.names or text is None or not any(map(str.isalpha, text)):
            return None, 0.0, 0.0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.names[0], 1.0, 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / second
        # Each byte saved counts as half a bit of evidence, spread over a text's chunks.
        gain = np.exp2(-0.5 * (np.asarray(sizes) - sizes[best]) / (1 + len(text) // (4 * self.chunk)))
        return self.names[best], float(1 / gain.sum()), float(margin)


def identify(docs: DataFrame, languages: Languages, id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.01) -> DataFrame:
    """(doc_id, lang_best, score, margin, lang): one row per row of docs, map only.

    lang_best is the language with the smallest compressed size, `und` for a null text, one
    without a letter, or where nothing was learned; score is between 0 and 1 and 0 for `und`;
    margin is the share of bytes saved against the second best. lang is lang_best, or `und` where
    the margin is under min_margin. Ties go to the more frequent language. Repeated rows stay.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(languages)
        for b in batches:
            found = [classify(x.as_py()) for x in b.column(1)]
            best = ["und" if f[0] is None else f[0] for f in found]
            lang = ["und" if f[2] < min_margin else n for n, f in zip(best, found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64()), pa.array(lang, pa.string())], names=["doc_id", "lang_best", "score", "margin", "lang"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_best string, score double, margin double, lang string")

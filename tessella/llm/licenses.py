"""License scans by diagonal voting, with DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import fits_broadcast, materialize

#: Words are runs of a-z, 0-9 and everything beyond ASCII, once A-Z are lower.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 3
KEY = ["__key", "__th"]

# The phrases of the base rule, and notices that licenses ask to be put into files.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "licensed under the GNU General Public License version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
SIMILARITY = 0.8


def split_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def template_rows(phrases=PHRASES, notices=NOTICES, similarity: float = SIMILARITY) -> list[tuple]:
    """(template, label, base, size, slack, votes, words) for each phrase and notice.

    A span of at least that similarity differs from its template in at most slack words, each of
    which spoils GRAM grams at most: so many votes are left, and they lie on diagonals no further
    than slack apart. Phrases must stand word by word.
    """
    rows = []
    for base, table in ((True, phrases), (False, notices)):
        for label, text in table:
            words = split_words(text)
            slack = 0 if base else int((1 - similarity) * len(words) + 1e-9)
            votes = len(words) - GRAM + 1 - GRAM * slack
            if votes < 1:
                raise ValueError(f"too few words to find the template by {GRAM}-grams: {text!r}")
            rows.append((len(rows), label, base, len(words), slack, votes, words))
    return rows


def _templates(spark: SparkSession, rows: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """The templates, and a row for each of their grams: (template, at, size, slack, gram)."""
    table = spark.createDataFrame(rows, "template int, label string, base boolean, size int, slack int, votes int, words array<string>")
    starts = F.explode(F.sequence(F.lit(0), F.size("words") - GRAM)).alias("at")
    grams = table.select("template", "slack", "words", starts).select("template", "slack", "at", F.xxhash64(*(F.get("words", F.col("at") + i) for i in range(GRAM))).alias("gram"))
    return table, grams


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def _candidates(rows: DataFrame, table: DataFrame, grams: DataFrame) -> DataFrame:
    """(__key, __th, hits): hits that stand on diagonals with enough votes, each with its template
    and the first of its neighbouring diagonals. hits is one array a document, with no more
    entries than the document has grams that are a template's.
    """
    words = rows.select(*KEY, _words(F.lower("text")).alias("w"))
    rolled = F.transform(F.slice("w", 1, F.greatest(F.size("w") - (GRAM - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get("w", i + j) for j in range(1, GRAM))))
    rolled = words.select(*KEY, F.posexplode(rolled).alias("pos", "gram"))
    hits = rolled.join(F.broadcast(grams), "gram").select(*KEY, "template", "slack", "at", "pos").distinct()
    hits = materialize(hits.withColumn("diagonal", F.col("pos") - F.col("at")), "license-hits")
    diagonals = hits.groupBy(*KEY, "template", "slack", "diagonal").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*KEY, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.col("slack"), F.lit(True))
    diagonals = diagonals.withColumn("apart", apart)
    diagonals = diagonals.withColumn("band", F.max(F.when(F.col("apart"), F.col("diagonal"))).over(order))
    bands = diagonals.groupBy(*KEY, "template", "band").agg(F.sum("n").alias("n"))
    bands = bands.join(F.broadcast(table.select("template", "votes")), "template").where("n >= votes")
    kept = diagonals.join(bands.select(*KEY, "template", "band"), [*KEY, "template", "band"]).select(*KEY, "template", "band", "diagonal")
    hits = hits.join(kept, [*KEY, "template", "diagonal"])
    return hits.groupBy(*KEY).agg(F.collect_list(F.struct("template", "band", "at", "pos")).alias("hits"))


def spans(docs: DataFrame, phrases=PHRASES, notices=NOTICES, similarity: float = SIMILARITY, broadcast_rows: int = 200_000) -> DataFrame:
    """(__key, __th, label, base, start, stop, score): verified places of templates in texts.

    Every rolling 3-word hash of every text meets the templates' grams (a table of fixed size,
    broadcast); a hit votes for its diagonal, text position less template position; diagonals that
    a few inserted or lost words keep apart are merged. Bands with votes enough (template_rows)
    are verified in the text itself, word by word: score is the number of the template's words
    that verified hits cover, by the template's size or the span's if that is longer. Phrases need 1.
    Only texts with a candidate are read again: found by a broadcast of their hashes where these are
    counted to be few (a long each), else by shuffle, with the same result.
    """
    table, grams = _templates(docs.sparkSession, template_rows(phrases, notices, similarity))
    rows = _keyed(docs).select(*KEY, "text")
    found = materialize(_candidates(rows, table, grams), "license-candidates")
    texts = found.select("__th").distinct()
    met = rows.join(F.broadcast(texts) if fits_broadcast(texts, broadcast_rows) else texts, "__th", "left_semi").join(found.hint("merge"), KEY)
    # Written, so that the words are split once and not for each hit.
    met = materialize(met.select(*KEY, _words(F.translate("text", UPPER, LOWER)).alias("w"), "hits"), "license-texts")
    hits = met.select(*KEY, F.explode("hits").alias("h"), "w").select(*KEY, "h.*", F.slice("w", F.col("h.pos") + 1, F.lit(GRAM)).alias("own")).distinct()
    hits = hits.join(F.broadcast(table), "template").where(F.slice("words", F.col("at") + 1, F.lit(GRAM)) == F.col("own"))
    covered = hits.select(*KEY, "template", "label", "base", "size", "band", "pos", F.explode(F.sequence(F.col("at"), F.col("at") + GRAM - 1)).alias("word"))
    by = covered.groupBy(*KEY, "template", "label", "base", "size", "band").agg(F.countDistinct("word").alias("covered"), F.min("pos").alias("start"), (F.max("pos") + GRAM).alias("stop"))
    score = F.col("covered") / F.greatest(F.col("size"), F.col("stop") - F.col("start"))
    return by.withColumn("score", score).where(F.col("score") >= F.when(F.col("base"), 1.0).otherwise(similarity)).select(*KEY, "label", "base", "start", "stop", "score")


def _keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumns({"__key": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__th": F.xxhash64("text")})


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    n_base counts all places of phrases, overlapping ones too, first_word and last_word are the
    smallest and largest of their starts (null without any); labels joins base_labels and the
    labels of notices of at least that similarity; score is the best place's, 0 without any. Both
    lists are sorted, distinct and joined by commas, '' without any. A null text is empty. Rows that
    repeat doc_id and text have equal results; texts under one doc_id are told apart by 64-bit
    hashes. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    rows = _keyed(docs)
    found = spans(docs, phrases, notices, similarity)
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = F.col("base")
    found = found.groupBy(*KEY).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        names(F.when(base, F.col("label"))).alias("base_labels"),
        names("label").alias("labels"),
        F.max("score").alias("score"),
    )
    found = materialize(found, "license-found")
    n_words = F.size(_words(F.translate("text", UPPER, LOWER))).cast("long")
    rows = rows.select("doc_id", *KEY, n_words.alias("n_words")).join(found.hint("merge"), KEY, "left")
    empty = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return rows.select("doc_id", "n_words", *(F.coalesce(c, empty[c]).alias(c) if c in empty else c for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")))

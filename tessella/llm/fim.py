"""Fill-in-middle: a document's lines as relational units, cut at seeded ordinals, put in a new order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A unit is a line with its end, or the rest of the text.
UNIT = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")
KEY = ["__key", "__th"]


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks that can be told from any text without them: none is in another, no end of one begins another."""
    for a in sentinels:
        for b in sentinels:
            if not a or (a is not b and b in a) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"sentinels {a!r} and {b!r} can overlap")
    if len(set(sentinels)) != len(sentinels):
        raise ValueError("two sentinels are equal")
    return sentinels


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, __key, __th): a null text is empty; __key is the decimal doc_id, empty for null."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumns({"__key": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__th": F.xxhash64("text")})


def _draw(seed: int, group: int) -> Column:
    """The group-th 8 hexadecimal digits of a document's seeded SHA-256, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("__key")).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def offsets(rows: DataFrame, seed: int = 7) -> DataFrame:
    """(__key, __th, first, second): where the prefix and the middle end, in characters.

    One row for each distinct key and text of _keyed rows whose cuts are not both at 0. Only the
    lengths of units are shuffled, never texts. A window holds the units of one document, which
    was one row before.
    """
    units = rows.select(*KEY, F.posexplode(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))).alias("u", "unit"))
    units = units.select(*KEY, "u", F.length("unit").alias("size")).repartition(*KEY).dropDuplicates([*KEY, "u"])
    ends = units.withColumn("end", F.sum("size").over(Window.partitionBy(*KEY).orderBy("u"))).select(*KEY, (F.col("u") + 1).alias("cut"), "end")
    n = F.regexp_count("text", F.lit(UNIT))
    drawn = rows.select(*KEY, *(F.pmod(_draw(seed, g), n + 1).cast("int").alias(c) for g, c in enumerate("xy"))).distinct()
    cuts = F.array(F.struct(F.lit(1).alias("which"), F.least("x", "y").alias("cut")), F.struct(F.lit(2).alias("which"), F.greatest("x", "y").alias("cut")))
    requests = drawn.select(*KEY, F.inline(cuts)).where("cut > 0")
    at = lambda which: F.max(F.when(F.col("which") == which, F.col("end"))).cast("int")
    return requests.join(ends, [*KEY, "cut"]).groupBy(*KEY).agg(at(1).alias("first"), at(2).alias("second"))


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per row of docs (doc_id, text).

    The text's n units (lines) are cut at two ordinals of 0 to n that the seed and doc_id give:
    before the smaller is the prefix, up to the larger the middle, the rest is the suffix. Of 100
    documents, `rate` are transformed, of those `spm` as suffix-prefix-middle, the others as
    prefix-suffix-middle. plain, with the text as it is and null lengths: the others, empty and null
    texts, and texts that hold a sentinel. A null doc_id is drawn as an empty one. Rows that repeat
    doc_id and text have equal results; texts under one doc_id are told apart by 64-bit hashes. An
    empty table gives an empty result; other columns are ignored, whatever their names. A text of
    any length is cut whole.
    """
    p, s, m = _checked(sentinels)
    rows = _keyed(docs)
    rows = rows.join(offsets(rows, seed).hint("shuffle_hash"), KEY, "left")
    first, second = F.coalesce("first", F.lit(0)), F.coalesce("second", F.lit(0))
    held = F.lit(False)
    for mark in sentinels:
        held = held | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | held | (_draw(seed, 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(seed, 3) % 100 < spm, "spm").otherwise("psm")
    rows = rows.withColumns({"form": form, "first": first, "second": second, "n": F.regexp_count("text", F.lit(UNIT)).cast("long")})
    text = F.col("text")
    prefix, middle, suffix = text.substr(F.lit(1), F.col("first")), text.substr(F.col("first") + 1, F.col("second") - F.col("first")), text.substr(F.col("second") + 1, F.length(text))
    output = F.when(F.col("form") == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle)).when(F.col("form") == "spm", F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle)).otherwise(text)
    chars = lambda c: F.when(F.col("form") != "plain", c).cast("long")
    return rows.select("doc_id", "n", "form", chars(F.col("first")).alias("prefix_chars"), chars(F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"))


def restore(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """made (form, output) plus restored, the text before transform, from these two columns alone.

    A null form or output gives null; a column called restored is replaced.
    """
    marks = "|".join(re.escape(x) for x in _checked(sentinels))
    rows = made.withColumn("restored", F.split("output", marks, -1))
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    joined = {form: F.concat(*(F.get("restored", F.lit(i)) for i in at)) for form, at in order.items()}
    return rows.withColumn("restored", F.when(F.col("form") == "psm", joined["psm"]).when(F.col("form") == "spm", joined["spm"]).when(F.col("form") == "plain", F.col("output")))

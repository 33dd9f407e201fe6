"""Quality rules by distribution divergence, with DataFrame functions only.

A document's character-class and common-word histograms are held against those of its language by
Jensen-Shannon distance; short documents are spared by minimum-length guards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD_GAP, fits_broadcast, materialize

#: Removed one after the other; what each step takes away is that class's count.
CLASSES = (("lower", r"\p{Ll}+"), ("upper", r"\p{Lu}+"), ("digit", r"\p{Nd}+"), ("space", r"[\x20\x09-\x0D]+"), ("stop", r"[.,;:!?'\"()\-]+"), ("symbol", r"[#*$%&|<>]+"))
#: Largest distances from a language's histograms that a document may have.
MAX_CLASS, MAX_WORD = 0.25, 0.36
SPACES = " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    body = F.trim(text, F.lit(SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WORD_GAP))


def with_counts(rows: DataFrame) -> DataFrame:
    """rows (with text not null) plus classes, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    classes has the character counts by CLASSES, which have no character in common, and, last, of
    all others; space and symbol are two of them, so word_chars and n_symbols need no other pass.
    All within a row, so any number of rows needs no shuffle. Repeated windows are found by
    sorting the hashes of a document's 3-word windows, never by comparing all of them.
    """
    rows = rows.withColumn("r0", F.col("text"))
    for i, (_, pattern) in enumerate(CLASSES):
        rows = rows.withColumn(f"r{i + 1}", F.regexp_replace(f"r{i}", pattern, ""))
    left = [F.length(f"r{i}").cast("long") for i in range(len(CLASSES) + 1)]
    counts = [a - b for a, b in zip(left, left[1:], strict=False)] + left[-1:]
    rows = rows.withColumn("classes", F.array(*counts)).drop(*(f"r{i}" for i in range(len(CLASSES) + 1)))
    rows = rows.withColumn("words", _words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("lines", F.when(F.contains("text", F.lit("\n")), lines))
    at = lambda i: F.get(F.col("words"), i)
    grams = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, at(i + 1), at(i + 2)))
    rows = rows.withColumn("grams", grams).withColumn("again", F.size("grams") > F.size(F.array_distinct("grams")))
    # Hashes that stand twice or more, from neighbours in order; then the places of those hashes. Few
    # hashes are looked for in place, many by sorting hashes with places: the result is the same.
    rows = rows.withColumn("sorted", F.when(F.col("again"), F.sort_array("grams")))
    rows = rows.withColumn("dups", F.array_distinct(F.filter("sorted", lambda g, k: F.coalesce(F.get(F.col("sorted"), k + 1) == g, F.lit(False))))).drop("sorted")
    few = F.filter(F.transform("grams", lambda g, i: F.when(F.array_contains("dups", g), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("placed", F.when(F.size("dups") > 32, F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    other = lambda k: F.coalesce(F.get(F.col("placed"), k)["g"], F.lit(None).cast("long"))
    twice = F.filter("placed", lambda e, k: F.coalesce((other(k - 1) == e["g"]), F.lit(False)) | F.coalesce((other(k + 1) == e["g"]), F.lit(False)))
    many = F.sort_array(F.transform(twice, lambda e: e["i"]))
    rows = rows.withColumn("starts", F.when(F.size("dups") > 32, many).when(F.col("again"), few))
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    kinds = [name for name, _ in CLASSES]
    count = lambda name: F.element_at("classes", kinds.index(name) + 1)
    return (
        rows.withColumn("n_words", F.size("words").cast("long"))
        .withColumn("n_repeat_words", F.when(F.col("again"), covered).otherwise(0).cast("long"))
        .withColumn("word_chars", F.length("text").cast("long") - count("space"))
        .withColumn("n_symbols", count("symbol"))
        .withColumn("n_dup_lines", F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long"))
        .drop("words", "lines", "grams", "again", "dups", "placed", "starts")
    )


def counted(docs: DataFrame) -> DataFrame:
    """A row per row of docs, written once: doc_id, lang ('' for null), the counts, and letters, the
    text's runs of letters in lower case joined by spaces, with n_tokens, their number.
    """
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    letters = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "))
    rows = with_counts(rows).withColumn("letters", letters).drop("text")
    gaps = F.octet_length("letters") - F.octet_length(F.replace("letters", F.lit(" "), F.lit("")))
    return materialize(rows.withColumn("n_tokens", F.when(F.col("letters") == "", 0).otherwise(gaps + 1).cast("long")), "quality-counts")


def references(rows: DataFrame, top: int = 30) -> DataFrame:
    """For each language of counted rows, over all its documents: lang, words and word_p (its `top`
    most frequent words and their shares of all words), longest (letters of the longest of them), class_p (shares of characters), ref_tokens.

    Counted in full; sums are combined before each shuffle, and each task passes on its `top` words
    of a language only once they are summed, so a language with most of the rows is no hot task.
    A null language is one of its own, ''. A language without words has no words.
    """
    size = len(CLASSES) + 1
    sums = rows.groupBy("lang").agg(F.sum("n_tokens").alias("ref_tokens"), *(F.sum(F.element_at("classes", i + 1)).alias(f"c{i}") for i in range(size)))
    total = sum((F.col(f"c{i}") for i in range(size)), F.lit(0))
    shares = sums.select("lang", "ref_tokens", F.array(*(F.col(f"c{i}") / F.nullif(total, F.lit(0)) for i in range(size))).alias("class_p"))
    tokens = rows.where("letters <> ''").select("lang", F.explode(F.split("letters", " ")).alias("word"))
    counts = tokens.groupBy("lang", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    best = counts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)
    best = best.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "word", "n"))).alias("best"))
    out = shares.join(best, "lang", "left")
    part = F.transform("best", lambda e: e["n"] / F.col("ref_tokens"))
    longest = F.array_max(F.transform("best", lambda e: F.length(e["word"])))
    return materialize(out.select("lang", "ref_tokens", "class_p", F.col("best.word").alias("words"), part.alias("word_p"), longest.alias("longest")), "quality-refs")


def _distance(pairs: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (bits) of array<struct<p, q>>."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    total = F.aggregate(pairs, F.lit(0.0), lambda a, e: a + 0.5 * part(e["p"], e["q"]) + 0.5 * part(e["q"], e["p"]))
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def judge(
    docs: DataFrame,
    refs: DataFrame | None = None,
    max_class: float = MAX_CLASS,
    max_word: float = MAX_WORD,
    min_chars: int = 200,
    min_tokens: int = 40,
    min_ref_tokens: int = 1000,
) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, the base counts, base_failed, class_js,
    word_js (distances, null where a guard spares the document) and kept.

    Guards: class_js needs min_chars characters, word_js min_tokens words, both a reference of
    min_ref_tokens words. kept is false if base_failed or a distance exceeds its limit. A null text
    is an empty one: all counts 0 and base_failed. An empty table gives an empty result; other
    columns of docs are ignored, whatever their names. Each text is read once: the counts are
    written, and the references and the verdicts are taken from them. The references are a row
    for each language; they are broadcast when counted to be few and joined by shuffle otherwise,
    with the same result.
    """
    rows = counted(docs)
    refs = references(rows) if refs is None else refs
    rows = rows.join(F.broadcast(refs) if fits_broadcast(refs, 5000) else refs, "lang", "left")
    n_chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumn("chars", n_chars)
    ready = F.col("ref_tokens") >= min_ref_tokens
    class_ready = ready & (F.col("chars") >= min_chars)
    word_ready = ready & (F.col("n_tokens") >= min_tokens)
    # Words no longer than the reference's, each with two spaces of its own, so that what taking
    # " word " away saves is its count.
    near = F.filter(F.split("letters", " "), lambda x: F.length(x) <= F.col("longest"))
    rows = rows.withColumn("spaced", F.when(word_ready, F.concat(F.lit(" "), F.array_join(near, "  "), F.lit(" ")))).drop("letters")
    spaces = lambda w: F.concat(F.lit(" "), w, F.lit(" "))
    times = lambda w: F.octet_length("spaced") - F.octet_length(F.replace(F.col("spaced"), spaces(w), F.lit("")))
    rows = rows.withColumn("found", F.when(word_ready, F.transform("words", lambda w: (times(w) / (F.octet_length(w) + 2)).cast("long"))))
    pair = lambda p, q: F.struct(p.cast("double").alias("p"), q.cast("double").alias("q"))
    hist = F.zip_with("found", "word_p", lambda n, q: pair(n / F.col("n_tokens"), q))
    all_found = F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x)
    rest = pair(1.0 - all_found / F.col("n_tokens"), F.greatest(F.lit(0.0), 1.0 - F.aggregate("word_p", F.lit(0.0), lambda a, x: a + x)))
    word_js = F.when(word_ready, _distance(F.concat(hist, F.array(rest))))
    class_js = F.when(class_ready, _distance(F.zip_with("classes", "class_p", lambda c, q: pair(c / F.col("chars"), q))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("class_js", class_js).withColumn("word_js", word_js).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & F.coalesce(F.col("class_js") <= max_class, F.lit(True)) & F.coalesce(F.col("word_js") <= max_word, F.lit(True))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_js", "word_js", kept.alias("kept"))

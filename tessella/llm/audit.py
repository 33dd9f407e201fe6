"""Filter interaction audit: which documents each of five filters takes away, in every order."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import materialize
from .quality import _words

#: Letters of the filters; the i-th is bit i of a mask of failures.
FILTERS = "ABCDE"
KEY = ["__key", "__th"]
#: A text that holds at least this share of all rows is joined by broadcast: there are at most 1,000.
HOT_SHARE = 1000


def word_totals(rows: DataFrame) -> DataFrame:
    """(__key, __th, n_words, n_distinct) of rows (__key, __th, text).

    Words are exploded and grouped by document and word, then by document. Texts are dealt by
    document once; both groupings are satisfied by that and shuffle nothing more, so the pairs of
    document and word, which outnumber everything else, stay where they are made. Each row also
    gives one empty word, which counts how often document and text repeat.
    """
    words = rows.repartition(*KEY).select(*KEY, F.explode(F.concat(F.array(F.lit("")), _words(F.col("text")))).alias("word"))
    pairs = words.groupBy(*KEY, "word").agg(F.count("*").alias("n"))
    sums = pairs.groupBy(*KEY).agg(F.sum("n").alias("all"), F.max(F.when(F.col("word") == "", F.col("n"))).alias("rows"), F.count("*").alias("kinds"))
    return sums.select(*KEY, (F.col("all") / F.col("rows") - 1).cast("long").alias("n_words"), (F.col("kinds") - 1).alias("n_distinct"))


def _copies(rows: DataFrame) -> DataFrame:
    """rows (doc_id, __same, ...) plus __late: whether a smaller doc_id has the same text.

    Of the texts that stand under several ids, those with a thousandth of all rows and more are
    broadcast, a thousand at most; the others are joined by shuffle, where no key is hot.
    """
    firsts = rows.groupBy("__same").agg(F.min("doc_id").alias("__least"), F.max("doc_id").alias("__most"), F.count("*").alias("__times"))
    firsts = materialize(firsts.where("__least < __most").drop("__most"), "audit-firsts")
    total = rows.count()
    hot = F.broadcast(firsts.where(F.col("__times") * HOT_SHARE >= total).select("__same", "__least"))
    rest = firsts.where(F.col("__times") * HOT_SHARE < total).select("__same", "__least")
    late = F.coalesce(F.col("doc_id") > F.col("__least"), F.lit(False)).alias("__late")
    both = rows.join(hot, "__same").select(*rows.columns, late)
    return both.unionByName(rows.join(hot, "__same", "left_anti").join(rest, "__same", "left").select(*rows.columns, late))


def failures(docs: DataFrame, min_words: int = 200, min_distinct: int = 50, max_upper: int = 3, symbols: str = r"[#$%&*|]") -> DataFrame:
    """(doc_id, part, mask), one row per row of docs (doc_id, text, lang): bit i of mask is set if
    the i-th filter of FILTERS is failed.

    A: under min_words words. B: distinct words are under min_distinct percent. C: A-Z are over
    max_upper percent of the characters. D: holds one of `symbols`. E: the same text (by SHA-256)
    stands under a smaller doc_id. part is lang, '' for null. A null text is empty. A null doc_id
    is neither smaller nor larger than any other. Rows that repeat doc_id and text count each, and
    are no copies of each other. Other columns are ignored, whatever their names.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumns({"__key": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__th": F.xxhash64("text")})
    upper = F.octet_length("text") - F.octet_length(F.regexp_replace("text", "[A-Z]+", ""))
    flags = rows.select(
        "doc_id", "part", *KEY,
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("__same"),
        (100 * upper.cast("long") > max_upper * F.length("text").cast("long")).alias("__c"),
        F.col("text").rlike(symbols).alias("__d"),
    )
    flags = _copies(materialize(flags, "audit-flags"))
    both = flags.join(word_totals(rows.select(*KEY, "text")), KEY, "left")
    n, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    failed = [n < min_words, 100 * distinct < min_distinct * n, F.col("__c"), F.col("__d"), F.col("__late")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))
    return materialize(both.select("doc_id", "part", mask.alias("mask")), "audit-masks")


def _labelled(labels: DataFrame) -> DataFrame:
    """One row an id: whether any of its labels is good, whether any is toxic; null ids and labels say nothing."""
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    return labels.where("doc_id is not null").groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("bad"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n, good, bad): for each part three arrays of 32 counts, by mask: all documents, those
    of quality 1, those of toxic 1. One grouped sum of conditional counts, combined before the shuffle."""
    rows = masks.join(_labelled(labels), "doc_id", "left")
    many = range(1 << len(FILTERS))
    kinds = {"n": F.lit(True), "good": F.coalesce("good", F.lit(False)), "bad": F.coalesce("bad", F.lit(False))}
    counts = [F.count_if((F.col("mask") == m) & kind).alias(f"{name}{m}") for name, kind in kinds.items() for m in many]
    return rows.groupBy("part").agg(*counts).select("part", *(F.array(*(f"{name}{m}" for m in many)).alias(name) for name in kinds))


def _where(counts: str, keep) -> Column:
    """The sum of those counts whose mask fulfils keep."""
    return F.aggregate(F.transform(counts, lambda c, m: F.when(keep(m), c).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)


def audit(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """For each part (lang, '' for null), each order of the five filters and each step one row:
    part, filter_order, step, and the documents of the part that are kept after it, removed by it,
    redundant (they fail it but were removed earlier), unique_fails (they fail it only), good_lost and
    toxic_lost (removed by it, of label quality 1 or toxic 1), and shapley, what the filter removes
    in all orders together.

    A part's rows come from its 32 counts alone: documents are looked at once, not once an order.
    See failures for the filters and for nulls. Labels of ids without a document count for nothing;
    ids with several labels are good if one of them says so. A table without documents gives no row.
    """
    counted = materialize(mask_counts(failures(docs, **limits), labels), "audit-counts")
    orders = F.explode(F.lit(["".join(p) for p in permutations(FILTERS)])).alias("filter_order")
    rows = counted.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    bits = lambda s: sum((F.when(F.contains(s, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumns({"own": bits(letter), "before": bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))})
    own, before = F.col("own"), F.col("before")
    removed = lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) == 0)
    rows = rows.select(
        "part", "filter_order", "step", "own",
        _where("n", lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        _where("n", removed).alias("removed"),
        _where("n", lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        _where("n", lambda m: m == own).alias("unique_fails"),
        _where("good", removed).alias("good_lost"),
        _where("bad", removed).alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")

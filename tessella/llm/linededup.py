"""Line dedup: repeated runs of lines by prefix doubling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD_GAP, materialize

SPACES = " \t\n\x0b\x0c\r"
DOC = ["doc_id", "th"]


def _worded(text: str) -> str:
    """SQL for a text's lines that have a word: array<struct<no, line>>, trimmed of ASCII space."""
    return rf"filter(transform(split({text}, '\n'), (x, i) -> struct(i AS no, trim(BOTH '{SPACES}' FROM x) AS line)), e -> e.line <> '')"


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, th, k, no, a, b, n): the k-th line with a word, which is line no of the text, its
    96-bit ID (a, b) and number of words.

    th tells texts under one doc_id apart; rows equal in both count as one document.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    rows = rows.select(*DOC, F.posexplode(F.expr(_worded("text"))).alias("k", "e"))
    line = F.col("e.line")
    return rows.select(*DOC, "k", F.col("e.no").alias("no"), F.xxhash64(line).alias("a"), F.hash(line, F.lit(1)).alias("b"), F.size(F.split(line, WORD_GAP)).alias("n"))


def _sorted(side: DataFrame) -> DataFrame:
    """A side that is joined by sorting, however small Spark takes it to be: of a written table it counts
    the compressed bytes, and a broadcast of its rows, many times that, would go through the driver."""
    return side.hint("merge")


def _met(left: DataFrame, right: DataFrame, on: list[str], salts: int = 8) -> DataFrame:
    """left joined with right, which has one row for a key: the rows of a very common key are dealt
    to `salts` tasks, to each of which right's row is copied. Spark's estimate counts none of the copies."""
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    copies = right.withColumn("__salt", F.explode(F.array(*(F.lit(i) for i in range(salts)))))
    return left.withColumn("__salt", salt).join(_sorted(copies), [*on, "__salt"]).drop("__salt")


def _named(pairs: DataFrame, label: str) -> DataFrame:
    """pairs (a, b) that occur twice or more, with r: their rank in (a, b) order.

    The rank grows with the order across range partitions but is not dense. It is taken from rows
    sorted on all their columns within fixed ranges, so a task that is run again gives it again.
    """
    twice = pairs.groupBy("a", "b").agg(F.count("*").alias("times")).where("times > 1").select("a", "b")
    ranked = twice.repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("r", F.monotonically_increasing_id())
    return materialize(ranked, label)


def repeated_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, th, gone array<int>): the lines (no, ascending) that belong to later copies of repeated runs.

    A run is a sequence of successive lines with at least min_words words. It is a later copy if the
    same lines stand at an earlier place, by (doc_id, th, k), that it does not overlap; of lines
    that repeat on the spot, the first min_words words therefore stay whole. Lines that occur once
    end every run, so only the others go on.

    For each line the shortest window of min_words words that begins there, and the shortest that
    ends there, are looked up: together such windows cover exactly the repeated runs, however long
    these are. Windows of L lines are equal if their prefixes and suffixes of 2^j <= L lines are,
    and those have ranks from prefix doubling: the rank of 2^j lines is that of the pair of ranks of
    their halves, in sorted order, as in a suffix array; places of one pair of ranks are the
    interval of the suffix order whose longest common prefix has L lines. Doubling stops at the
    longest window, min_words lines at most: deeper ranks would tell no window from another.
    """
    lines = materialize(line_table(docs), "lines")
    names = _named(lines.select("a", "b"), "line-names")
    live = _met(lines, names, ["a", "b"]).select(*DOC, "k", "no", "n", "r")
    by_doc = Window.partitionBy(*DOC).orderBy("k")
    live = live.repartition(*DOC).dropDuplicates([*DOC, "k"]).withColumn("seg", F.col("k") - F.row_number().over(by_doc))
    seg = Window.partitionBy(*DOC, "seg")
    live = live.withColumn("c", F.sum("n").over(seg.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    live = live.withColumn("d", F.col("c") - F.col("n"))
    # First line after the shortest window from here; last line before the shortest window to here.
    # Both frames begin at the first row, so that each is one pass over a document's lines.
    after = F.min("k").over(seg.orderBy(F.desc("d")).rangeBetween(Window.unboundedPreceding, -min_words))
    before = F.max("k").over(seg.orderBy("c").rangeBetween(Window.unboundedPreceding, -min_words))
    whole = F.max(F.struct("c", "k")).over(seg)
    live = (
        live.withColumn("whole", whole)
        .withColumn("stop", F.coalesce(after, F.when(F.col("whole.c") - F.col("d") >= min_words, F.col("whole.k") + 1)))
        .withColumn("from", F.coalesce(before + 1, F.when(F.col("c") >= min_words, F.min("k").over(seg))))
        .where(F.col("whole.c") >= min_words)
        .drop("whole", "c", "d", "n")
    )
    live = materialize(live, "line-live")
    ends = F.array_distinct(F.array(F.struct(F.col("k").alias("at"), (F.col("stop") - F.col("k")).alias("size")), F.struct(F.col("from").alias("at"), (F.col("k") + 1 - F.col("from")).alias("size"))))
    windows = live.select(*DOC, F.inline(ends)).where("at is not null and size is not null").distinct()
    windows = windows.withColumn("level", F.floor(F.log2("size") + F.lit(1e-9)).cast("int"))
    windows = materialize(windows, "line-windows")
    top = windows.agg(F.max("level")).first()[0]
    ranks, found = live.select(*DOC, "seg", "k", "r"), None
    for level in range((top if top is not None else -1) + 1):
        if level:
            half = F.lead("r", 1 << (level - 1)).over(Window.partitionBy(*DOC, "seg").orderBy("k"))
            halves = materialize(ranks.select(*DOC, "seg", "k", F.col("r").alias("a"), half.alias("b")), "line-halves")
            names = _named(halves.where("a is not null and b is not null").select("a", "b"), "line-names")
            ranks = materialize(halves.join(_sorted(names), ["a", "b"], "left").select(*DOC, "seg", "k", "r"), "line-ranks")
        here = windows.where(F.col("level") == level)
        at = ranks.select(*DOC, F.col("k"), "r").where("r is not null")
        null_safe = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["th"] == y["th"])
        x, y = here.alias("w"), at.alias("p")
        both = x.join(_sorted(y), null_safe(here, at) & (F.col("w.at") == F.col("p.k"))).select(F.col("w.doc_id").alias("doc_id"), F.col("w.th").alias("th"), "at", "size", F.col("p.r").alias("x"))
        if level:
            tail = at.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), F.col("k").alias("k2"), F.col("r").alias("y"))
            both = both.join(_sorted(tail), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")) & (F.col("k2") == F.col("at") + F.col("size") - (1 << level))).drop("d2", "t2", "k2")
        else:
            both = both.withColumn("y", F.lit(0).cast("long"))
        found = both if found is None else found.unionByName(both)
    if found is None:
        return live.select(*DOC, F.array("no").alias("gone")).limit(0)
    found = materialize(found, "line-found")
    first = found.groupBy("size", "x", "y").agg(F.min(F.struct(*DOC, "at")).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    here = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    later = _met(found, first, ["size", "x", "y"]).where(~here | (F.col("at") >= F.col("first.at") + F.col("size")))
    gone = later.select(*DOC, F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("at")).distinct()
    x, y = gone.alias("g"), live.alias("l")
    same = F.col("g.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("g.th") == F.col("l.th")) & (F.col("g.at") == F.col("l.k"))
    lost = x.join(_sorted(y), same).select(F.col("g.doc_id").alias("doc_id"), F.col("g.th").alias("th"), "no")
    return materialize(lost.groupBy(*DOC).agg(F.sort_array(F.collect_set("no")).alias("gone")), "line-gone")


def _marks(gone: str) -> Column:
    """A byte for each line up to the last of `gone`, in order: 1 for those in it, else 0. A byte is found
    by its place at once, where looking for a number in an array is a walk."""
    zeros = F.transform(gone, lambda g, i: F.repeat(F.lit("0"), g - F.coalesce(F.get(gone, i - 1) + 1, F.lit(0))))
    return F.concat(F.array_join(zeros, "1"), F.lit("1")).cast("binary")


def dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs with text cut, plus n_lines (lines with a word) and n_removed; one row per row.

    Later copies of runs of at least min_words words (see repeated_lines) lose their lines;
    everything else, lines without a word included, stays as it is, joined by newlines. The first
    copy, by doc_id (null first), then a hash of the text, then place, stays; lines are told apart
    by 96-bit hashes, texts of one doc_id by 64-bit ones. Null and empty texts stay as they
    are; rows equal in doc_id and text share one fate. Columns of docs keep their places, but for
    columns called n_lines or n_removed, which are replaced; n_chars is counted anew if present.
    """
    gone = repeated_lines(docs, min_words).select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th"), F.size("gone").alias("__lost"), _marks("gone").alias("__marks"))
    out = docs.drop("n_lines", "n_removed").withColumn("__at", F.xxhash64(F.coalesce("text", F.lit(""))))
    gone = _sorted(gone)
    out = out.join(gone, out["doc_id"].eqNullSafe(gone["__doc"]) & (out["__at"] == gone["__th"]), "left")
    # The lambda reads joined columns only: a computed one would be computed again for each line.
    kept = F.expr(r"array_join(filter(split(text, '\n'), (x, i) -> substring(__marks, i + 1, 1) <> X'31'), '\n')")
    out = out.withColumn("n_lines", F.coalesce(F.expr(r"size(filter(split(text, '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]'))"), F.lit(0)))
    out = out.withColumn("n_removed", F.coalesce("__lost", F.lit(0)))
    out = out.withColumn("text", F.when(F.col("__marks").isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*names, "n_lines", "n_removed")

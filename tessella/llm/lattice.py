"""SentencePiece encoding and decoding as a relational lattice.

Arrow tasks explode the bounded-length substrings of a batch's distinct words, equi-join them to the
piece table and group the edges by word; Spark's higher-order `aggregate` folds each word's edges
(Viterbi). All columns of a batch are arrays, so nothing is done word by word in Python.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ._shared import by_spark_only, byte_slices, materialize, new_scratch, opened, row_slices
from .unigram import SPACE, Pieces

# An edge of the lattice is one long: its end (34 bits), its length (8), its code (22). In order,
# edges go by end, then by length. The code is a piece's id, or, from the size of the table on, the
# number of a character that is spelled in bytes.
CODE = (1 << 22) - 1
#: Characters of which the edges are found at once, and bytes of text in a batch.
BLOCK_CHARS, BATCH_BYTES = 1 << 18, 1 << 20


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """By code point: 0 other, 1 letter, 2 SPACE, 3 newline."""
    kinds = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), np.uint8, 0x110000)
    kinds[ord(SPACE)], kinds[ord("\n")] = 2, 3
    return kinds


def _letters(texts: str) -> np.ndarray:
    return np.frombuffer(texts.encode("utf-32-le"), "<u4")


NO_WORDS = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))


@lru_cache(maxsize=1)
def known_words(path: str) -> tuple[pa.Array, pa.ListArray]:
    """The words of a table that common_words wrote, and their ids; a worker reads it once for all its tasks.
    A path without a scheme is one of Spark's files."""
    system, top = opened(path if ":" in path else f"file://{SparkFiles.get(path)}")
    names = sorted(f.path for f in system.get_file_info(pafs.FileSelector(top)) if f.path.endswith(".parquet"))
    parts = [pq.read_table(n, filesystem=system) for n in names]
    if not sum(map(len, parts)):
        return NO_WORDS
    word, ids = pa.concat_tables(parts).combine_chunks().columns
    return word.combine_chunks().cast(pa.string()), ids.combine_chunks().cast(pa.list_(pa.int32()))


class Lattice:
    """The lattices of a batch's words against a piece table."""

    def __init__(self, pieces: Pieces):
        self.longest = max(map(len, (p for p, _, _ in pieces.rows)))
        self.scores = np.full(max(i for _, i, _ in pieces.rows) + 1, pieces.unknown)
        self.unknown, self.bytes = pieces.unknown, np.asarray(pieces.byte_ids, np.int32)
        self.tables: dict[int, tuple[pa.Array, np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[tuple[str, int]]] = {}
        for piece, i, score in pieces.rows:
            self.scores[i] = score
            by_length.setdefault(len(piece), []).append((piece, i))
        for n, rows in by_length.items():
            spelled = _letters("".join(p for p, _ in rows)).reshape(-1, n)
            mixed = np.zeros(len(rows), np.uint64)
            for k in range(n):
                mixed = self._mix(mixed, spelled[:, k])
            if len(np.unique(mixed)) != len(rows):
                raise ValueError("two pieces have one hash")
            self.tables[n] = pa.array(mixed), spelled, np.asarray([i for _, i in rows], np.int32)

    @staticmethod
    def _mix(mixed: np.ndarray, letters: np.ndarray) -> np.ndarray:
        return (mixed + letters.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    def edges(self, words: pa.Array) -> tuple[pa.ListArray, list[list[int]]]:
        """The edges to each end of each word, and the byte ids of the characters without a piece.

        Substrings meet the pieces of their length by a 64-bit hash, and every match is compared
        letter by letter.
        """
        text = "".join(words.to_pylist())
        letters = _letters(text)
        sizes = np.asarray(pc.utf8_length(words), np.int64)
        stops = np.cumsum(sizes)
        stop, first = np.repeat(stops, sizes), np.repeat(stops - sizes, sizes)
        strange = np.unique(letters[~np.isin(letters, self.tables[1][1][:, 0] if 1 in self.tables else [])])
        keys, counts = [], []
        for lo in range(0, len(letters), BLOCK_CHARS):
            hi = min(lo + BLOCK_CHARS, len(letters))
            at = np.arange(max(0, lo - self.longest + 1), hi)
            mixed, codes = np.zeros(len(at), np.uint64), np.full((hi - lo, self.longest), -1, np.int32)
            for n in range(1, self.longest + 1):
                room = at + n <= np.minimum(stop[at], hi)
                at, mixed = at[room], mixed[room]
                mixed = self._mix(mixed, letters[at + n - 1])
                if n in self.tables:
                    hashes, spelled, ids = self.tables[n]
                    met = pc.index_in(pa.array(mixed), value_set=hashes).fill_null(-1).to_numpy(zero_copy_only=False)
                    hit = np.flatnonzero((met >= 0) & (at + n > lo))
                    met, start = met[hit], at[hit]
                    same = np.ones(len(hit), bool)
                    for k in range(n):
                        same &= spelled[met, k] == letters[start + k]
                    codes[start[same] + n - 1 - lo, n - 1] = ids[met[same]]
                if n == 1:
                    bare = np.flatnonzero(codes[:, 0] < 0)
                    codes[bare, 0] = len(self.scores) + np.searchsorted(strange, letters[lo + bare])
            end, n = np.nonzero(codes >= 0)
            keys.append((end + lo - first[end + lo] + 1) << 30 | (n + 1) << 22 | codes[end, n])
            counts.append(np.count_nonzero(codes >= 0, axis=1))
        upto = np.concatenate([[0], np.cumsum(np.concatenate([*counts, np.empty(0, np.int64)]))]).astype(np.int32)
        ends = pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate([*keys, np.empty(0, np.int64)]), pa.int64()))
        spelled = [self.bytes[list(chr(c).encode("utf-8"))].tolist() for c in strange.tolist()]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), ends), spelled

    def split(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of marked texts, and the offsets of each text among them. No piece crosses from
        one word to the next: cuts are before runs of SPACE, about newlines, and between letters
        and others."""
        joined = "".join(texts)
        letters = _letters(joined)
        kinds, cut = _kinds()[letters], np.zeros(len(letters), bool)
        tops = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        left, right = kinds[:-1], kinds[1:]
        cut[1:] = (left == 3) | (right == 3) | ((right == 2) & (left != 2)) | (left + right == 1)
        cut[tops[:-1][tops[:-1] < len(letters)]] = True
        begin = np.flatnonzero(cut)
        wide = 1 + (letters >= 0x80).astype(np.int32) + (letters >= 0x800) + (letters >= 0x10000)
        byte = np.concatenate([[0], np.cumsum(wide)]).astype(np.int32)
        offsets = np.concatenate([byte[begin], byte[-1:]]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(joined.encode("utf-8")))
        return words.dictionary_encode(), np.searchsorted(begin, tops)

    def batch(self, texts: list[str], rows: list[pa.Array], names: list[str], whole: bool = False, table: str | None = None) -> pa.RecordBatch:
        """One row for a batch of texts (or, if whole, of words): `docs` with the columns `rows` and
        each one's words by number; `edges` of the unknown words and `known` ids of those in the
        table, numbered in this order; `scores` and `spelled` by code."""
        if whole:
            words, offsets = pa.array(texts, pa.string()).dictionary_encode(), np.arange(len(texts) + 1)
        else:
            words, offsets = self.split([SPACE + t.replace(" ", SPACE) if t else "" for t in texts])
        distinct = words.dictionary
        table_words, table_ids = known_words(table) if table else NO_WORDS
        at = pc.index_in(distinct, value_set=table_words)
        new = at.is_null().to_numpy(zero_copy_only=False)
        edges, spelled = self.edges(distinct.filter(pa.array(new)))
        number = np.where(new, np.cumsum(new) - 1, new.sum() + np.cumsum(~new) - 1).astype(np.int32)
        known = table_ids.take(at.drop_null())
        parts = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(number[words.indices.to_numpy()], pa.int32()))
        docs = pa.StructArray.from_arrays([*rows, parts], [*names, "words"])
        scores = np.concatenate([self.scores, np.full(len(spelled), self.unknown)])
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        columns = {"docs": docs, "edges": edges, "known": known, "scores": pa.array(scores), "spelled": pa.array(spelled, pa.list_(pa.int32()))}
        return pa.RecordBatch.from_arrays([one(v) for v in columns.values()], list(columns))


def _best_path(ends: Column, scores: Column, longest: int, size: int = 256) -> Column:
    """Folds the ends, in order, into the best (cost, negated edge) to each: array<array<struct>>,
    the word's beginning first.

    Costs are negated scores. The least pair is the best score and, among equals, the earliest
    start. It is folded in runs of `size` ends, of which each begins with the last `longest` pairs
    of the one before, so that no long array is copied at each step.
    """

    def step(a: Column, edges: Column) -> Column:
        pair = lambda k: F.struct((F.element_at(a, -_len(k))["cost"] - F.get(scores, k.bitwiseAND(CODE).cast("int"))).alias("cost"), (-k).alias("x"))
        return F.array_append(a, F.array_min(F.transform(edges, pair)))

    def run(a: Column, part: Column) -> Column:
        last = F.when(F.size(a["last"]) > longest, F.slice(a["last"], -longest, longest)).otherwise(a["last"])
        keep = lambda s: F.struct(s.alias("last"), F.array_append(a["outs"], F.slice(s, F.size(s) - F.size(part) + 1, F.size(part))).alias("outs"))
        return F.aggregate(part, last, step, keep)

    zero = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("x")))
    cut = lambda a, n: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / n).cast("int")), lambda j: F.slice(a, j * n + 1, F.lit(n)))
    parts = F.flatten(F.transform(cut(ends, size << 8), lambda a: cut(a, size)))  # twice, since a slice walks all that it is cut from
    many = F.aggregate(parts, F.struct(zero.alias("last"), F.array(zero).alias("outs")), run, lambda a: a["outs"])
    return F.when(F.size(ends) <= size, F.array(F.aggregate(ends, zero, step))).otherwise(many)


def _len(k: Column) -> Column:
    return F.shiftright(k, 22).bitwiseAND(255).cast("int")


def _walk(back: Column, spelled: Column, size: int) -> Column:
    """The path's ids in order, found from the end backwards; bytes spell a code from `size` on."""

    def step(b: Column, pair: Column) -> Column:
        x = pair["x"]
        code = (-x).bitwiseAND(CODE).cast("int")
        ids = F.when(code < size, F.array(code)).otherwise(F.reverse(F.get(spelled, code - size)))
        stay = F.struct((b["skip"] - 1).alias("skip"), b["out"].alias("out"))
        take = F.struct((_len(-x) - 1).alias("skip"), F.concat(b["out"], ids).alias("out"))
        return F.when((b["skip"] > 0) | (x == 0), stay).otherwise(take)

    def run(a: Column, part: Column) -> Column:
        start = F.struct(a["skip"].alias("skip"), F.array().cast("array<int>").alias("out"))
        done = lambda b: F.struct(b["skip"].alias("skip"), F.array_append(a["outs"], b["out"]).alias("outs"))
        return F.aggregate(F.reverse(part), start, step, done)

    zero = F.struct(F.lit(0).alias("skip"), F.array().cast("array<array<int>>").alias("outs"))
    return F.aggregate(F.reverse(back), zero, run, lambda a: F.reverse(F.flatten(a["outs"])))


def _folded(batches: DataFrame, pieces: Pieces) -> DataFrame:
    """The rows of `docs`, each with ids: its words' ids, one after the other."""
    size = max(i for _, i, _ in pieces.rows) + 1
    one = lambda e: _walk(_best_path(e, F.col("scores"), pieces.longest), F.col("spelled"), size)
    rows = batches.select("docs", F.concat(F.transform("edges", one), "known").alias("ids"))
    kept = [f.name for f in batches.schema["docs"].dataType.elementType.fields if f.name != "words"]
    ids = lambda d: F.flatten(F.transform(d["words"], lambda i: F.get(F.col("ids"), i)))
    docs = F.transform("docs", lambda d: F.struct(*(d[c].alias(c) for c in kept), ids(d).alias("ids")))
    return rows.select(F.explode(docs).alias("d")).select("d.*")


def _batched(rows: DataFrame, text: str, lattice: Lattice, whole: bool = False, table: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Batches (see Lattice.batch) of rows, whose column `text` is not null; the other columns go along."""
    kept = [c for c in rows.columns if whole or c != text]
    shared = rows.sparkSession.sparkContext.broadcast(lattice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(rows_names.index(text))
            for lo, hi in byte_slices(texts, batch_bytes):
                columns = [b.column(rows_names.index(c)).slice(lo, hi - lo) for c in kept]
                yield shared.value.batch(texts.slice(lo, hi - lo).to_pylist(), columns, kept, whole, table)

    rows_names = rows.columns
    fields = ", ".join(f"`{c}`: {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"docs array<struct<{fields}, words: array<int>>>, edges array<array<array<bigint>>>, known array<array<int>>, scores array<double>, spelled array<array<int>>")


def common_words(docs: DataFrame, pieces: Pieces, frequent: int, sample_docs: int, max_letters: int = 32) -> str:
    """The folder of a table (word, ids) of the most frequent words, of max_letters at most, of about
    sample_docs documents.

    Of bounded size, and on the shared folder only: neither driver nor broadcast holds it, each
    worker reads it once. Where only Spark opens the shared folder, each executor fetches its files
    once (SparkContext.addFile) and the folder's name is returned. Which words stand here does not change any result: it only says which
    are encoded once for all and not in each batch.
    """
    spark, n = docs.sparkSession, docs.count()
    some = docs if n <= sample_docs else docs.sample(sample_docs / n, seed=1)
    lattice = spark.sparkContext.broadcast(Lattice(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, _ = lattice.value.split([SPACE + t.replace(" ", SPACE) for t in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)))], names=["word", "n"])

    counts = some.where("text <> ''").select("text").mapInArrow(run, "word string, n long").where(F.length("word") <= max_letters)
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(frequent).select("word")
    top = materialize(top, "lattice-top").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    found, path = _folded(_batched(top, "word", Lattice(pieces), whole=True), pieces), new_scratch(spark, "lattice-words")
    found.write.parquet(path)
    if by_spark_only(path):
        spark.sparkContext.addFile(path, recursive=True)
        return path.rpartition("/")[2]
    return path


def encode(docs: DataFrame, pieces: Pieces, frequent: int = 393_216, sample_docs: int = 32_768) -> DataFrame:
    """(doc_id, th, ids array<int>): one row per row of docs, th the text's 64-bit hash.

    Nothing is shuffled but the counts of the sample's words: a batch of texts is one row until its
    words are folded. The result is written, so that what is built on it (decode, for one) runs
    after the encoders have ended and not beside them. Frequent words are looked up in a table of bounded size (common_words), all
    others go through the lattice, once in each batch. A null or empty text has no ids. Rows that
    repeat doc_id and text are encoded each for itself; ties go by the earliest start; columns
    other than doc_id and text are ignored, whatever their names. An empty table gives an empty
    result; any length of a text or a word is encoded whole.
    """
    pieces = pieces.useful()
    if pieces.longest > 255 or max(i for _, i, _ in pieces.rows) > CODE - 0x110000:
        raise ValueError("pieces of over 255 characters, or too many ids")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    table = common_words(rows, pieces, frequent, sample_docs)
    return materialize(_folded(_batched(rows.withColumn("th", F.xxhash64("text")), "text", Lattice(pieces), table=table), pieces), "lattice-ids")


def decode(coded: DataFrame, pieces: Pieces, ids_col: str = "ids") -> DataFrame:
    """coded plus decoded: the text of ids. Ids that are no piece of the table give nothing.

    Map only, by Arrow batch: the pieces' bytes are looked up by id and joined. A null ids gives
    null; bytes that are no UTF-8 give replacement characters. A column called decoded is replaced.
    """
    size = max([i for _, i, _ in pieces.rows] + list(pieces.byte_ids)) + 1
    spell = [b""] * (size + 1)
    for piece, i, _ in pieces.rows:
        spell[i] = piece.replace(SPACE, " ").encode("utf-8")
    for b, i in enumerate(pieces.byte_ids):
        spell[i] = bytes([b])
    shared = coded.sparkSession.sparkContext.broadcast(pa.array(spell, pa.binary()))
    rows = coded.drop("decoded")
    names, at = [*rows.columns, "decoded"], rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.list_value_length(whole.column(at)).fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi in row_slices(sizes, 1 << 18):
                b = whole.slice(lo, hi - lo)
                ids = b.column(at)
                codes = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                parts = shared.value.take(pa.array(np.where((codes < 0) | (codes > size), size, codes), pa.int32()))
                offsets = np.concatenate([[0], np.cumsum(sizes[lo:hi])]).astype(np.int32)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), parts, mask=ids.is_null()), pa.scalar(b"", pa.binary()))
                try:
                    text = joined.cast(pa.string())
                except pa.ArrowInvalid:
                    text = pa.array([None if x is None else x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, pc.utf8_slice_codeunits(text, 1)], names=names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded", StringType())]))

"""Toxicity: a linear-chain conditional random field tags toxic spans; marginals make the score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import held_out, materialize

TOKEN = re.compile(r"[^\W\d_]+")
OTHER = 0
STEM = 5


def tokens(text: str | None) -> list[str]:
    return [w.lower() for w in TOKEN.findall(text or "")]


def stem(word: str) -> str:
    """The first letters of a longer word, marked: a feature that words not seen before share."""
    return word[:STEM] + "+" if len(word) > STEM else ""


# --- the field: states 0 (clean) and 1 (toxic); emissions count for state 1 against state 0


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, step: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of state 1 [T, B], expected transitions [2, 2] and the log partition, for a padded
    block [T, B] whose columns are ordered by falling length. Scaled, so that any length is safe."""
    total, width = emissions.shape
    odds = np.exp(np.clip(emissions, -30, 30))
    jump = np.exp(step)
    alive = (lengths[None, :] > np.arange(total)[:, None]).sum(axis=1)
    a, scale = np.zeros((total, 2, width)), np.ones((total, width))
    for t in range(total):
        k = alive[t]
        if t == 0:
            zero, one = np.ones(k), odds[0, :k] * np.exp(start)
        else:
            p, q = a[t - 1, 0, :k], a[t - 1, 1, :k]
            zero, one = p * jump[0, 0] + q * jump[1, 0], (p * jump[0, 1] + q * jump[1, 1]) * odds[t, :k]
        scale[t, :k] = zero + one
        a[t, 0, :k], a[t, 1, :k] = zero / scale[t, :k], one / scale[t, :k]
    marginal, moves = np.zeros((total, width)), np.zeros((2, 2))
    b = np.ones((2, width))
    for t in range(total - 1, -1, -1):
        k = alive[t]
        if t + 1 < total and alive[t + 1]:
            n = alive[t + 1]
            zero, one = b[0, :n] / scale[t + 1, :n], b[1, :n] * odds[t + 1, :n] / scale[t + 1, :n]
            for i in (0, 1):
                for j, back in ((0, zero), (1, one)):
                    moves[i, j] += float((a[t, i, :n] * jump[i, j] * back).sum())
            b[0, :n], b[1, :n] = jump[0, 0] * zero + jump[0, 1] * one, jump[1, 0] * zero + jump[1, 1] * one
        marginal[t, :k] = a[t, 1, :k] * b[1, :k]
    return marginal, moves, float(np.log(scale).sum())


def _blocks(rows: list[np.ndarray], cells: int = 1_000_000) -> Iterator[np.ndarray]:
    """Indices of rows, longest first, in blocks of at most so many padded cells (or one row)."""
    order = np.argsort([-len(r) for r in rows], kind="stable")
    at = 0
    while at < len(order):
        n = max(1, min(512, cells // max(1, len(rows[order[at]]))))
        yield order[at : at + n]
        at += n


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), int(lengths.max(initial=0))))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return np.ascontiguousarray(out.T), lengths


@dataclass(frozen=True)
class Model:
    """words: id of each known word or stem, 0 for others; weight: its emission, a token's being the
    sum of its word's and its stem's; step, start: transitions;
    blend: document score = sigmoid(blend . (1, log(1 + expected toxic tokens), any marginal >= 1/2))."""

    words: dict[str, int]
    weight: np.ndarray
    step: np.ndarray
    start: float
    blend: np.ndarray

    def ids(self, text: str | None) -> np.ndarray:
        """[tokens, 2]: the ids of each token's word and stem."""
        get, found = self.words.get, tokens(text)
        return np.array([[get(w, OTHER) for w in found], [get(w[:STEM] + "+", OTHER) if len(w) > STEM else OTHER for w in found]], dtype=np.int32).T

    def marginals(self, texts: list[str | None]) -> list[np.ndarray]:
        rows = [self.weight[self.ids(t)].sum(axis=1) for t in texts]
        out: list[np.ndarray] = [np.empty(0)] * len(rows)
        for block in _blocks(rows):
            if len(rows[block[0]]):
                emissions, lengths = _padded([rows[i] for i in block])
                p, _, _ = forward_backward(emissions, lengths, self.step, self.start)
                for j, i in enumerate(block):
                    out[i] = p[: lengths[j], j].copy()
        return out

    def features(self, p: np.ndarray) -> np.ndarray:
        return np.array([1.0, np.log1p(p.sum()), float(p.max(initial=0.0) >= 0.5)])

    def score(self, p: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(p) @ self.blend, -40, 40))))


def fit_field(segments: list[tuple[np.ndarray, np.ndarray]], size: int, rounds: int = 40, rate: float = 0.1, decay: float = 0.1) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights that maximise the penalised likelihood of the tagged segments (ids [n, 2], tags).

    Adam steps from each word's own log odds; a word that the segments lack starts like the others.
    """
    theta = np.zeros(size + 5)
    if not segments:
        return theta[:size] - 4.0, np.zeros((2, 2)), 0.0
    blocks, seen, here, moved, first = [], np.zeros(size), np.zeros(size), np.zeros((2, 2)), 0.0
    for block in _blocks([s[0] for s in segments]):
        pairs = [_padded([segments[i][0][:, f] for i in block]) for f in (0, 1)]
        blocks.append(([ids.astype(np.int32) for ids, _ in pairs], pairs[0][1]))
    for ids, tags in segments:
        for f in (0, 1):
            here += np.bincount(ids[:, f], minlength=size)
            seen += np.bincount(ids[:, f], weights=tags, minlength=size)
        np.add.at(moved, (tags[:-1], tags[1:]), 1)
        first += float(tags[0])
    theta[:size] = np.log((seen + 0.1) / (here - seen + 1.0)) / 2
    theta[:size][here == 0] = theta[OTHER]
    anchor, mean, var = theta.copy(), 0.0, 0.0
    for r in range(1, rounds + 1):
        weight, step, start = theta[:size], theta[size : size + 4].reshape(2, 2), theta[size + 4]
        grad_w, grad_t, grad_s = seen.copy(), moved.copy(), first
        for features, lengths in blocks:
            p, moves, _ = forward_backward(weight[features[0]] + weight[features[1]], lengths, step, start)
            live = lengths[None, :] > np.arange(len(p))[:, None]
            for ids in features:
                grad_w -= np.bincount(ids[live], weights=p[live], minlength=size)
            grad_t -= moves
            grad_s -= float(p[0].sum())
        grad = np.concatenate([grad_w, grad_t.ravel(), [grad_s]]) - decay * (theta - anchor)
        mean, var = 0.8 * mean + 0.2 * grad, 0.99 * var + 0.01 * grad**2
        theta = theta + rate * (mean / (1 - 0.8**r)) / (np.sqrt(var / (1 - 0.99**r)) + 1e-8)
    return theta[:size], theta[size : size + 4].reshape(2, 2), float(theta[size + 4])


def fit_blend(x: np.ndarray, y: np.ndarray, decay: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w))
        w = w + np.linalg.solve(hess, x.T @ (y - p) - decay * w)
    return w


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = 6000, max_words: int = 8192, max_segments: int = 6000, segment: int = 128, min_docs: int = 5, min_contexts: int = 8, purity: int = 8) -> Model:
    """Fit on a bounded sample: the max_docs labelled documents, not held out, with the smallest hash.

    Document labels are turned into token tags: a word or stem that stands in at least min_docs
    toxic sample documents, in `purity` times as many as clean ones, and there after at least
    min_contexts different words (copies of one document have one), is tagged where it stands in a toxic
    document. The field is fitted on at most max_segments runs of `segment` tokens, tagged and
    untagged in halves, over the max_words words and stems that most documents of the sample have. Words
    are counted on the executors; only bounded tables reach the driver. Of several texts under one
    doc_id the one with the smallest hash is learned, whatever the order of the rows.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_docs)
    )
    chosen = materialize(chosen, "toxic-chosen")  # at most max_docs rows
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("toxic").alias("toxic"))
    sample = materialize(sample, "toxic-sample")

    def uses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x, t in zip(b["text"], b["toxic"], strict=True):
                words = tokens(x)
                rows += [(w, None, t) for w in {*words, *map(stem, words)} - {""}]
                if t == 1:
                    pairs = set(zip(["", *words], words, strict=False))
                    rows += [(w, before, 1) for before, w in pairs | {(before, stem(w)) for before, w in pairs} if w]
            yield pd.DataFrame(rows, columns=["word", "before", "toxic"])

    counts = (
        sample.mapInPandas(uses, "word string, before string, toxic int")
        .groupBy("word")
        .agg(
            F.count_if(F.col("before").isNull() & (F.col("toxic") == 1)).alias("bad"),
            F.count_if(F.col("before").isNull() & (F.col("toxic") != 1)).alias("good"),
            F.count_distinct("before").alias("contexts"),
        )
        .where(F.col("bad") + F.col("good") >= min_docs)
        .withColumn("seed", (F.col("bad") >= min_docs) & (F.col("bad") >= purity * F.col("good")) & (F.col("contexts") >= min_contexts))
        .orderBy(F.desc("seed"), F.desc(F.col("bad") + F.col("good")), "word")
        .limit(max_words)
    )
    known = counts.collect()
    words = {r.word: i + 1 for i, r in enumerate(known)}
    seeds = np.zeros(len(words) + 1, bool)
    seeds[[words[r.word] for r in known if r.seed]] = True
    plain = Model(words, np.zeros(len(words) + 1), np.zeros((2, 2)), 0.0, np.zeros(3))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, x, t in zip(b["doc_id"], b["text"], b["toxic"], strict=True):
                ids = plain.ids(x)
                for lo in range(0, len(ids), segment):
                    part = ids[lo : lo + segment]
                    rows.append((d, lo, part.ravel().tolist(), bool(t == 1 and seeds[part].any()), int(t)))
            yield pd.DataFrame(rows, columns=["doc_id", "lo", "ids", "tagged", "toxic"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    cuts = materialize(sample.mapInPandas(cut, f"doc_id {kind}, lo int, ids array<int>, tagged boolean, toxic int"), "toxic-segments")
    # Untagged ones, then tagged ones, each in the order of a hash: two heaps of bounded size.
    best = lambda tagged: cuts.where(F.col("tagged") == tagged).orderBy(F.xxhash64("doc_id", "lo"), "doc_id", "lo").limit(max_segments // 2).select("ids", "toxic")
    parts = pd.concat([best(False).toPandas(), best(True).toPandas()])
    segments = [(ids := np.asarray(i, np.int32).reshape(-1, 2), (seeds[ids].any(axis=1) & (t == 1)).astype(np.int64)) for i, t in zip(parts["ids"], parts["toxic"], strict=True)]
    weight, step, start = fit_field(segments, len(words) + 1)
    field = Model(words, weight, step, start, np.zeros(3))

    def gauge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [field.features(p) for p in field.marginals(b["text"].tolist())]
            yield pd.DataFrame({"x": [v.tolist() for v in x], "toxic": b["toxic"]})

    seen = sample.mapInPandas(gauge, "x array<double>, toxic int").toPandas()
    blend = fit_blend(np.array(seen["x"].tolist()).reshape(-1, 3), seen["toxic"].to_numpy(float)) if len(seen) else np.zeros(3)
    return Model(words, weight, step, start, blend)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", span_at: float = 0.5) -> DataFrame:
    """(doc_id, score, spans): one row per row of docs, map only.

    score is between 0 and 1; a null text, an empty one and one without a letter get the score of
    no toxic token. spans lists (start, stop, prob) of the tokens whose marginal reaches span_at,
    in characters of the text. Repeated rows stay.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("prob", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                texts = b.column(1).to_pylist()
                marginals = model.marginals(texts)
                spans = []
                for x, p in zip(texts, marginals, strict=True):
                    hit = set(np.flatnonzero(p >= span_at).tolist())
                    spans.append([{"start": m.start(), "stop": m.end(), "prob": float(p[i])} for i, m in enumerate(TOKEN.finditer(x)) if i in hit] if hit else [])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(p) for p in marginals], pa.float64()), pa.array(spans, pa.list_(span))], names=["doc_id", "score", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start:int,stop:int,prob:double>>")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", at: float = 0.5) -> DataFrame:
    """docs' rows, with all their columns, whose score is under `at`. Map only; see score()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                scores = [model.score(p) for p in model.marginals(b.column(text_col).to_pylist())]
                yield b.filter(pa.array([s < at for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

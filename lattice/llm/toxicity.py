"""Toxic spans by a linear-chain conditional random field.

Labels are of documents, so token labels are derived first: a feature (a lower-cased word, or its first 4, 5 or 6
letters) that is far more frequent in toxic training documents than in others marks the tokens that have it, in toxic
documents only. A two-label chain (other, toxic) is trained on windows around such tokens and on windows without, by
exact forward-backward gradients in numpy. Only features of those windows have weights, so the bound of the sample
bounds the model that goes to the tasks.

Scoring runs forward-backward over a whole text as one chain: windows of 64 tokens of all texts are worked on side by
side, and the messages that cross their borders come from the products of the windows' transfer matrices. A document's
score is a logistic function of its largest marginal log-odds and its expected number of toxic tokens; tokens over one
half give the offending spans.

The model is fitted on at most SAMPLE labelled documents of each class of at most SAMPLE_CHARS characters, chosen by a
hash; everything is scored. Of several texts of one labelled doc_id the smallest is learned from. Null and empty texts
have no tokens and get the score of no evidence. Without labels of both classes every score is 0. Of repeated labels of a document, toxic wins. Repeated rows are scored one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattice.llm.common import portions, remainder, table

SAMPLE, SAMPLE_CHARS = 1200, 20_000
WINDOW, TRAIN_WINDOW = 64, 24
WORDS = re.compile(r"\w+")


def features(word: str) -> list[str]:
    return ["w" + word, *(f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n)]


@dataclass
class Model:
    weights: dict[str, float]  # of features of the training windows, for the toxic label
    bias: float
    moves: np.ndarray  # transition scores
    logistic: tuple[float, float, float]

    def emission(self, word: str) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in features(word)]) + self.bias


class Emissions(dict):
    def __init__(self, model: Model, limit: int = 200_000):
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.model.emission(word)
        return value


def _after(odds: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Odds of the label at a token, taken one transition on."""
    return (odds * t[1, 1] + t[0, 1]) / (odds * t[1, 0] + t[0, 0])


def _before(odds: np.ndarray, t: np.ndarray) -> np.ndarray:
    return (odds * t[1, 1] + t[1, 0]) / (odds * t[0, 1] + t[0, 0])


def _transfers(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each window (row) of emission odds the matrix that takes odds before it to odds behind it, up to a factor."""
    m = np.broadcast_to(np.eye(2), (len(e), 2, 2)).copy()
    for k in range(e.shape[1]):
        toxic, other = e[:, k, None] * m[:, 0], m[:, 1]
        m = np.stack([t[1, 1] * toxic + t[0, 1] * other, t[1, 0] * toxic + t[0, 0] * other], 1)
        m /= m.sum((1, 2), keepdims=True)
    return m


def document_marginals(lists: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """Marginal log-odds of the toxic label of each document's tokens; a document is one chain."""
    lists = [np.asarray(x, float) for x in lists]
    counts = np.array([-(-len(x) // WINDOW) for x in lists], np.int64)
    if not counts.sum():
        return [np.zeros(0) for _ in lists]
    t = np.exp(moves)
    flat, real = np.zeros((int(counts.sum()), WINDOW)), np.zeros((int(counts.sum()), WINDOW), bool)
    ends = np.cumsum(counts)
    starts = ends - counts
    for x, at in zip(lists, starts * WINDOW):
        flat.reshape(-1)[at : at + len(x)] = np.clip(x, -30, 30)
        real.reshape(-1)[at : at + len(x)] = True
    e = np.exp(flat)
    front, back = np.ones(len(e)), np.ones(len(e))  # odds that come into a window from the left, and into its last token
    if counts.max() > 1:
        inner = np.ones(len(e), bool)
        inner[ends[counts > 0] - 1] = False  # a document's last window passes nothing on
        m = np.zeros((len(e), 2, 2))
        m[inner] = _transfers(e[inner], t)
        last = _backward(e[ends[counts > 0] - 1], real[ends[counts > 0] - 1], np.ones(int((counts > 0).sum())), t)[:, 0] * e[ends[counts > 0] - 1, 0]
        reach = dict(zip((ends[counts > 0] - 1).tolist(), last.tolist()))
        for first, end in zip(starts.tolist(), ends.tolist()):
            if end - first > 1:
                odds = 1.0
                for w in range(first, end - 1):
                    (a, b), (c, d) = m[w]
                    odds = front[w + 1] = (a * odds + b) / (c * odds + d)
                odds = reach[end - 1]  # of a window's first token with all behind it
                for w in range(end - 2, first - 1, -1):
                    back[w] = (odds * t[1, 1] + t[1, 0]) / (odds * t[0, 1] + t[0, 0])
                    (a, b), (c, d) = m[w]
                    odds = (a * odds + c) / (b * odds + d)
    ahead = np.empty_like(e)
    odds = ahead[:, 0] = front * e[:, 0]
    for k in range(1, WINDOW):
        odds = ahead[:, k] = e[:, k] * _after(odds, t)
    out = np.log(np.maximum(ahead, 1e-300)) + np.log(_backward(e, real, back, t))
    line = out.reshape(-1)
    return [line[at : at + len(x)] for x, at in zip(lists, starts * WINDOW)]


def _backward(e: np.ndarray, real: np.ndarray, back: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Odds that come to each token from behind it; back: to each window's last token. Padding passes nothing on."""
    out = np.empty_like(e)
    odds = out[:, -1] = back
    for k in range(e.shape[1] - 2, -1, -1):
        odds = out[:, k] = np.where(real[:, k + 1], _before(e[:, k + 1] * odds, t), 1.0)
    return out


def evidence(odds: np.ndarray) -> tuple[float, float]:
    """A document's two features: the largest log-odds and the log of 1 + the expected number of toxic tokens."""
    if not len(odds):
        return -15.0, 0.0
    return float(np.clip(odds.max(), -15, 15)), float(np.log1p((1 / (1 + np.exp(-np.clip(odds, -30, 30)))).sum()))


def marking_features(words: list[list[str]], toxic: list[int]) -> set[str]:
    """Features whose share of toxic documents is over 20 times that of others, and too often so for chance among very
    many features: a log-likelihood ratio over 12."""
    found = {0: Counter(), 1: Counter()}
    n = Counter(toxic)
    for own, label in zip(words, toxic):
        found[label].update({f for w in set(own) for f in features(w)})

    def marks(f: str, c1: int) -> bool:
        c0, total = found[0][f], n[0] + n[1]
        if (c1 + 0.5) / (n[1] + 1) <= 20 * (c0 + 0.5) / (n[0] + 1):
            return False
        part = lambda c, m: c * np.log(c * total / ((c0 + c1) * m)) if c else 0.0
        return part(c1, n[1]) + part(c0, n[0]) > 12

    return {f for f, c in found[1].items() if c >= 5 and marks(f, c)}


def train(texts: list[str], toxic: list[int], weight: tuple[float, float] = (1.0, 1.0), epochs: int = 6, seed: int = 1) -> Model:
    """weight: what a document of either class counts for in the logistic fit."""
    words = [WORDS.findall(t.lower()) for t in texts]
    marking = marking_features(words, toxic)
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}  # a feature's number; 0 stands for none
    rows, tags = [], []
    for own, label in zip(words, toxic):
        y = [int(bool(label) and any(f in marking for f in features(w))) for w in own]
        starts = []
        for i in np.flatnonzero(y).tolist():  # all marked tokens, each in a window
            if not starts or i >= starts[-1] + TRAIN_WINDOW:
                starts.append(max(0, i - TRAIN_WINDOW // 2))
        starts += rng.integers(0, len(own), 2).tolist() if own else []
        for s in starts:
            part = own[s : s + TRAIN_WINDOW]
            pad = TRAIN_WINDOW - len(part)
            own_features = [[index.setdefault(f, len(index) + 1) for f in features(w)] for w in part]
            rows.append([f + [0] * (4 - len(f)) for f in own_features] + [[0] * 4] * pad)
            tags.append(y[s : s + TRAIN_WINDOW] + [0] * pad)
    model = Model({}, -2.0, np.zeros((2, 2)), (0.0, 0.0, -10.0))
    if not rows or not any(map(any, tags)):
        return model
    x, y, size = np.array(rows), np.array(tags, float), len(index) + 1
    weights = np.zeros(size)
    squares, bias_sq, moves_sq = np.full(size, 1e-3), 1e-3, np.full((2, 2), 1e-3)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            xb, yb = x[order[at : at + 128]], y[order[at : at + 128]]
            scores = weights[xb].sum(2) + model.bias
            d_s, d_t = gradient(scores, model.moves, yb)
            where = xb.reshape(-1)
            g = np.bincount(where, np.repeat(d_s.reshape(-1), 4), size) / len(xb) + 1e-5 * weights
            g[0] = 0
            squares += g * g
            weights -= 0.5 * g / np.sqrt(squares)
            b = d_s.sum() / len(xb)
            bias_sq += b * b
            model.bias -= 0.2 * b / np.sqrt(bias_sq)
            d_t = d_t / len(xb)
            moves_sq += d_t * d_t
            model.moves -= 0.2 * d_t / np.sqrt(moves_sq)
    model.weights = {f: float(weights[k]) for f, k in index.items() if abs(weights[k]) > 0.01}
    cache = Emissions(model)
    odds = document_marginals([np.array([cache[w] for w in own]) for own in words], model.moves)
    model.logistic = fit_logistic(np.array([evidence(o) for o in odds]), np.array(toxic, float), np.array([weight[v] for v in toxic]))
    return model


def gradient(scores: np.ndarray, moves: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative log-likelihood of the labels, by emission score and by transition."""
    n = scores.shape[1]
    emit = np.stack([np.zeros_like(scores), scores], -1)
    a, b = np.empty_like(emit), np.empty_like(emit)
    a[:, 0] = emit[:, 0]
    for k in range(1, n):
        a[:, k] = np.logaddexp(a[:, k - 1, :1] + moves[0], a[:, k - 1, 1:] + moves[1]) + emit[:, k]
    b[:, -1] = 0
    for k in range(n - 2, -1, -1):
        nxt = emit[:, k + 1] + b[:, k + 1]
        b[:, k] = np.logaddexp(moves[:, 0] + nxt[:, :1], moves[:, 1] + nxt[:, 1:])
    z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
    p = np.exp(a[..., 1] + b[..., 1] - z[:, None])
    d_t = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            pair = np.exp(a[:, :-1, i] + moves[i, j] + emit[:, 1:, j] + b[:, 1:, j] - z[:, None])
            seen = (y[:, :-1] == i) & (y[:, 1:] == j)
            d_t[i, j] = pair.sum() - seen.sum()
    return p - y, d_t


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Two slopes and a constant by Newton steps, with a small quadratic penalty."""
    x1, w = np.c_[x, np.ones(len(x))], np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (weight * (p - y)) + 0.1 * w
        h = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 + 0.1 * np.eye(3)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """From labels (doc_id, toxic) and the texts of a bounded sample of each class."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ids = [r for x in (0, 1) for r in known.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    if not ids:
        return train([], [])
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in ids], "doc_id bigint, toxic int")
    texts = docs.select("doc_id", "text").where(F.length("text") <= sample_chars).join(F.broadcast(chosen), "doc_id")
    rows = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()  # at most 2 * sample rows, however often an id repeats
    n = Counter(r["toxic"] for r in rows)
    if len(n) < 2:
        return train([], [])
    return train([r["text"] for r in rows], [r["toxic"] for r in rows], tuple(total[x] / n[x] / (total[0] + total[1]) * len(rows) for x in (0, 1)))


def score(docs: DataFrame, model: Model, carry: bool = False) -> DataFrame:
    """doc_id, score, predicted (1 at a score of one half or more) and the toxic spans in characters. With carry a
    struct row of docs' own columns stands in place of doc_id, so that a verdict stays with its row."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    fields = [("score", pa.float64()), ("predicted", pa.int32()), ("spans", span)]
    a, b, c = model.logistic

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Emissions(model)
        for batch in batches:
            key, at = batch.column(0), 0
            texts = key.field("text") if carry else batch.column(1)
            for part in portions((t or "" for t in texts.to_pylist()), lambda t: len(t) + 100, 2_000_000):
                # Lower-casing may change a text's length; spans are found in the text as it is.
                lists = [np.array([*map(cache.__getitem__, WORDS.findall(t.lower()))], float) for t in part]
                out = []
                for text, odds in zip(part, document_marginals(lists, model.moves)):
                    x, y = evidence(odds)
                    p = float(1 / (1 + np.exp(-np.clip(a * x + b * y + c, -700, 700))))
                    spans = []
                    if x > 0:
                        places = [*WORDS.finditer(text)]
                        if len(places) == len(odds):
                            spans = [{"start": places[k].start(), "end": places[k].end()} for k in np.flatnonzero(odds > 0)]
                    out.append((p, int(p >= 0.5), spans))
                columns = [pa.array(col, f[1]) for col, f in zip(zip(*out), fields)]
                yield pa.RecordBatch.from_arrays([key.slice(at, len(part)), *columns], names=[key_name, *(f[0] for f in fields)])
                at += len(part)

    key_name = "row" if carry else "doc_id"
    given = docs.select(F.struct("*").alias("row")) if carry else docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    made = StructType.fromDDL("score double, predicted int, spans array<struct<start: int, end: int>>")
    return given.mapInArrow(run, StructType([given.schema[0], *made.fields]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(remainder("doc_id", 5) != 0))
    return score(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "spans")

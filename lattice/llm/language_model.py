"""Log-likelihoods of whole texts: a unigram base and a gated recurrent network.

Words are counted over all training documents, exactly and distributed. Words at least as frequent as a threshold that
leaves at most HEAD of them go to every task; the rest of a document's words meet their counts in a join, one row per
document and word, salt-free because no such word is frequent.

The network (numpy) reads words of a vocabulary of CLASSES * CLASS_WORDS frequent words, one symbol for other words
and one for the end. Its softmax is factored: first the class, then the word in its class; other words and the end are
classes of their own. It is trained by backpropagation truncated at UNROLL steps, the state carried from window to
window, on all training documents, whole. A hash deals them to shards of about SHARD tokens; a shard is read in one task,
portion by portion, from the parameters of the round before, and a round's parameters (with the squares that set their
step sizes) are averaged by tokens into a table. The query has one round: each document is read once, whatever the input's
size. Another word's probability is that of its symbol times (c + 1) / (N' + V' + 1) of its count c among
such words, so that the model spreads no more than probability one.

Scoring reads whole documents: they are laid end to end in LANES lanes, and a lane's state is carried across windows
and reset where a document begins.

A null or empty text is the end token alone. Without training documents N and V are 0. Repeated rows are scored one by
one; a null doc_id counts as an empty key of the fold.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.common import cut_at, one_blas_thread, portions, remainder, stored, table, utf8

HEAD, CLASSES, CLASS_WORDS, HIDDEN, LANES = 200_000, 64, 64, 16, 256
UNROLL, EPOCHS = 16, 3
ROUNDS, SHARD, PORTION, PIECE = EPOCHS, 2_000_000, 8_000_000, 4096  # tokens of a shard, characters of a portion, numbers of a row
SPLIT, SCORED = 4_000_000, 3_000_000  # characters split at once, tokens scored at once
OTHER, END = 0, 1  # symbols; words follow, class by class


def _shift(logits: np.ndarray) -> np.ndarray | None:
    """What a row's exponentials are taken relative to: nothing as long as all rows' sums are far from the bounds of a
    float, else each row's maximum."""
    return None if (logits[:, 0] > -40).all() and logits.max(initial=0) < 30 else logits.max(1)


def _exponentials(logits: np.ndarray, shift: np.ndarray | None) -> np.ndarray:
    """Turns logits into exponentials, in place, and gives each row's sum."""
    if shift is not None:
        logits -= shift[:, None]
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], logits.dtype)


def _log_softmax(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the place `at` of each row; the logits are used up."""
    row, shift = np.arange(len(at)), _shift(logits)
    own = logits[row, at].astype(np.float64) - (0 if shift is None else shift)
    return own - np.log(_exponentials(logits, shift))


def _softmax_error(logits: np.ndarray, at: np.ndarray, full: int) -> np.ndarray:
    """Turns logits, in place, into the loss's slopes by them (probability, less one at `at`, over the tokens of a full
    window) but for a factor of each row, which it gives."""
    total = _exponentials(logits, _shift(logits))
    logits[np.arange(len(at)), at] -= total
    return (1 / (full * total))[:, None]


@dataclass
class Network:
    """Symbol s >= 2 is word (s - 2) % CLASS_WORDS of class 2 + (s - 2) // CLASS_WORDS."""

    n_words: int
    hidden: int = HIDDEN
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def n_classes(self) -> int:
        return 2 + -(-self.n_words // CLASS_WORDS)

    def start(self, counts: np.ndarray, seed: int = 3) -> None:
        """Output biases start at the log frequencies of the symbols."""
        rng, h, c = np.random.default_rng(seed), self.hidden, self.n_classes
        n_slots = (c - 2) * CLASS_WORDS
        f = np.zeros(n_slots)
        f[: self.n_words] = counts[2:]
        grid = f.reshape(c - 2, CLASS_WORDS)
        inside = np.log(np.maximum(grid, 0.5))
        inside[np.arange(n_slots).reshape(grid.shape) >= self.n_words] = -1e4
        by_class = np.log(np.maximum(np.concatenate([counts[:2], grid.sum(1)]), 0.5))
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.p = {
            "x": small(2 + self.n_words, 3 * h), "u": small(h, 3 * h), "b": np.zeros(3 * h, np.float32),
            "wc": small(h, c) * 0.1, "bc": by_class.astype(np.float32),
            "wi": small(c - 2, h, CLASS_WORDS) * 0.1, "bi": inside.astype(np.float32),
        }

    def step(self, h: np.ndarray, symbols: np.ndarray):
        """The states after the symbols, a row for each lane; the gates and the new values."""
        n, lanes = self.hidden, len(h)
        out, new, zr, g = (np.empty((k * n, lanes), h.dtype) for k in (1, 1, 2, 3))
        self._step(h.T, (self.p["x"][symbols] + self.p["b"]).T, out, new, zr, g)
        return out.T, zr.T, new.T

    def _step(self, h: np.ndarray, a: np.ndarray, out: np.ndarray, new: np.ndarray, zr: np.ndarray, g: np.ndarray) -> None:
        """A row for each unit, a column for each lane, so that every gate is one piece of memory; fills the last four."""
        n = self.hidden
        np.matmul(self.p["u"].T, h, out=g)
        np.add(a[: 2 * n], g[: 2 * n], out=zr)
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        np.multiply(zr[n:], g[2 * n :], out=new)
        new += a[2 * n :]
        np.tanh(new, out=new)
        np.subtract(h, new, out=out)
        out *= zr[:n]
        out += new

    def _read(self, reads: np.ndarray) -> np.ndarray:
        """What the symbols (time, lane) add to the gates: time, unit, lane."""
        a = self.p["x"].take(reads.ravel(), 0)
        a += self.p["b"]
        return np.ascontiguousarray(a.reshape(*reads.shape, -1).transpose(0, 2, 1))

    def _by_class(self, of: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Rows of words in order of their classes, and where each class that occurs begins and ends there."""
        order = np.argsort(of.astype(np.int16), kind="stable")  # a radix sort
        bounds = np.searchsorted(of[order], np.arange(2, self.n_classes + 1)) if self.n_classes > 2 else np.array([len(of)])
        bounds, order = bounds - bounds[0], order[bounds[0] :]
        return order, [(c, i, j) for c, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if j > i]

    def _with_bias(self) -> tuple[np.ndarray, np.ndarray]:
        """The softmaxes' weights, with their biases as a last row that meets a one behind each state."""
        p = self.p
        return np.concatenate([p["wc"], p["bc"][None]]), np.concatenate([p["wi"], p["bi"][:, None]], 1)

    def log_probs(self, h: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural logs of the symbols' probabilities, given the states before them."""
        return self._log_probs(np.concatenate([h, np.ones((len(h), 1), h.dtype)], 1), symbols, *self._with_bias())

    def _log_probs(self, h: np.ndarray, symbols: np.ndarray, wc: np.ndarray, wi: np.ndarray) -> np.ndarray:
        """Of states with a one behind."""
        of = np.where(symbols < 2, symbols, 2 + (symbols - 2) // CLASS_WORDS)
        out = _log_softmax(h @ wc, of)
        order, classes = self._by_class(of)
        h, inner = h.take(order, 0), np.empty((len(order), CLASS_WORDS), h.dtype)
        for c, i, j in classes:
            np.matmul(h[i:j], wi[c], out=inner[i:j])
        out[order] += _log_softmax(inner, (symbols[order] - 2) % CLASS_WORDS)
        return out

    def fresh(self) -> dict[str, np.ndarray]:
        return {k: np.full(v.shape, 1e-6, np.float32) for k, v in self.p.items()}

    def flat(self, memory: dict) -> np.ndarray:
        """All parameters and their memory in one row."""
        return np.concatenate([of[k].ravel() for of in (self.p, memory) for k in self.p])

    def load(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Takes the parameters of such a row and gives the memory."""
        parts, at = [], 0
        for k, v in [*self.p.items()] * 2:
            parts.append((k, flat[at : at + v.size].reshape(v.shape).astype(np.float32)))
            at += v.size
        self.p = dict(parts[: len(self.p)])
        return dict(parts[len(self.p) :])

    def train(self, documents: list[np.ndarray], lanes: int = 32, epochs: int = EPOCHS, rate: float = 0.02, seed: int = 5, memory: dict | None = None) -> None:
        """documents: symbols, each with END last. A document begins from the zero state, with END as what was read. All
        documents are laid end to end and cut into lanes of one length, so that no lane trains on alone at the end."""
        rng = np.random.default_rng(seed)
        memory = self.fresh() if memory is None else memory
        n = sum(map(len, documents))
        lanes = max(1, min(lanes, n // UNROLL))
        for _ in range(epochs):
            stream = np.full((lanes, -(-n // lanes)), -1, np.int32)
            stream.ravel()[:n] = np.concatenate([documents[i] for i in rng.permutation(len(documents))])
            h, before = np.zeros((lanes, self.hidden), np.float32), np.concatenate([[END], stream[:-1, -1]])
            before = np.where(before < 0, END, before)
            for at in range(0, stream.shape[1], UNROLL):
                h, before = self._window(stream[:, at : at + UNROLL], h, before, memory, rate)

    def _window(self, target: np.ndarray, h: np.ndarray, before: np.ndarray, memory: dict, rate: float):
        grad, (read, d_read), h, before = self._gradients(target, h, before)
        for k, g in grad.items():
            memory[k] += (0.01 if k in ("wc", "bc", "u", "b") else 1.0) * g * g
            if k in ("wc", "bc", "u", "b"):
                memory[k] *= 0.99
            g *= rate
            g /= np.sqrt(memory[k])
            self.p[k] -= g
        squares = memory["x"][read] + d_read * d_read  # symbols that weren't read have no gradient
        memory["x"][read] = squares
        self.p["x"][read] -= (rate * d_read / np.sqrt(squares)).astype(np.float32)
        return h, before

    def gradients(self, target: np.ndarray, h: np.ndarray, before: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """Of a window's loss, the mean of the negative log-probabilities; the states and symbols that go on."""
        grad, (read, d_read), h, before = self._gradients(target, h, before)
        grad["x"] = np.zeros_like(self.p["x"])
        grad["x"][read] = d_read
        return grad, h, before

    def _gradients(self, target: np.ndarray, h: np.ndarray, before: np.ndarray):
        """As gradients, but "x" apart: the symbols that were read, and their rows."""
        p, n, kind = self.p, self.hidden, self.p["u"].dtype
        lanes, length = target.shape
        target = target.T
        after = np.where(target < 0, END, target)
        reads = np.concatenate([before[None], after[:-1]])
        goes_on = (reads != END).astype(kind)[:, None]  # a document begins from the zero state
        a = self._read(reads)
        starts, states, new = np.empty((3, length, n, lanes), kind)
        zr, g = np.empty((length, 2 * n, lanes), kind), np.empty((length, 3 * n, lanes), kind)
        h = h.T
        for k in range(length):
            np.multiply(h, goes_on[k], out=starts[k])
            self._step(starts[k], a[k], states[k], new[k], zr[k], g[k])
            h = states[k]
        live = np.flatnonzero(target >= 0)
        symbols = target.ravel()[live]
        full = lanes * UNROLL  # a shorter window counts by its tokens
        of = np.where(symbols < 2, symbols, 2 + (symbols - 2) // CLASS_WORDS)
        wc, wi = self._with_bias()
        hs = self._rows(states, live)
        e = hs @ wc
        factor = _softmax_error(e, of, full)
        d_h = e @ p["wc"].T
        d_h *= factor
        of_classes = (hs * factor).T @ e
        order, classes = self._by_class(of)
        inside = (np.empty_like if len(classes) == len(wi) else np.zeros_like)(wi)
        hs, e, d_inner = hs.take(order, 0), np.empty((len(order), CLASS_WORDS), kind), np.empty((len(order), n), kind)
        for c, i, j in classes:
            np.matmul(hs[i:j], wi[c], out=e[i:j])
        factor = _softmax_error(e, (symbols[order] - 2) % CLASS_WORDS, full)
        hs *= factor
        for c, i, j in classes:
            np.matmul(hs[i:j].T, e[i:j], out=inside[c])
            np.matmul(e[i:j], p["wi"][c].T, out=d_inner[i:j])
        d_inner *= factor
        d_inner += d_h.take(order, 0)
        d_h[order] = d_inner
        d_states = np.zeros((length * lanes, n), kind)
        d_states[live] = d_h
        d_states = np.ascontiguousarray(d_states.reshape(length, lanes, n).transpose(0, 2, 1))
        d_g, d_a, d_u, carry = g, a, 0, 0  # in the place of what isn't read again
        for k in reversed(range(length)):
            z, r, own = zr[k, :n], zr[k, n:], d_g[k]
            d = d_states[k]
            d += carry
            by_new = new[k] * new[k]
            np.subtract(1, by_new, out=by_new)
            by_new -= z * by_new
            by_new *= d  # the slope by what tanh takes
            by_r = own[2 * n :] * by_new
            by_r *= r
            by_r -= r * by_r
            by_z = starts[k] - new[k]
            by_z *= d
            by_z *= z
            by_z -= z * by_z
            own[:n], own[n : 2 * n] = by_z, by_r
            np.multiply(by_new, r, out=own[2 * n :])
            d_a[k, : 2 * n], d_a[k, 2 * n :] = own[: 2 * n], by_new
            d_u = d_u + starts[k] @ own.T
            d *= z
            d += p["u"] @ own
            d *= goes_on[k]
            carry = d
        grad = {"u": d_u, "wc": of_classes[:-1], "bc": of_classes[-1], "wi": inside[:, :-1], "bi": inside[:, -1]}
        d_a = np.ascontiguousarray(d_a.transpose(0, 2, 1)).reshape(-1, 3 * n)
        grad["b"] = np.ones(len(d_a), kind) @ d_a
        read = reads.ravel()
        order = np.argsort(read.astype(np.int16) if len(p["x"]) < 1 << 15 else read, kind="stable")
        read = read[order]
        first = np.flatnonzero(np.concatenate([[True], read[1:] != read[:-1]]))
        return grad, (read[first], np.add.reduceat(d_a.take(order, 0), first)), states[-1].T, after[-1]

    def _rows(self, states: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Of states (time, unit, lane) those of the live places, a row for each, with a one behind."""
        out = np.ones((states.shape[0], states.shape[2], self.hidden + 1), states.dtype)
        out[:, :, :-1] = states.transpose(0, 2, 1)
        out = out.reshape(-1, self.hidden + 1)
        return out if len(live) == len(out) else out.take(live, 0)

    def score(self, documents: list[np.ndarray], lanes: int = LANES, window: int = 32) -> np.ndarray:
        """Sums of natural logs over whole documents of symbols."""
        lanes = max(1, min(lanes, len(documents)))
        stream, owner, begins, lengths = laid(documents, lanes)
        out, n, weights = np.zeros(len(documents)), self.hidden, self._with_bias()
        h, before = np.zeros((n, lanes), np.float32), np.full(lanes, END)
        for at in range(0, lengths[0] if len(lengths) else 0, window):
            place = np.arange(at, min(at + window, lengths[0]))
            live = int((lengths > at).sum())  # lanes are in order of length, longest first
            index = begins[:live] + place[:, None]
            target = np.where(place[:, None] < lengths[:live], stream.take(index, mode="clip"), -1)
            after = np.where(target < 0, END, target)
            reads = np.concatenate([before[None, :live], after[:-1]])
            goes_on, a = (reads != END).astype(np.float32)[:, None], self._read(reads)
            h, before = h[:, :live], after[-1]
            states = np.empty((len(place), n, live), np.float32)
            new, zr, g = (np.empty((k * n, live), np.float32) for k in (1, 2, 3))
            for k in range(len(place)):
                self._step(h * goes_on[k], a[k], states[k], new, zr, g)
                h = states[k]
            here = np.flatnonzero(target >= 0)
            logs = self._log_probs(self._rows(states, here), target.ravel()[here], *weights)
            out += np.bincount(owner[index.ravel()[here]], logs, len(documents))
        return out


def laid(documents: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents in lanes of about equal length, one lane behind the other, longest first: symbols, whose they are, and the
    lanes' beginnings and lengths. Takes memory by symbols alone, however long one document is."""
    own: list[list[int]] = [[] for _ in range(lanes)]
    filled = [(0, k) for k in range(lanes)]
    import heapq

    for i in sorted(range(len(documents)), key=lambda i: -len(documents[i])):
        n, k = heapq.heappop(filled)
        own[k].append(i)
        heapq.heappush(filled, (n + len(documents[i]), k))
    filled.sort(reverse=True)
    order = [i for _, k in filled for i in own[k]]
    lengths = np.array([n for n, _ in filled], np.int64)
    if not order:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), lengths, lengths
    owner = np.repeat(np.array(order, np.int32), [len(documents[i]) for i in order])
    return np.concatenate([documents[i] for i in order]), owner, np.cumsum(lengths) - lengths, lengths


def tokens(text: str | None) -> list[bytes]:
    return utf8(text).lower().split()


def split(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """What tokens gives for each of the texts, one behind the other, and how many words each has."""
    own = pc.ascii_trim_whitespace(pc.ascii_lower(pa.array(texts, pa.string()).fill_null("")))
    lists = pc.ascii_split_whitespace(own)
    words, n, empty = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False), pc.equal(own, "").to_numpy(zero_copy_only=False)
    if empty.any():  # these have the empty string as their only word
        words, n = words.filter(pc.not_equal(words, "")), np.where(empty, 0, n)
    return words.cast(pa.binary()), n.astype(np.int64)


def rows_of(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Where each word stands among the known ones, -1: nowhere."""
    return pc.index_in(words, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)


def ended(symbols: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Documents of n symbols each, END last."""
    out, ends = np.empty(len(symbols) + len(n), np.int32), np.cumsum(n + 1)
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside], out[ends - 1] = symbols, END
    return cut_at(out, (n + 1).tolist())


def word_counts(docs: DataFrame, most: int = 2 * SPLIT) -> DataFrame:
    """word (binary), n. Tasks add up what a portion of their texts has before they send it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions((t for batch in batches for t in batch.column(0).to_pylist()), lambda t: len(t or "") + 100, most):
            found = split(part)[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Statistics:
    """What tasks get: the frequent words' counts, the totals, and the network with its symbols."""

    head: dict[bytes, int]  # word to its row
    counts: np.ndarray
    symbols: np.ndarray  # by row
    ends: int  # training documents, each with one end
    n: int  # N and V of all training tokens
    v: int
    other_n: int  # and those of words outside of the network's vocabulary
    other_v: int
    network: Network


def fit(training: DataFrame, counts: DataFrame, head: int = HEAD, vocabulary: int = CLASSES * CLASS_WORDS, shard: int = SHARD) -> Statistics:
    """training (doc_id, text); counts: a stored table of its words."""
    n_docs = training.count()
    by_count = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()  # as many rows as counts differ
    least, some = 1 << 62, 0
    for r in by_count:
        some += r["words"]
        if some > head:
            break
        least = r["n"]
    frequent = [(bytes(r["word"]), r["n"]) for r in counts.where(F.col("n") >= least).collect()]  # at most head rows
    frequent.sort(key=lambda x: (-x[1], x[0]))
    words_n, words_v = sum(r["n"] * r["words"] for r in by_count), sum(r["words"] for r in by_count)
    n_words = min(vocabulary, len(frequent))
    known = sum(n for _, n in frequent[:n_words])
    symbols = np.zeros(len(frequent), np.int64)
    symbols[:n_words] = 2 + np.arange(n_words)
    network = Network(n_words)
    network.start(np.array([words_n - known, n_docs, *(n for _, n in frequent[:n_words])], float))
    stats = Statistics({w: k for k, (w, _) in enumerate(frequent)}, np.array([n for _, n in frequent], np.int64), symbols, n_docs, words_n + n_docs, words_v + (n_docs > 0), words_n - known, words_v - n_words, network)
    if n_docs:
        train(training, stats, shard, rounds=1, slices=1)
    return stats


def train(training: DataFrame, stats: Statistics, shard: int = SHARD, rounds: int = ROUNDS, slices: int | None = None) -> int:
    """Trains the network of stats on all rows of training (doc_id, text); gives the number of readings of a row. A round
    reads one of the slices, in turn. If their number isn't given, what fits a shard is read in each round, more once."""
    network, sc = stats.network, training.sparkSession.sparkContext
    slices = slices or (rounds if stats.n > rounds * shard else 1)
    shards = -(-stats.n // (slices * shard))  # of a round
    dealt = training.select((F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(slices * shards))).alias("shard"), F.xxhash64("doc_id", "text", F.lit(12)).alias("place"), "doc_id", "text")
    network_of, flat = sc.broadcast(stats), network.flat(network.fresh())
    n_pieces, trained = -(-len(flat) // PIECE), 0
    for k in range(rounds):
        start = sc.broadcast(flat)
        mine = dealt.where(F.col("shard") % slices == k % slices).repartition(2 * shards, "shard").sortWithinPartitions("shard", "place", "doc_id", "text")
        made = mine.select("shard", "text").mapInArrow(lambda batches, start=start: _learn(batches, network_of.value, start.value), "piece int, weight double, documents bigint, part binary")
        rows = stored(made.repartition("piece").mapInArrow(_averaged, "piece int, documents bigint, part binary"), "network").collect()  # as many as the network has pieces
        if rows:
            if sorted(r["piece"] for r in rows) != [*range(n_pieces)]:
                raise RuntimeError("pieces of the network are missing")
            flat = np.concatenate([np.frombuffer(r["part"], np.float32) for r in sorted(rows, key=lambda r: r["piece"])])
            trained += rows[0]["documents"]
        start.unpersist()
    network.load(flat)
    network_of.unpersist()
    return trained


def _learn(batches: Iterator[pa.RecordBatch], stats: Statistics, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The network's pieces after each shard, weighed by its tokens; batches (shard, text) in order of shards."""
    one_blas_thread()
    of = np.append(stats.symbols[stats.symbols != OTHER], OTHER)
    vocabulary = pa.array([w for w, k in stats.head.items() if stats.symbols[k] != OTHER], pa.binary())  # small enough for the processor's cache
    rows = ((k, t) for batch in batches for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    for _, own in itertools.groupby(rows, lambda r: r[0]):
        network = Network(stats.network.n_words, stats.network.hidden, dict(stats.network.p))
        memory, seen, n_documents = network.load(start), 0, 0
        for part in portions(own, lambda r: len(r[1] or "") + 100, PORTION):
            words, lengths = split([t for _, t in part])
            documents = ended(of[rows_of(words, vocabulary)], lengths)
            n = sum(map(len, documents))
            network.train(documents, lanes=max(32, min(LANES, n // 4096)), epochs=1, memory=memory)
            seen, n_documents = seen + n, n_documents + len(documents)
        flat = network.flat(memory)
        parts = [flat[at : at + PIECE].tobytes() for at in range(0, len(flat), PIECE)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(parts)), pa.int32()), pa.array([float(seen)] * len(parts)), pa.array([n_documents] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["piece", "weight", "documents", "part"])


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for batch in batches:
        for piece, weight, n, part in zip(*(c.to_pylist() for c in batch.columns)):
            own = found.setdefault(piece, [0.0, 0, 0.0])
            own[0], own[1], own[2] = own[0] + weight, own[1] + n, own[2] + weight * np.frombuffer(part, np.float32).astype(np.float64)
    if found:
        parts = [(v / w).astype(np.float32).tobytes() for w, _, v in found.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.keys(), pa.int32()), pa.array([n for _, n, _ in found.values()], pa.int64()), pa.array(parts, pa.binary())], names=["piece", "documents", "part"])


def symbols_of(words: list[bytes], stats: Statistics) -> tuple[np.ndarray, np.ndarray]:
    """A document's symbols, END last, and its words' rows of the head (-1: not there); the plain way, word by word."""
    rows = np.fromiter(map(stats.head.get, words, itertools.repeat(-1)), np.int64, len(words))
    out = np.full(len(words) + 1, OTHER, np.int32)
    out[-1] = END
    known = rows >= 0
    out[:-1][known] = stats.symbols[rows[known]]
    return out, rows


def score(docs: DataFrame, stats: Statistics, counts: DataFrame, most: int = SPLIT, at_once: int = SCORED) -> DataFrame:
    """doc_id, fold, n_tokens, n_known, train_tokens, base_score, score. Texts are split by portions of most characters, and
    the network reads at_once tokens side by side: each time takes as many steps as the longest document has."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(stats)  # at most HEAD words and a network of fixed size
    names = ["word", "row", "doc_id", "fold", "n_tokens", "n_known", "base", "model", "tf"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        one_blas_thread()
        own, row = sent.value, TaskContext.get().partitionId() << 40
        head, symbol_of = pa.array(list(own.head), pa.binary()), np.append(own.symbols, OTHER)  # the last place is that of words outside
        base_of = np.append(np.log10((own.counts + 1.0) / (own.n + own.v + 1.0)), 0.0)
        other_of = np.append(np.where(own.symbols == OTHER, np.log10((own.counts + 1.0) / (own.other_n + own.other_v + 1.0)), 0.0), 0.0)
        end_known, end_base = int(own.ends > 0), np.log10((own.ends + 1.0) / (own.n + own.v + 1.0))
        documents, columns = [], [[] for _ in range(8)]  # of rows that wait for their scores; the last column: sums of other words

        def scored() -> pa.RecordBatch:
            model = own.network.score(documents) / np.log(10) + columns.pop()
            out = pa.RecordBatch.from_arrays([*map(pa.array, columns, types), pa.array(model), pa.array(np.zeros(len(model), np.int64))], names=names)
            documents.clear()
            columns[:] = [[] for _ in range(8)]
            return out

        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for part in portions(rows, lambda r: len(r[2] or "") + 100, most):
            ids, folds, texts = zip(*part)
            words, n = split(texts)
            at, document, k = rows_of(words, head), np.repeat(np.arange(len(part)), n), len(part)
            sums = [np.bincount(document, of[at], k) for of in (base_of, other_of)]
            first, row = row + 1, row + k
            here, known = range(first, row + 1), np.bincount(document[at >= 0], minlength=k)
            for column, values in zip(columns, ([b" %d" % r for r in here], here, ids, folds, n + 1, known + end_known, sums[0] + end_base, sums[1])):
                column.extend(values)
            documents.extend(ended(symbol_of[at], n))
            outside = np.flatnonzero(at < 0)
            if len(outside):
                found = words.take(pa.array(outside)).dictionary_encode()
                different = len(found.dictionary)
                pairs, times = np.unique(document[outside] * different + found.indices.to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [found.dictionary.take(pa.array(pairs % different)), pa.array(first + pairs // different), *(pa.nulls(len(times), t) for t in types[2:8]), pa.array(times, types[8])], names=names)
            if sum(map(len, documents)) >= at_once:
                yield scored()
        if documents:
            yield scored()

    parts = docs.select("doc_id", "fold", "text").mapInArrow(run, "word binary, row bigint, doc_id bigint, fold bigint, n_tokens bigint, n_known bigint, base double, model double, tf bigint")
    # Row numbers come from a task's place, so the rows are written once: a task that is run again can't number anew.
    parts = stored(parts, "scored")
    c, tf = F.coalesce(F.col("n"), F.lit(0)), F.col("tf")
    tail = lambda total: F.when(tf > 0, tf * F.log10((c + 1.0) / F.lit(float(total)))).otherwise(0.0)
    found = parts.join(counts, "word", "left").select(
        "row", "doc_id", "fold", "n_tokens", (F.coalesce("n_known", F.lit(0)) + F.when(c > 0, tf).otherwise(0)).alias("n_known"),
        (F.coalesce("base", F.lit(0.0)) + tail(stats.n + stats.v + 1)).alias("base"),
        (F.coalesce("model", F.lit(0.0)) + tail(stats.other_n + stats.other_v + 1)).alias("model"))
    return found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("fold").alias("fold"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(stats.n).cast("bigint").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("model").alias("score")).drop("row")


def log_likelihoods(docs: DataFrame, folds: int = 7, held_out: int = 2) -> DataFrame:
    """Counts and network from the documents outside of the fold; all documents scored."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", remainder("doc_id", folds).alias("fold"))
    training = rows.where(F.col("fold") != held_out)
    counts = stored(word_counts(training), "word-counts")
    stats = fit(training, counts)
    return score(rows, stats, counts).select("doc_id", (F.col("fold") == held_out).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_likelihoods(table(spark, sf_dir, "documents"))

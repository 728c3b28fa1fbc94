"""Vector best-fit packing of tokenised documents into sequences.

A sequence has three capacities: tokens, documents (pieces) and attention cost (the sum of squared piece lengths).
Pieces, longest first, go to the open sequence that has room in every dimension and the best score: the weighted dot
product of the piece with the residual capacities, least first (tightest fit), or the norm of the residuals left.

Tokenising is one pass without a shuffle. Only the pieces' descriptions (about 40 bytes each) are then dealt by a hash
of their document into partitions, each packed in blocks of bounded size, so a task's memory and time do not depend on
the corpus; a block leaves about one sequence part-filled.

A null or empty text is one piece that holds only the end id. A null doc_id is kept. Repeated rows are packed one by
one. Text is never cut off: a document longer than a sequence is cut into consecutive pieces.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.common import Cache, cut_at, portions, table
from lattice.llm.pretokens import splitter

SEQUENCE = 2048
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"
BLOCK = 16_384


#: How the vocabulary splits lower-cased text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_characters() -> list[str]:
    """The character of each byte: itself if it is a visible one of Latin-1, else the next from 0x100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(others)) for b in range(256)]


class Encoder:
    """Ids of whole texts, each pre-token encoded once.

    Below U+0250 (but for the dotted capital I) the vocabulary's normalisation is plain lower-casing, so such texts are
    split here and new pre-tokens go to its merges at once; other texts, and texts with special tokens, go through the
    whole tokenizer. It is used in the same way for any text if the file differs from what is expected.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.own = Tokenizer.from_file(path)
        model = json.loads(self.own.to_str())
        parts = json.dumps([model["normalizer"], model["pre_tokenizer"], model["model"].get("end_of_word_suffix"), model["post_processor"]])
        self.plain = all(x in parts for x in ('"NFC"', '"Lowercase"', json.dumps(PATTERN), '"</w>"')) and model["post_processor"] is None and all(t["content"].startswith("<|") for t in model["added_tokens"])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in model["added_tokens"]) or "(?!)")  # all of them begin with <|
        self.split, self.odd = splitter(PATTERN), re.compile("[\u0130\u0250-\U0010ffff]")
        self.merges = Tokenizer(self.own.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        ids = self.own.get_vocab()
        self.ends = np.zeros(max(ids.values()) + 1, bool)
        self.ends[[i for t, i in ids.items() if t.endswith("</w>")]] = True
        self.characters = dict(enumerate(byte_characters()))
        self.cache = Cache(self._encode)

    def _encode(self, words: list[str]) -> list[bytes]:
        # No byte of a pre-token is a space, so a space keeps them apart; the last id of each is one that ends a word.
        lines = [" ".join(words[k : k + 100]).encode().replace(b" ", b"\n").decode("latin-1").translate(self.characters | {10: " "}) for k in range(0, len(words), 100)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.merges.encode_batch_fast(lines, add_special_tokens=False)), "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        return cut_at(ids.tobytes(), (4 * np.diff(stops, prepend=0)).tolist())

    def _is_plain(self, text: str) -> bool:
        return self.plain and (text.isascii() or not self.odd.search(text)) and not ("<|" in text and self.special.search(text))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        plain = [self._is_plain(t) for t in texts]
        tokens = [self.split(t.lower()) if p else [] for t, p in zip(texts, plain)]
        self.cache.learn(tokens)
        get = self.cache.of.__getitem__
        return [b"".join(map(get, x)) if p else np.array(self.own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for x, t, p in zip(tokens, texts, plain)]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(docs: DataFrame, path: str, most: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """doc_id, text to the pieces of each document, with the end id last."""
    end, names = np.array([end_id], "<u4").tobytes(), [c.split()[0] for c in PIECES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), (t or "" for t in batch.column(1).to_pylist()))
            for part in portions(rows, lambda r: len(r[1]) + 100, 2_000_000):
                out = []
                for (doc, _), ids in zip(part, own.encode([t for _, t in part]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * most)):
                        piece = ids[at : at + 4 * most]
                        out.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, tokens: int, max_docs: int, max_cost: float, score: str = "dot", weights=(1.0, 0.05, 0.05)) -> tuple[np.ndarray, np.ndarray]:
    """The sequence (from 0) and the offset of each piece. A piece over a capacity on its own stands alone."""
    n = len(lengths)
    size = np.array([tokens, max_docs, max_cost], float)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.empty((3, n))  # residual shares of the open sequences
    number, used, is_open, made = np.empty(n, np.int64), np.zeros(n + 1, np.int64), 0, 0
    w = np.array(weights)
    order = np.argsort(-lengths, kind="stable")
    least = lengths[order[-1]] if n else 0
    for i in order:
        length = float(lengths[i])
        need = np.array([length, 1.0, length * length]) / size
        best = -1
        if is_open:
            now = left[:, :is_open]
            room = (now[0] >= need[0] - 1e-12) & (now[1] >= need[1] - 1e-12) & (now[2] >= need[2] - 1e-12)
            if room.any():
                value = (w * need) @ now if score == "dot" else w @ np.square(now - need[:, None])
                value[~room] = np.inf
                best = int(value.argmin())
        if best < 0:
            best, left[:, is_open], number[is_open] = is_open, 1.0, made
            is_open, made = is_open + 1, made + 1
        k = number[best]
        where[i], offset[i] = k, used[k]
        used[k] += int(length)
        left[:, best] -= need
        if left[0, best] * tokens < least - 1e-6 or left[1, best] * max_docs < 1 - 1e-6 or left[2, best] * max_cost < least * least - 1e-6:
            is_open -= 1  # nothing more fits: the last open one takes its place
            left[:, best], number[best] = left[:, is_open], number[is_open]
    return where, offset


def pack(docs: DataFrame, path: str, tokens: int = SEQUENCE, max_docs: int = SEQUENCE, max_cost: float = float(SEQUENCE) ** 2, score: str = "dot", end_id: int = 0, block: int = BLOCK) -> DataFrame:
    """One row per piece: where it lies in its document, its checksum, its sequence and its place there."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, kept = TaskContext.get().partitionId() << 40, []

        def packed(pdf: pd.DataFrame, base: int) -> tuple[pd.DataFrame, int]:
            where, offset = best_fit(pdf["length"].to_numpy(), tokens, max_docs, max_cost, score)
            return pdf.assign(sequence_id=where + base, offset=offset), base + int(where.max()) + 1

        for pdf in parts:
            kept.append(pdf)
            if sum(map(len, kept)) >= block:
                whole = pd.concat(kept, ignore_index=True)
                for at in range(0, len(whole) // block * block, block):
                    out, made = packed(whole.iloc[at : at + block].reset_index(drop=True), made)
                    yield out
                kept = [whole.iloc[len(whole) // block * block :]]
        if sum(map(len, kept)):
            yield packed(pd.concat(kept, ignore_index=True), made)[0]

    pieces = cut(docs, path, tokens, end_id)
    dealt = pieces.repartition(F.xxhash64("doc_id")).sortWithinPartitions("doc_id", "piece", "length", "ids_crc32")
    return dealt.mapInPandas(run, PACKED)


def query(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"))

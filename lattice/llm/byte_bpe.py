"""Byte-level BPE through a sentencepiece model that is written from a rank file.

Each byte b stands as the character 0x100 + b. A piece is its mapped bytes with the score minus its rank, so
sentencepiece's best-first merging takes the lowest rank first and the leftmost of equals, as the rank file means it.
The model has identity normalisation, no dummy prefix and no white-space escape. Texts are split by the pattern first;
a pre-token that is itself a piece is that piece. Ids are ranks; decoding maps them back to bytes.

Null and empty texts have no ids. Texts are encoded whole; repeated rows are encoded one by one.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lattice.llm.common import Cache, cut_at, portions, table, utf8
from lattice.llm.pretokens import splitter

def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def mapped(data: bytes) -> str:
    return (np.frombuffer(data, np.uint8).astype("<u4") + 0x100).tobytes().decode("utf-32-le")


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised model: an unknown piece with id 0, then the piece of rank r with id r + 1."""
    unknown, bpe = 2, 2
    out = [_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _flag(3, unknown))]
    for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out.append(_field(1, _field(1, mapped(piece).encode()) + b"\x15" + struct.pack("<f", float(-rank))))
    out.append(_field(2, _flag(3, bpe) + _flag(4, len(ranks) + 1)))
    out.append(_field(3, _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)))
    return b"".join(out)


class Codec:
    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(path)
        if sorted(self.ranks.values()) != list(range(len(self.ranks))):
            raise ValueError("ranks have to be 0, 1, 2, ...")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.split = splitter(pattern)
        self.pieces = np.empty(len(self.ranks), object)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.cache = Cache(self._encode)

    def _encode(self, strings: list[str]) -> list[bytes]:
        data = [utf8(s) for s in strings]
        out: list[bytes | None] = [None if (r := self.ranks.get(b)) is None else struct.pack("<I", r) for b in data]
        rest = [i for i, x in enumerate(out) if x is None]
        own = [data[i] for i in rest]
        found = self.model.encode(cut_at(mapped(b"".join(own)), map(len, own)), num_threads=1)
        ids = (np.fromiter(chain.from_iterable(found), "<i8") - 1).astype("<u4").tobytes()
        for i, x in zip(rest, cut_at(ids, (4 * len(f) for f in found)), strict=True):
            out[i] = x
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        tokens = [self.split(t) for t in texts]
        self.cache.learn(tokens)
        get = self.cache.of.__getitem__
        return [b"".join(map(get, x)) for x in tokens]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.pieces[np.frombuffer(ids, "<u4")].tolist())


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    return Codec(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes; with_ids adds the ids themselves (binary)."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.binary())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), (t or "" for t in batch.column(1).to_pylist()))
            for part in portions(rows, lambda r: len(r[1]) + 100, 4_000_000):
                out = []
                for (doc, _), ids in zip(part, own.encode([t for _, t in part]), strict=True):
                    row = (doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest())
                    out.append((*row, ids) if with_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(zip(*out), fields)], names=[f[0] for f in fields])

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

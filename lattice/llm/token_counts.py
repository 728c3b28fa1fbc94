"""Edit-aware token counts.

A document's pre-tokens are the leaves of a segment tree whose nodes sum token counts and character counts. Trees are
kept: plant() tokenises texts once and gives a table of trees (text, and each leaf's characters and tokens), which is
stored; apply() takes edits to it and gives the next table, so that later edits start from there. Only documents with
edits are touched; of those only the regions that the edits touch are encoded again. An edit (start, end, replacement,
in characters) descends the tree to the first pre-token it touches, steps two pre-tokens back (a match of the pattern
reads no further than two characters past its end's white space), splits from there until a boundary behind the edit
meets an old boundary, encodes only those pre-tokens and updates the sums above them.

Null and empty texts have no tokens. Edits refer to the text of the tree that they are applied to and may not overlap;
of overlapping ones the first stays. Edits beyond the end are clipped; those with a null start or end are passed over,
and a null replacement is the empty one. Texts are counted whole. Of repeated rows each has its own tree and gets all
edits of its doc_id; edits with a null doc_id go to the rows without one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.byte_bpe import read_ranks
from lattice.llm.common import Cache, cut_at, portions, stored, table
from lattice.llm.pretokens import splitter

Edit = tuple[int, int, str]
#: A kept tree: lengths and counts are those of its leaves, as little-endian unsigned 32-bit integers.
TREES = "doc_id bigint, text string, lengths binary, counts binary, n_tokens bigint"
EDITED = f"{TREES}, n_before bigint, n_edits bigint, n_encoded bigint"
#: What the query masks: secrets, e-mail addresses, IPv4 addresses and long runs of digits.
MASKS = [
    ("=", regex.compile(r'\b(?:token|secret|password|api_key)\s*=\s*"[^"\n]+"'), "<SECRET>"),
    ("@", regex.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), "<EMAIL>"),
    (".", regex.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}\b"), "<IP>"),
    ("", regex.compile(r"\+?\d[\d -]{7,}\d"), "<NUMBER>"),
]


def masks(text: str) -> list[Edit]:
    return [(m.start(), m.end(), new) for mark, pattern, new in MASKS if mark in text for m in pattern.finditer(text)]


class Tree:
    """Sums over pre-token slots. A slot holds the pre-tokens that stand where one stood; edits change slots in place."""

    def __init__(self, tokens: list[str], split: Callable[[str], list[str]], count: Callable[[list[str]], list[int]], counts: Sequence[int] | None = None):
        """counts: what is known of the tokens' counts, so that nothing is encoded."""
        self.split, self.count = split, count
        self.slots: list = [*tokens]
        n = len(self.slots)
        self.size = 1 << max(0, n - 1).bit_length()
        self.sums = np.zeros((2, 2 * self.size), np.int64)
        self.sums[0, self.size : self.size + n] = count(self.slots) if counts is None else counts
        self.sums[1, self.size : self.size + n] = list(map(len, self.slots))
        half = self.size
        while half > 1:
            row = self.sums[:, half : 2 * half]
            half //= 2
            self.sums[:, half : 2 * half] = row[:, ::2] + row[:, 1::2]
        self.encoded = 0  # pre-tokens encoded for edits

    @property
    def n_tokens(self) -> int:
        return int(self.sums[0, 1])

    def find(self, at: int) -> tuple[int, int]:
        """The slot that holds character at, and where that slot begins."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if at - begin >= self.sums[1, node]:
                begin += int(self.sums[1, node])
                node += 1
        return node - self.size, begin

    def put(self, slot: int, tokens: list[str]) -> None:
        node = slot + self.size
        d = np.array([sum(self.count(tokens)), sum(map(len, tokens))]) - self.sums[:, node]
        self.slots[slot] = tokens
        while node:
            self.sums[:, node] += d
            node //= 2

    def at(self, slot: int) -> list[str]:
        return x if isinstance(x := self.slots[slot], list) else [x]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from start to end of the text as it is now."""
        length = int(self.sums[1, 1])
        start, end = min(start, length), min(max(start, end), length)
        if not self.slots:
            self.slots, self.size, self.sums = [[]], 1, np.zeros((2, 2), np.int64)
        first, begin = self.find(max(0, min(start, length - 1)))
        first = min(first, len(self.slots) - 1)
        back = 0
        while first and back < 2:
            first -= 1
            inside = self.at(first)
            back += len(inside)
            begin -= sum(map(len, inside))
        shift = len(new) - (end - start)
        after = 4  # pre-tokens behind the edit that are split again; twice as many until the boundaries meet
        while True:
            old, stop, last, behind = [], begin, first, 0
            slot_after = {}  # where a slot ends, behind the edit, in new offsets: the slot after it
            while last < len(self.slots) and behind < after:
                inside = self.at(last)
                old += inside
                stop += sum(map(len, inside))
                last += 1
                if stop >= end:
                    slot_after[stop + shift] = last
                    behind += len(inside)
            joined = "".join(old)
            got = self.split(joined[: start - begin] + new + joined[end - begin :])
            if last == len(self.slots):
                break
            at, met = begin, 0
            for k, t in enumerate(got[:-2], 1):
                at += len(t)
                if at in slot_after:
                    met, last = k, slot_after[at]
                    break
            if met:
                got = got[:met]
                break
            after *= 2
        self.encoded += len(got)
        self.put(first, got)
        for k in range(first + 1, last):
            if self.slots[k] != []:
                self.put(k, [])

    def edit_all(self, edits: list[Edit]) -> int:
        """Applies edits that refer to the original text; returns how many."""
        taken, reach = [], 0
        for start, end, new in sorted(edits):
            if start >= reach and end >= start:
                taken.append((start, end, new))
                reach = max(reach, end, start + (start == end))
        for start, end, new in reversed(taken):  # from the back, so that offsets in front still hold
            self.edit(start, end, new)
        return len(taken)

    def current(self) -> list[str]:
        return [t for k in range(len(self.slots)) for t in self.at(k)]

    def leaves(self) -> tuple[bytes, bytes]:
        """Characters and tokens of the pre-tokens as they are now, as kept in a table."""
        return _packed(map(len, own := self.current())), _packed(self.count(own))


class Counter:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        self.split = splitter(pattern)
        self.cache = Cache(lambda strings: [len(own.encode_ordinary(s)) for s in strings])

    def count(self, tokens: list[str]) -> list[int]:
        try:
            return [*map(self.cache.of.__getitem__, tokens)]
        except KeyError:
            self.cache.learn([tokens])
            return [*map(self.cache.of.__getitem__, tokens)]


@functools.cache
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def _packed(numbers: Iterable[int]) -> bytes:
    return np.fromiter(numbers, "<u4").tobytes()


def plant(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The trees of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for batch in batches:
            at = 0
            for part in portions((t or "" for t in batch.column(1).to_pylist()), lambda t: len(t) + 100, 4_000_000):
                tokens = [own.split(t) for t in part]
                own.cache.learn(tokens)
                counts = [np.array(own.count(x), "<u4") for x in tokens]
                columns = [pa.array(part, pa.string()), pa.array([_packed(map(len, x)) for x in tokens], pa.binary()), pa.array([c.tobytes() for c in counts], pa.binary()), pa.array([int(c.sum()) for c in counts], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *columns], names=[c.split()[0] for c in TREES.split(", ")])
                at += len(part)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, TREES)


def _edited(trees: DataFrame, path: str, pattern: str, edits_of: Callable[[str, list], list[Edit]], given: bool) -> DataFrame:
    types = [pa.int64(), pa.string(), pa.binary(), pa.binary()] + [pa.int64()] * 4
    names = [c.split()[0] for c in EDITED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for batch in batches:
            edits = batch.column(5).to_pylist() if given else [None] * len(batch)
            out = []
            for k, (text, before, found) in enumerate(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), edits)):
                asked = edits_of(text, found)
                doc, lengths, counts = (batch.column(c)[k].as_py() for c in (0, 2, 3))
                if not asked:
                    out.append((doc, text, lengths, counts, before, before, 0, 0))
                    continue
                tree = Tree(cut_at(text, np.frombuffer(lengths, "<u4").tolist()), own.split, own.count, np.frombuffer(counts, "<u4"))
                n = tree.edit_all(asked)
                out.append((doc, "".join(tree.current()), *tree.leaves(), tree.n_tokens, before, n, tree.encoded))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return trees.mapInArrow(run, EDITED)


def apply(trees: DataFrame, edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """The trees after edits (doc_id, start, end, replacement): their columns, and n_before, n_edits and n_encoded.
    Trees without edits don't leave the JVM."""
    each = edits.where("start is not null and end is not null").select(F.col("doc_id").cast("bigint").alias("of"), F.struct("start", "end", F.coalesce("replacement", F.lit("")).alias("replacement")).alias("e"))
    by_doc = each.groupBy("of").agg(F.collect_list("e").alias("edits"))
    met = trees.select([c.split()[0] for c in TREES.split(", ")]).join(by_doc, F.col("doc_id").eqNullSafe(F.col("of")), "left").drop("of")
    met = stored(met, "trees-and-edits", "zstd")
    touched = _edited(met.where("edits is not null"), path, pattern, lambda _, found: [(e["start"], e["end"], e["replacement"]) for e in found], True)
    rest = met.where("edits is null").drop("edits").select("*", F.col("n_tokens").alias("n_before"), F.lit(0).cast("bigint").alias("n_edits"), F.lit(0).cast("bigint").alias("n_encoded"))
    return rest.unionByName(touched)


def recount(docs: DataFrame, path: str, pattern: str, edits_of: Callable[[str], list[Edit]] = masks) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_encoded (pre-tokens) and n_tokens_after, of edits that edits_of finds in a text."""
    trees = stored(plant(docs, path, pattern), "trees", "zstd")
    after = _edited(trees, path, pattern, lambda text, _: edits_of(text), False)
    return after.select("doc_id", F.col("n_before").alias("n_tokens"), "n_edits", "n_encoded", F.col("n_tokens").alias("n_tokens_after"))


def query(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return recount(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

"""Groups of documents by SimHash fingerprints, and by a Jaccard similarity of LEAST or more of their word shingles.

Fingerprints within op9's distance link their texts, by op9's own pivot table. That misses copies with many edits, whose
fingerprints lie further apart, so an exact check follows and adds the links of sets that are alike.

A document is its set of shingle hashes; equal sets are one node from the start. Candidates share one of BANDS keys of
BAND_ROWS minimum hashes each, which a pair at similarity 0.8 misses with probability 6e-5. No candidate links
unverified: the sets of both are compared as a whole. First, each node is compared with one other: the one that comes
first in most of its keys. So a group of copies is mostly one group at the price of a pair a node. Then the keys whose
nodes are not all in one group get their sets, and each such key is settled in one task by the postings of its shingles;
only a spanning forest of the links between groups leaves the task. A key with many shingles is dealt in blocks, each
pair of which is a task.

A null or empty text has no shingle; all such are one group. A text of fewer words than a shingle is one shingle. Rows
are told apart by their doc_id and a hash of doc_id and text, so repeated and null ids get a group row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm.common import drop, row_key, stored, utf8, whole_groups
from lattice.llm.simhash import BITS_APART, HOT, components, fingerprint, pivot_table
from lattice.llm.simhash import links as close_prints

WORDS, LEAST, BANDS, BAND_ROWS, SEED = 5, 0.8, 32, 6, 42
SETS = "doc_id bigint, same bigint, n bigint, keys array<bigint>, shingles binary, row bigint"
#: Shingles of a block.
BLOCK = 1_500_000
_XOR, _TIMES = np.random.default_rng(17).integers(0, 1 << 64, (2, BANDS * BAND_ROWS, 1), np.uint64)
_TIMES |= np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the set, in order."""
    parts = utf8(text).lower().split()
    own = {b" ".join(parts)} if parts and len(parts) <= words else {*map(b" ".join, zip(*(parts[k:] for k in range(words))))}
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in own), np.uint64, len(own)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[None, at : at + 4096] ^ _XOR) * _TIMES).min(1))
    keys = np.zeros(BANDS, np.uint64)
    for part in least.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ part) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            sets = [shingles(t) for t in part.column(1).to_pylist()]
            same = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).astype(np.int64)
            keys = pa.array([band_keys(s).astype(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(same), pa.array([*map(len, sets)], pa.int64()), keys, pa.array([s.tobytes() for s in sets], pa.binary()), part.column(2)], names=["doc_id", "same", "n", "keys", "shingles", "row"])


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _sets, with op9's fingerprint instead of the shingles."""
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).astype(np.int64)
        at = 0
        for part in _sets(iter([batch])):
            yield part.drop_columns(["shingles"]).append_column("fp", pa.array(prints[at : at + len(part)]))
            at += len(part)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, same, n, first of the keys that several nodes have; batches (key, same, n) in order. first is a key's first
    node."""
    for part, bounds in whole_groups(batches, 1):
        same, lengths = part.column(1).to_numpy(), np.diff(bounds)
        several = np.repeat(lengths > 1, lengths)
        if several.any():
            first = pa.array(np.repeat(same[bounds[:-1]], lengths))
            yield pa.RecordBatch.from_arrays([*(part.column(k).combine_chunks() for k in range(3)), first], names=["key", "same", "n", "first"]).filter(pa.array(several))


def _forest(sets: list[np.ndarray], roots: list[int], sides: np.ndarray | None, least: float) -> list[tuple[int, int]]:
    """Pairs of sets of different roots that are alike, as few as join all that are; only pairs across the two sides."""
    up: dict[int, int] = {r: r for r in roots}

    def top(r: int) -> int:
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    sizes = np.array([*map(len, sets)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    held, bounds = owner[order], np.searchsorted(codes[order], np.arange(codes.max() + 2))
    ends, out = np.cumsum(sizes), []
    roots_of = np.unique(np.array(roots), return_inverse=True)[1]
    for i in range(len(sets)):
        mine = codes[ends[i] - sizes[i] : ends[i]]
        fit = (roots_of != roots_of[i]) & (np.minimum(sizes, sizes[i]) >= least * np.maximum(sizes, sizes[i]))
        fit[: i + 1] = False
        if sides is not None:
            fit &= sides != sides[i]
        if not fit.any():
            continue
        both = np.bincount(np.concatenate([held[bounds[c] : bounds[c + 1]] for c in mine.tolist()]), minlength=len(sets))
        for j in np.flatnonzero(fit & (both >= least * (sizes + sizes[i] - both))).tolist():
            x, y = top(roots[i]), top(roots[j])
            if x != y:
                up[x] = y
                out.append((i, j))
    return out


def _settled(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """a, b: links between the groups of each block pair of a key; batches (key, one, two, mine, same, root, shingles)."""
    for part, bounds in whole_groups(batches, 3):
        a, b = [], []
        one, two, mine, same, root = (part.column(k).to_numpy() for k in (1, 2, 3, 4, 5))
        held = part.column(6).combine_chunks()
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo > 1:
                sets = [np.frombuffer(held[k].as_buffer(), np.uint64) for k in range(lo, hi)]
                for i, j in _forest(sets, root[lo:hi].tolist(), mine[lo:hi] if one[lo] != two[lo] else None, least):
                    a.append(same[lo + i])
                    b.append(same[lo + j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2), batch.column(3)):  # views, so that a batch isn't copied
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(both >= least * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def shared_keys(sets: DataFrame) -> DataFrame:
    """key, same, n, first: the keys that several nodes have. A band is part of its keys."""
    nodes = sets.where("n > 0").dropDuplicates(["same"]).select("same", "n", F.posexplode("keys").alias("band", "k"))
    keyed = nodes.select(F.xxhash64("band", "k").alias("key"), "same", "n")
    return stored(keyed.repartition("key").sortWithinPartitions("key", "same").mapInArrow(_shared, "key bigint, same bigint, n bigint, first bigint"), "shared-keys")


def shared_sets(sets: DataFrame, shared: DataFrame) -> DataFrame:
    """same, shingles of the nodes that share a key."""
    wanted = shared.select("same").distinct().hint("merge")  # as many as there are texts like others
    return stored(sets.select("same", "shingles").join(wanted, "same", "left_semi").dropDuplicates(["same"]), "shared-sets")


def links_by_prints(sets: DataFrame, apart: int = BITS_APART, hot: int = HOT) -> DataFrame:
    """a, b: each node with the least one whose fingerprint op9 links to one of its own."""
    prints = stored(sets.select("same", "fp").distinct(), "prints")
    nodes = stored(prints.select("fp", F.col("fp").alias("label")).distinct(), "nodes")
    table = pivot_table(nodes)
    linked = stored(prints.join(components(nodes, close_prints(table, apart, hot)), "fp").select("root", "same").distinct(), "by-prints")
    drop(table, prints, nodes)
    heads = linked.groupBy("root").agg(F.min("same").alias("b"))
    return linked.join(heads, "root").where("same <> b").select(F.col("same").alias("a"), "b")


def links(shared: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """a, b: verified pairs of each node b and the node that comes first in most of its keys."""
    sizes = shared.select(F.col("same").alias("first"), F.col("n").alias("m")).distinct()
    fit = shared.where("first <> same").groupBy("first", "same", "n").agg(F.count("*").alias("keys")).join(sizes, "first").where(F.least("n", "m") >= least * F.greatest("n", "m"))
    pairs = fit.groupBy(F.col("same").alias("b")).agg(F.max_by("first", F.struct("keys", -F.col("first"))).alias("a"))
    sides = [held.select(F.col("same").alias(end), F.col("shingles").alias(c)) for end, c in (("a", "x"), ("b", "y"))]
    full = pairs.join(sides[0].hint("merge"), "a").join(sides[1].hint("merge"), "b")
    return stored(full.select("a", "b", "x", "y").mapInArrow(lambda b: _alike(b, least), "a bigint, b bigint"), "alike")


def links_between(shared: DataFrame, held: DataFrame, roots: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """a, b: links between the groups that roots (fp, root) tells, wherever a key holds nodes of several."""
    keyed = stored(shared.select("key", "same", "n").join(roots.withColumnRenamed("fp", "same"), "same"), "rooted")
    open_ = keyed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("total")).where("low <> high")
    met = keyed.join(open_.select("key", F.ceil(F.col("total") / block).cast("int").alias("blocks")), "key").withColumn("mine", F.pmod(F.xxhash64("same"), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("mine")).alias("one"), F.greatest(x, F.col("mine")).alias("two"))))
    full = met.select("key", pair.alias("p"), "mine", "same", "root").join(held.hint("merge"), "same").select("key", "p.one", "p.two", "mine", "same", "root", "shingles")
    keys = ["key", "one", "two"]
    out = stored(full.repartition(*keys).sortWithinPartitions(*keys, "same").mapInArrow(lambda b: _settled(b, least), "a bigint, b bigint"), "between")
    drop(keyed)
    return out


def groups(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, component_id (the smallest doc_id of the group), row (row_key) and first (whether the row is the one that
    stands for its group: smallest doc_id, null last, then smallest row), for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", row_key().alias("row"))
    sets = stored(rows.mapInArrow(_printed, SETS.replace("shingles binary, ", "") + ", fp bigint"), "sets")
    nodes = stored(sets.select(F.col("same").alias("fp"), F.col("same").alias("label")).distinct(), "nodes")
    shared = shared_keys(sets)
    held = shared_sets(rows.mapInArrow(_sets, SETS), shared)  # made anew: all rows' shingles take as much disk as the texts
    first = stored(links(shared, held, least).unionByName(links_by_prints(sets)), "linked")
    rest = links_between(shared, held, stored(components(nodes, first), "first"), least)
    roots = sets.select("doc_id", "row", F.col("same").alias("fp")).join(components(nodes, first.unionByName(rest)), "fp")
    roots = stored(roots.select("doc_id", "row", "root"), "roots")
    drop(sets, shared, held)
    heads = roots.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head"))
    is_first = F.col("row").eqNullSafe(F.col("head.row")) & F.col("doc_id").eqNullSafe(F.col("head.doc_id"))
    return roots.join(heads, "root").select("doc_id", F.col("head.doc_id").alias("component_id"), "row", is_first.alias("first"))


def representatives(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs' own rows, one of each group; of rows with one doc_id and text, one."""
    keep = groups(docs, least).where("first").select(F.col("row").alias("_row"), F.col("doc_id").alias("_doc_id")).distinct()
    own = docs.select(F.struct("*").alias("own"), row_key().alias("row"), F.col("doc_id").cast("bigint").alias("id"))
    met = own.join(keep, (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_doc_id")), "left_semi")
    return met.dropDuplicates(["row", "id"]).select("own.*")

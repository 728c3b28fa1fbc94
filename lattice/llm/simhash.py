"""SimHash fingerprints of word shingles, and groups of fingerprints that differ in few bits.

Equal fingerprints are one row from the start, so copies never meet each other. The pivot table holds, for each distinct
fingerprint, its Hamming distances to many reference fingerprints: the 64 words of one bit, the zero word and 31 fixed
random words. It is computed once and stored; all pairs come from it.

- Cells. A fingerprint's distance to a one-bit word, less that to zero, is 1 or -1. Two fingerprints within distance r
  differ in at most r of those 64 coordinates; cut into r + 2 groups, two groups agree in full. Each choice of two groups
  is a cell of the table, and pairs are looked for inside of cells only. A cell with more than HOT fingerprints is cut
  again by the same rule over its other coordinates, as often as needed.
- Discarding. By the triangle inequality a pair within distance r differs by at most r in every coordinate; in a cell,
  ordered by the distance to zero, pairs with a larger difference in any of the other 32 coordinates are discarded.
- Verification. What is left is compared by its bits.

Only a spanning forest of each cell's links leaves a task. Components follow by label propagation with pointer jumps
over tables in the shared folder; nothing is gathered on the driver.

A null or empty text has no shingle and the fingerprint zero, which is linked like any other. A text of fewer words
than a shingle is one shingle. Repeated rows are kept; a row with a null doc_id has the component of its fingerprint,
and passes links on; a component of such rows alone has a null id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.common import stored, table, utf8, whole_groups

SHINGLE, BITS_APART, SEED, HOT = 3, 2, 42, 4000
#: The references: 64 words of one bit, which make the cells, then zero and random words, which discard.
ONE_BIT, RANDOM = 64, 31
REFERENCES = np.concatenate([np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)), [0], np.random.default_rng(9).integers(0, 1 << 64, RANDOM, np.uint64)]).astype(np.uint64)


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    parts = utf8(text).lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        shingles = [*map(b" ".join, zip(*(parts[k:] for k in range(words))))]
    hash_of = xxhash.xxh64_intdigest
    values = np.array([hash_of(s, seed) for s in shingles], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):
        ones += np.unpackbits(values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps)], names=["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def keys(free: list[int], apart: int) -> list[list[int]]:
    """The choices of two of apart + 2 groups of coordinates."""
    groups = [free[k :: apart + 2] for k in range(apart + 2)]
    return [sorted(a + b) for a, b in itertools.combinations(groups, 2)]


def distances(fps: np.ndarray, references: np.ndarray = REFERENCES) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.int8)


def pivot_table(distinct: DataFrame) -> DataFrame:
    """fp, distances (a byte for each reference) and cell (the signs of the one-bit coordinates, a bit each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = distances(batch.column(0).to_numpy().astype(np.uint64))
            cell = np.packbits(table[:, :ONE_BIT] < table[:, ONE_BIT, None], axis=1, bitorder="little").view("<u8").reshape(-1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in table], pa.binary()), pa.array(cell.astype(np.int64))], names=["fp", "distances", "cell"])

    return stored(distinct.select("fp").mapInArrow(run, "fp bigint, distances binary, cell bigint"), "pivot-table")


def close_pairs(fps: np.ndarray, rows: np.ndarray, apart: int, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) within the distance, block by block: those with a larger difference in any coordinate of
    rows are discarded, the others verified."""
    order = np.argsort(rows[:, 0], kind="stable")
    fps, rows = fps[order], rows[order]
    for at in range(0, len(fps), block):
        mine = slice(at, at + block)
        stop = int(np.searchsorted(rows[:, 0], rows[min(at + block, len(fps)) - 1, 0] + apart, "right"))
        i, j = np.nonzero(np.abs(rows[mine, None, 0] - rows[None, at:stop, 0]) <= apart)
        i, j = i + at, j + at
        keep = i < j
        i, j = i[keep], j[keep]
        for p in range(1, rows.shape[1]):
            keep = np.abs(rows[i, p] - rows[j, p]) <= apart
            i, j = i[keep], j[keep]
            if not len(i):
                break
        keep = np.bitwise_count(fps[i] ^ fps[j]) <= apart
        yield order[i[keep]], order[j[keep]]


def forest(fps: np.ndarray, rows: np.ndarray, apart: int) -> list[tuple[int, int]]:
    """Links that join what close pairs join, at most one fewer than fingerprints."""
    up = list(range(len(fps)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for i, j in close_pairs(fps, rows, apart):
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = top(a), top(b)
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((a, b))
    return out


def links(table: DataFrame, apart: int = BITS_APART, hot: int = HOT) -> DataFrame:
    """Pairs a, b of a pivot table's fingerprints whose links join all that lie within the distance."""
    found = None

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds in whole_groups(batches, 2):
            fps = part.column(2).to_numpy().astype(np.uint64)
            rows = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int8).reshape(len(fps), -1)
            a, b = [], []
            for k in np.flatnonzero(np.diff(bounds) > 1):
                own = slice(bounds[k], bounds[k + 1])
                for i, j in forest(fps[own], rows[own], apart):
                    a.append(fps[own][i])
                    b.append(fps[own][j])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).astype(np.int64)) for x in (a, b)], names=["a", "b"])

    rest = F.expr(f"substring(distances, {ONE_BIT + 1}, {1 + RANDOM})").alias("rest")
    level = table.select("fp", "cell", rest, F.lit("").alias("path"))
    options = {"": keys([*range(64)], apart)}
    while options:
        mask = F.create_map(*(x for path, cs in options.items() for x in (F.lit(path), F.array(*(F.struct(F.lit(f"{path}{n}.").alias("path"), F.lit(_mask(c)).alias("mask")) for n, c in enumerate(cs))))))
        keyed = level.select("fp", "cell", "rest", F.explode(F.element_at(mask, F.col("path"))).alias("c")).select("fp", "cell", "rest", F.col("c.path").alias("path"), F.col("cell").bitwiseAND(F.col("c.mask")).alias("key"))
        large = keyed.groupBy("path", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("path", "key")
        heavy = large.select("path").distinct().collect() if _splits(options, apart) else []
        if heavy:  # few paths: at most one for each choice of groups
            large = stored(large, "hot-cells")
            normal = keyed.join(large, ["path", "key"], "left_anti")
        else:
            normal = keyed
        part = normal.select("path", "key", "fp", "rest").repartition("path", "key").sortWithinPartitions("path", "key", "fp").mapInArrow(joined, "a bigint, b bigint")
        found = part if found is None else found.unionByName(part)
        if not heavy:
            break
        level = keyed.join(large, ["path", "key"], "left_semi").select("fp", "cell", "rest", "path")
        options = {r["path"]: keys(_free(r["path"], apart), apart) for r in heavy}
        # keys below a hot key hold its bits, too
        options = {p: [sorted(set(range(64)) - set(_free(p, apart)) | set(c)) for c in cs] for p, cs in options.items()}
    return found


def _free(path: str, apart: int) -> list[int]:
    free = [*range(64)]
    for n in map(int, path.split(".")[:-1]):
        free = sorted(set(free) - set(keys(free, apart)[n]))
    return free


def _splits(options: dict, apart: int) -> bool:
    """Whether the keys of this level leave enough coordinates for another one."""
    return all(len(_free(f"{p}0.", apart)) >= apart + 2 for p in options)


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """fp and root, the smallest label reachable; nodes (fp, label), edges (a, b). Each round takes the smallest label
    of the neighbours and of the own label's holder; rounds grow with the logarithm of a component's length."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    touched = both.select(F.col("a").alias("fp")).distinct()
    now = stored(nodes.join(touched, "fp", "left_semi").select("fp", F.col("label").alias("own"), F.col("label").alias("root")), "roots")
    for _ in range(rounds):
        near = both.join(now.select(F.col("fp").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = now.join(near.withColumnRenamed("a", "fp"), "fp", "left").select("fp", "own", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = step.groupBy(F.col("own").alias("root")).agg(F.min("root").alias("above"))
        # The holder of a label may itself have got a smaller one.
        after = stored(step.join(jump, "root", "left").select("fp", "own", "old", F.least("root", "above").alias("root")), "roots")
        changed = after.where("old <> root").limit(1).count()
        now = after.select("fp", "own", "root")
        if not changed:
            return nodes.join(now.select("fp", "root"), "fp", "left").select("fp", F.coalesce("root", "label").alias("root"))
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, apart: int = BITS_APART, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable)."""
    made = stored(fingerprints(docs, words), "fingerprints")
    # A label has to belong to one node: the id is followed by the fingerprint, and a null id comes after all others.
    label = F.struct(F.min("doc_id").isNull().alias("none"), F.min("doc_id").alias("id"), F.col("fp").alias("of"))
    nodes = stored(made.groupBy("fp").agg(label.alias("label")), "nodes")
    roots = components(nodes, links(pivot_table(nodes), apart, hot))
    return made.join(roots, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("root.id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

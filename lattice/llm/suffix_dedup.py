"""Removal of repeated long byte strings, by a sparse suffix array with deep-shallow sorting.

A string of LENGTH bytes that stands anywhere else, too, is removed wherever it stands. Not every suffix is sorted:
each window of LENGTH bytes has an anchor, the place in it whose GRAM-byte hash is least (leftmost of equals). The
anchor depends on nothing but the window's bytes, so equal windows have equal grams at their anchors, and only suffixes
at anchors whose gram stands twice or more are sorted. Consecutive windows with one anchor are a run.

1. Each document's runs, with hashes of gram and of all bytes of the run, go to a stored table: a row per ~137 bytes.
2. Runs whose gram stands once drop out. Runs with equal bytes are repeated as a whole.
3. One of each set of equal runs, where a gram has several, gets its bytes. In each gram's group the suffixes that
   begin at the anchor are sorted by multikey quicksort to a shallow depth, then by blind tries, and the reversed
   prefixes likewise. A window at distance o before its anchor is repeated if another run agrees on at least o bytes
   to the left and LENGTH - o to the right. Runs that agree to the left are merged from deep to shallow, the smaller
   into the larger; each merged run meets only its neighbours in the order of suffixes, as no other one agrees on more.
4. A gram with more than GROUP different runs is split: any two runs of it that share a window share the LENGTH - STEP
   bytes from one of a few fixed distances before the anchor, so runs are dealt by these strings and each of the groups
   is sorted as in 3. Only where such a string itself has over GROUP different surroundings, the windows of its runs
   are hashed and counted.

Hashes that stand for equality have 128 bits. Null texts are empty; texts of fewer bytes than LENGTH have no window.
Repeated rows repeat each other. A row is known by a hash of its doc_id and text and another one of its text, so rows
that share an id, or have none, keep their own spans. Other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.common import portions, row_key, stored, table, utf8, whole_groups

LENGTH, GRAM, SHALLOW, GROUP, STEP = 400, 128, 48, 1000, 16
#: A key with over 1/HOT of all runs is dealt to SALTS tasks; there can be no more than HOT such keys.
HOT, SALTS = 1000, 32
ODD = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BYTE_CODES = np.random.default_rng(4).integers(0, 1 << 64, 256, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of ODD and of its inverse, modulo 2**64."""
    if n not in _powers:
        if _powers:
            _powers.clear()

        def up(x: int) -> np.ndarray:
            factors = np.full(n + 1, x, np.uint64)
            factors[0] = 1
            return np.cumprod(factors, dtype=np.uint64)

        _powers[n] = up(ODD), up(pow(ODD, -1, 1 << 64))
    return _powers[n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the bytes of each place's gram."""
    size = 1 << max(16, int(len(data)).bit_length())
    up, down = powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, 1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, int, int]]:
    """Of texts of at least length bytes: (text, first window, last window, anchor, gram hash)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum([0, *map(len, texts)])
    h = gram_hashes(data, gram)
    bits = np.uint64(len(data)).item().bit_length()
    low = np.uint64((1 << bits) - 1)
    anchors = (sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & low).astype(np.int64)
    change = np.empty(len(anchors), bool)
    change[0] = True
    change[1:] = anchors[1:] != anchors[:-1]
    valid = np.zeros(len(anchors) + 1, np.int8)
    valid[starts[:-1]] += 1
    np.add.at(valid, starts[1:] - length + 1, -1)
    change[starts[:-1]] = True
    first = np.flatnonzero(change & (np.cumsum(valid[:-1]) > 0))
    owner = np.searchsorted(starts, first, "right") - 1
    last = np.minimum(np.append(first[1:], len(anchors)) - 1, starts[owner + 1] - length)
    at, s = anchors[first], starts[owner]
    yield from zip(owner.tolist(), (first - s).tolist(), (last - s).tolist(), (at - s).tolist(), h[at].view(np.int64).tolist())


def lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def blind_trie(strings: list[bytes], group: list[int]) -> list[int]:
    """The group in order. A node is [depth, {byte or -1 at the end: node or list of equal strings}]."""
    char = lambda s, d: s[d] if d < len(s) else -1
    root = [group[0]]
    for i in group[1:]:
        s, node = strings[i], root
        while isinstance(node, tuple):  # blind: only branching bytes are looked at
            node = node[1].get(char(s, node[0])) or next(iter(node[1].values()))
        t = strings[node[0]]
        d = lcp(s, t)
        if d == len(s) == len(t):
            node.append(i)
            continue
        above, node, edge = None, root, None
        while isinstance(node, tuple) and node[0] < d:
            above, edge = node, char(s, node[0])
            node = node[1][edge]
        if isinstance(node, tuple) and node[0] == d:
            node[1][char(s, d)] = [i]
            continue
        fork = (d, {char(t, d): node, char(s, d): [i]})
        if above is None:
            root = fork
        else:
            above[1][edge] = fork
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            todo += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def deep_shallow(strings: list[bytes], start: int = 0, shallow: int = SHALLOW) -> list[int]:
    """The strings' order: multikey quicksort by eight bytes at a time down to start + shallow, then blind tries."""
    out: list[int] = []
    todo = [([*range(len(strings))], start)]
    while todo:
        group, d = todo.pop()
        if len(group) < 2:
            out += group
        elif d >= start + shallow or len(group) < 4:
            out += blind_trie(strings, group)
        else:
            keys = [strings[i][d : d + 8] for i in group]
            pivot = keys[len(keys) // 2]
            less = [i for i, k in zip(group, keys) if k < pivot]
            same = [i for i, k in zip(group, keys) if k == pivot]
            more = [i for i, k in zip(group, keys) if k > pivot]
            todo.append((more, d))
            if len(pivot) < 8:
                todo.append((same, start + shallow))
            else:
                todo.append((same, d + 8))
            todo.append((less, d))
    return out


def agreements(contexts: list[bytes], anchors: list[int], gram: int, length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(context, L, R): another context agrees on L bytes before the anchor and R from it, L + R >= length; all that
    matter for which windows are repeated."""
    right = [c[a:] for c, a in zip(contexts, anchors)]
    left = [c[:a][::-1] for c, a in zip(contexts, anchors)]
    rank = [0] * len(contexts)
    by_rank = deep_shallow(right, gram)
    for k, i in enumerate(by_rank):
        rank[i] = k
    order = deep_shallow(left)
    shared = sorted(((lcp(left[a], left[b]), k) for k, (a, b) in enumerate(zip(order, order[1:]))), reverse=True)
    sets: list = [[rank[i]] for i in order]
    top = [*range(len(order))]

    def find(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    for depth, k in shared:
        a, b = find(k), find(k + 1)
        small, large = sorted((a, b), key=lambda x: len(sets[x]))
        for x in sets[small]:
            at = bisect_left(sets[large], x)
            for y in sets[large][max(0, at - 1) : at + 1]:
                i, j = by_rank[x], by_rank[y]
                both = lcp(right[i], right[j])
                if depth + both >= length:
                    yield i, depth, both
                    yield j, depth, both
        for x in sets[small]:
            insort(sets[large], x)
        sets[small] = []
        top[small] = large


RUNS = "gram bigint, whole bigint, doc bigint, text_hash bigint, p1 int, p2 int, anchor int"


def _find_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    types, names = [pa.int64()] * 4 + [pa.int32()] * 3, [x.split()[0] for x in RUNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((d, b) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if len(b := utf8(t)) >= length)
            for part in portions(rows, lambda r: len(r[1]), 1_500_000):
                texts, out = [b for _, b in part], []
                marks = [xxhash.xxh3_64_intdigest(b) - (1 << 63) for b in texts]
                hash_of = xxhash.xxh3_64_intdigest
                for k, p1, p2, anchor, h in runs(texts, length, gram):
                    out.append((h, hash_of(texts[k][p1 : p2 + length]) - (1 << 63), part[k][0], marks[k], p1, p2, anchor))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return docs.mapInArrow(run, RUNS)


def _contexts(docs: DataFrame, fine: DataFrame, length: int) -> DataFrame:
    """fine (gram, doc, text_hash, p1, p2, anchor, asks, large) with the runs' bytes."""
    wanted = fine.groupBy("doc").agg(F.collect_list(F.struct("gram", "text_hash", "p1", "p2", "anchor", "asks", "large")).alias("runs"))
    schema = "gram bigint, doc bigint, text_hash bigint, p1 int, p2 int, anchor int, asks boolean, large boolean, bytes binary"
    types = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.bool_()] * 2 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            out = []
            for doc, text, own in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if doc == before:  # the same row once more
                    continue
                before, data = doc, utf8(text)
                mark = xxhash.xxh3_64_intdigest(data) - (1 << 63)
                for r in own:
                    if r["text_hash"] == mark:
                        out.append((r["gram"], doc, mark, r["p1"], r["p2"], r["anchor"], r["asks"], r["large"], data[r["p1"] : r["p2"] + length]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.join(wanted, "doc").select("doc", "text", "runs").mapInArrow(run, schema)


SPANS = "doc bigint, text_hash bigint, start int, stop int"


def _sorted_spans(contexts: DataFrame, key: str, length: int, gram: int) -> DataFrame:
    """The spans that runs (key, doc, text_hash, p1, p2, anchor, asks, bytes) of one key share."""
    types, names = [pa.int64()] * 2 + [pa.int32()] * 2, ["doc", "text_hash", "start", "stop"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds in whole_groups(batches, 1):
            rows, out = part.to_pydict(), set()
            for x, y in zip(bounds, [*bounds[1:], len(part)]):
                if y - x < 2:
                    continue
                p1, p2, at = rows["p1"][x:y], rows["p2"][x:y], rows["anchor"][x:y]
                for i, left, right in agreements(rows["bytes"][x:y], [a - p for a, p in zip(at, p1)], gram, length):
                    first, last = max(p1[i], at[i] - left), min(p2[i], at[i] - length + right)
                    if rows["asks"][x + i] and first <= last:
                        out.add((rows["doc"][x + i], rows["text_hash"][x + i], first, last + length))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    keyed = contexts.select(key, "doc", "text_hash", "p1", "p2", "anchor", "asks", "bytes")
    return keyed.repartition(key).sortWithinPartitions(key, "doc", "text_hash", "p1").mapInArrow(run, SPANS)


def _shared_strings(contexts: DataFrame, length: int, gram: int, step: int) -> DataFrame:
    """part, doc, text_hash, p1: for each run the hashes of the length - step bytes that begin 0, step, 2 * step, ...
    bytes before its anchor. A window that begins o bytes before the anchor holds the string of the greatest distance
    up to o, so two runs that share a window share one of these."""
    types, names = [pa.binary(), pa.int64(), pa.int64(), pa.int32()], ["part", "doc", "text_hash", "p1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, mark, p1, anchor, data in zip(*(batch.column(k).to_pylist() for k in range(5))):
                for back in range(0, length - gram + 1, step):
                    at = anchor - p1 - back
                    if at >= 0 and at + length - step <= len(data):
                        # The distance is part of the key: equal strings at other distances share no window by way of it.
                        out.append((xxhash.xxh3_128_digest(data[at : at + length - step], back), doc, mark, p1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return contexts.select("doc", "text_hash", "p1", "anchor", "bytes").mapInArrow(run, "part binary, doc bigint, text_hash bigint, p1 int")


def _split_spans(contexts: DataFrame, length: int, gram: int, group: int, step: int) -> DataFrame:
    """The spans of grams with very many different runs."""
    strings = stored(_shared_strings(contexts, length, gram, step), "shared-strings")
    held = stored(strings.groupBy("part").agg(F.count("*").alias("n")).where("n > 1"), "repeated-strings")
    dealt = stored(_dealt_join(strings, held, ["part"], "part", strings.count(), ["n"]), "dealt-runs")
    on = ["doc", "text_hash", "p1"]
    out = _sorted_spans(contexts.join(dealt.where(F.col("n") <= group).select("part", *on), on), "part", length, gram)
    crowded = dealt.where(F.col("n") > group)
    if crowded.limit(1).count():
        out = out.unionByName(_counted_spans(contexts.join(crowded.select(*on).distinct(), on), length))
    return out


def _counted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Every window of the runs, by a hash of 128 bits."""
    schema = "window binary, doc bigint, text_hash bigint, start int, asks boolean"
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out += [(xxhash.xxh3_128_digest(r["bytes"][k : k + length]), r["doc"], r["text_hash"], r["p1"] + k, r["asks"]) for k in range(r["p2"] - r["p1"] + 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in schema.split(", ")])

    windows = contexts.mapInArrow(run, schema)
    twice = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    return windows.where("asks").join(twice, "window").select("doc", "text_hash", "start", (F.col("start") + length).alias("stop"))


def _dealt_join(found: DataFrame, keyed: DataFrame, on: list[str], key: str, total: int, take: list[str] = ()) -> DataFrame:
    """found joined with keyed (a row per value of on, with its number n of rows in found), of which take is added.
    Values of key that hold many of the total rows go to several tasks: found's rows by their place, keyed's rows to
    each of them."""
    hot = [r[0] for r in keyed.where(F.col("n") * HOT > total).select(key).collect()]  # at most HOT
    if hot:
        salt = F.pmod(F.xxhash64("doc", "text_hash", "p1"), F.lit(SALTS)).cast("int")
        found = found.withColumn("_salt", F.when(F.col(key).isin(hot), salt).otherwise(0))
        every = F.sequence(F.lit(0), F.lit(SALTS - 1))
        keyed = keyed.withColumn("_salt", F.explode(F.when(F.col(key).isin(hot), every).otherwise(F.array(F.lit(0)))))
        on = [*on, "_salt"]
    return found.join(keyed.select(*on, *take), on).drop("_salt")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int | None = None, group: int = GROUP) -> DataFrame:
    """doc, text_hash and the byte spans that repeated strings cover (they may overlap); docs (doc, text)."""
    gram = gram or max(1, min(GRAM, length // 3))
    step = max(1, min(STEP, length // 25))
    found = stored(_find_runs(docs, length, gram), "runs")
    total = found.count()
    twice = stored(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "repeated-grams")
    some = stored(_dealt_join(found, twice, ["gram"], "gram", total), "repeated-runs")
    sets = some.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(F.struct("doc", "text_hash", "p1", "p2", "anchor")).alias("one"))
    sets = stored(sets, "run-sets")
    several = sets.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", (F.col("n") > group).alias("large"))
    equal = _dealt_join(some, sets.where("n > 1"), ["gram", "whole"], "whole", total).select("doc", "text_hash", F.col("p1").alias("start"), (F.col("p2") + length).alias("stop"))
    fine = sets.join(several, "gram").select("gram", "one.*", (F.col("n") == 1).alias("asks"), "large")
    contexts = stored(_contexts(docs, fine, length), "run-bytes")
    out = equal.unionByName(_sorted_spans(contexts.where("not large"), "gram", length, gram))
    if contexts.where("large").limit(1).count():
        out = out.unionByName(_split_spans(contexts.where("large"), length, gram, group, step))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs; spans that touch are one."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame, length: int, gram: int | None, carried: list[str]) -> DataFrame:
    """rest (a struct of the carried columns), text, spans: of each row, also of repeated ones."""
    keyed = docs.select(row_key().alias("doc"), "text", F.struct(*(F.col(f"`{c}`") for c in carried)).alias("rest"))
    spans = repeated_spans(keyed.select("doc", "text"), length, gram)
    by_doc = spans.groupBy("doc").agg(F.collect_set(F.struct("text_hash", "start", "stop")).alias("spans"))
    return keyed.join(by_doc, "doc", "left").select("rest", "text", "spans")


def _own_spans(data: bytes, spans: list[dict] | None) -> list[tuple[int, int]]:
    if not spans:
        return []
    mark = xxhash.xxh3_64_intdigest(data) - (1 << 63)
    return merged([(s["start"], s["stop"]) for s in spans if s["text_hash"] == mark])


def remaining(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(data)]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    names, types = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 4 + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rest, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
                data = utf8(text)
                cut = _own_spans(data, spans)
                out.append((rest["doc_id"], len(data), sum(b - a for a, b in cut), len(cut), hashlib.sha256(remaining(data, cut)).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return _with_spans(own, length, gram, ["doc_id"]).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans widened to whole UTF-8 characters."""
    out = []
    for a, b in spans:
        while a > 0 and data[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        out.append((a, b))
    return merged(out)


def cleaned_texts(docs: DataFrame, length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """docs' own columns with the repeated strings cut out of the texts (whole characters); n_chars follows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data = utf8(text)
                own = whole_characters(data, _own_spans(data, spans))
                texts.append(remaining(data, own).decode("utf-8", "surrogatepass") if own else text)
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.string())], names=["rest", "text"])

    rest = [c for c in docs.columns if c != "text"]
    both = _with_spans(docs, length, gram, rest)
    out = both.mapInArrow(cut, both.drop("spans").schema)
    column = lambda c: F.col("text") if c == "text" else F.col(f"rest.`{c}`")
    made = {c: column(c).alias(c) for c in docs.columns}
    if "n_chars" in made:
        made["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*made.values())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT k, doc_id, x, length(x) // 2 AS n FROM d),
w AS (SELECT k, i, md5_number(substring(x, 2 * i + 1, {2 * LENGTH})) AS h FROM (SELECT k, x, unnest(range(n - {LENGTH - 1})) AS i FROM n WHERE n >= {LENGTH})),
again AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
hit AS (SELECT k, i FROM w WHERE h IN (FROM again)),
step AS (SELECT k, i, CASE WHEN i - lag(i) OVER o <= {LENGTH} THEN 0 ELSE 1 END AS new FROM hit WINDOW o AS (PARTITION BY k ORDER BY i)),
runs AS (SELECT k, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT k, i, sum(new) OVER (PARTITION BY k ORDER BY i) AS r FROM step) GROUP BY k, r),
cut AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY k ORDER BY a) IS NULL AS final FROM runs),
kept AS (SELECT k, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
    string_agg(substring(x, 2 * before + 1, 2 * (a - before)) || CASE WHEN final THEN substring(x, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS x
  FROM cut JOIN n USING (k) GROUP BY k)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.x, n.x))) AS kept_sha256
FROM n LEFT JOIN kept USING (k)
"""

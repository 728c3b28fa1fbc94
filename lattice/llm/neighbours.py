"""Nearest neighbours by collision counting over single-projection sorted arrays.

Vectors, scaled to length one, are projected on M fixed lines (random orthonormal bases, so that a base's lines carry
different evidence); each line keeps a sorted array. A query's window on every line is centred on its own projection and
widened step by step (virtual rehashing: nothing is hashed anew). A vector that has fallen into at least THRESHOLD of
the windows is a candidate; widening stops when a block has enough candidates for the number wanted plus LEAST and BETA
of its vectors. Candidates are verified by the exact cosine in double precision of the original vectors, largest first, ties
to the smaller id.

Vectors are dealt into blocks of bounded size by a hash of their id and are indexed once for up to QUERY_BLOCK queries;
more queries form more blocks of queries, and each pair of blocks is one group, so that memory doesn't depend on the
table. Equal vectors in a block are one indexed vector that stands for its smallest ids, as many as could be returned;
the others of its ids could not be.

Vectors that are null, zero or hold null or non-finite components take no part. Components of any size are fine: vectors
are scaled by powers of two before they are multiplied, which changes no cosine. Vectors of different lengths are not
compared. A repeated id with an equal vector counts once. Queries with fewer candidates than wanted get them all.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattice.llm.common import one_blas_thread, table

M, THRESHOLD, BETA, LEAST, BEGIN, BLOCK, QUERY_BLOCK = 128, 0.7, 0.05, 32, 0.75, 8192, 16_384
#: Half widths of the windows; projections of vectors of length one lie between -1 and 1.
WIDTHS = 0.002 * 1.05 ** np.arange(143)
SCHEMA = "query_id bigint, vec_id bigint, score double"


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x) < math.inf) & ~F.isnan(x), F.lit(False)))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def lines(dim: int, m: int, seed: int = 7) -> np.ndarray:
    """m lines as columns: random orthonormal bases, the last one in part."""
    rng = np.random.default_rng(seed)
    bases = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-m // dim))]
    return np.concatenate(bases, 1)[:, :m]


class Index:
    """Of one block's distinct vectors. All lines' sorted arrays lie end to end, 8 apart, so that one search finds the
    ends of a query's windows on all of them."""

    def __init__(self, vectors: np.ndarray, m: int = M):
        self.n, self.m, self.lines = len(vectors), m, lines(vectors.shape[1], m)
        on = (vectors @ self.lines).T
        order = np.argsort(on, axis=1, kind="stable")
        self.order = order.reshape(-1)
        self.shift = 8.0 * np.arange(m)
        self.sorted = (np.take_along_axis(on, order, 1) + self.shift[:, None]).reshape(-1)

    def windows(self, centres: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        ends = np.searchsorted(self.sorted, np.concatenate([centres - WIDTHS[step], centres + WIDTHS[step]]))
        return ends[: self.m], ends[self.m :]

    def candidates(self, queries: np.ndarray, want: int, threshold: float):
        """For each query, the numbers of vectors that collide often enough."""
        need, last = math.ceil(threshold * self.m), len(WIDTHS) - 1
        for centres in queries @ self.lines + self.shift:
            low, high = 0, last  # begin where all together collide nearly as often as needed; less isn't enough
            while low < high:
                middle = (low + high) // 2
                a, b = self.windows(centres, middle)
                if (b - a).sum() >= BEGIN * need * self.n:
                    high = middle
                else:
                    low = middle + 1
            step, (a, b) = low, self.windows(centres, low)
            counts = np.bincount(np.concatenate([self.order[x:y] for x, y in zip(a.tolist(), b.tolist())]), minlength=self.n)
            while np.count_nonzero(counts >= need) < min(want, self.n) and step < last:
                step += 1
                c, d = self.windows(centres, step)
                more = [self.order[x:y] for x, y in zip(c.tolist(), a.tolist())] + [self.order[x:y] for x, y in zip(b.tolist(), d.tolist())]
                counts += np.bincount(np.concatenate(more), minlength=self.n)
                a, b = c, d
            yield np.flatnonzero(counts >= need) if step < last else np.arange(self.n)  # wider than any distance


def _rows(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids = pdf["vec_id"].to_numpy(np.int64)
    vectors = np.stack(pdf["embedding"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, 1))
    both = np.argsort(ids, kind="stable")
    return ids[both], vectors[both]


def search_block(queries: pd.DataFrame, data: pd.DataFrame, k: int, threshold: float = THRESHOLD, beta: float = BETA) -> pd.DataFrame:
    query_ids, asked = _rows(queries)
    ids, vectors = _rows(data)
    if not len(ids) or not len(query_ids):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    distinct, inverse = np.unique(vectors, axis=0, return_inverse=True)
    inverse = inverse.reshape(-1)
    by = np.argsort(inverse, kind="stable")  # ids ascend within a vector
    bounds = np.searchsorted(inverse[by], np.arange(len(distinct) + 1))
    holders = [list(dict.fromkeys(ids[by[a:b]].tolist()))[: k + 1] for a, b in zip(bounds, bounds[1:])]
    even = lambda x: np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])  # noqa: E731  exact, and nothing overflows
    lengths = lambda x: np.sqrt((x * x).sum(1))
    one_blas_thread()
    distinct, asked, plain = even(distinct), even(asked), asked
    n_v, n_q = lengths(distinct), lengths(asked)
    out = []
    found_by = Index(distinct / n_v[:, None]).candidates(asked / n_q[:, None], k + 1 + LEAST + math.ceil(beta * len(distinct)), threshold)
    done = set()
    for qid, own, q, nq, found in zip(query_ids.tolist(), plain, asked, n_q, found_by):
        if (qid, own.tobytes()) in done:
            continue
        done.add((qid, own.tobytes()))
        scores = (distinct[found] * q).sum(1) / (n_v[found] * nq)
        if len(found) > 4 * k:
            near = scores >= np.partition(scores, -(k + 1))[-(k + 1)]
            found, scores = found[near], scores[near]
        best = sorted((-s, v) for s, f in zip(scores.tolist(), found.tolist()) for v in holders[f] if v != qid)[:k]
        out += [(qid, v, -s) for s, v in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, threshold: float = THRESHOLD, beta: float = BETA, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """vectors (vec_id, embedding) to query_id, rank, vec_id, score."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", is_query.alias("asks")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    n = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    blocks, query_blocks = max(1, math.ceil(n["n"] / block)), max(1, math.ceil(n["q"] / query_block))
    own = lambda b, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(b)).cast("int")
    every = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    dim = F.size("embedding").alias("dim")
    data = rows.select("vec_id", "embedding", dim, own(blocks, 1).alias("d"), every(query_blocks).alias("q"))
    asked = rows.where("asks").select("vec_id", "embedding", dim, own(query_blocks, 2).alias("q"), every(blocks).alias("d"))
    found = asked.groupBy("dim", "q", "d").cogroup(data.groupBy("dim", "q", "d")).applyInPandas(lambda a, b: search_block(a, b, k, threshold, beta), SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)

"""Graph algorithms that a task runs on whole components, a batch of them at a time, as one graph of numbered nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Edges that are looked at together, and bits of all sets of reachable nodes.
PART, BITS = 200_000, 1 << 28


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n, up: one of its component's numbers for each number in links (a, b)."""
    ends = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if not ends:
        return
    names, codes = np.unique(np.concatenate([np.concatenate(side) for side in zip(*ends)]), return_inverse=True)
    up = list(range(len(names)))
    half = len(codes) // 2
    for x, y in zip(codes[:half].tolist(), codes[half:].tolist()):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        up[max(x, y)] = min(x, y)
    for x in range(len(up)):  # a parent is smaller than its child
        up[x] = up[up[x]]
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[np.array(up, np.int64)])], names=["n", "up"])


def adjacent(n: int, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Where each node's neighbours begin, and the neighbours, along edges (a, b)."""
    return np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]).tolist(), b[np.argsort(a, kind="stable")].tolist()


def strong(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each node's strong component; a component's number is larger than those it leads to (Tarjan)."""
    start, to = adjacent(n, a, b)
    at, order, low, of = start[:n], [-1] * n, [0] * n, [-1] * n
    path, count, found = [], 0, 0
    for root in range(n):
        if order[root] >= 0:
            continue
        order[root] = low[root] = count
        count += 1
        path.append(root)
        work = [root]
        while work:
            v = work[-1]
            i = at[v]
            if i < start[v + 1]:
                at[v] = i + 1
                w = to[i]
                if order[w] < 0:
                    order[w] = low[w] = count
                    count += 1
                    path.append(w)
                    work.append(w)
                elif of[w] < 0 and order[w] < low[v]:
                    low[v] = order[w]
                continue
            work.pop()
            if work and low[v] < low[work[-1]]:
                low[work[-1]] = low[v]
            if low[v] == order[v]:
                while of[v] < 0:
                    of[path.pop()] = found
                found += 1
    return np.array(of, np.int64)


def flow_bridges(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each edge (a, b) lies on all ways from node 0, which reaches all nodes, to b: the only way into b but from
    nodes that b dominates. Dominators by Lengauer and Tarjan, with path compression."""
    start, to = adjacent(n, a, b)
    at, number, parent, work = start[:n], [-1] * n, [0], [0]
    number[0] = 0
    while work:  # depth first; from here on, nodes go by their numbers
        v = work[-1]
        i = at[v]
        if i == start[v + 1]:
            work.pop()
            continue
        at[v] = i + 1
        w = to[i]
        if number[w] < 0:
            number[w] = len(parent)
            parent.append(number[v])
            work.append(w)
    numbers = np.array(number, np.int64)
    a, b = numbers[a], numbers[b]
    start, into = adjacent(n, b, a)
    semi, label, above, idom, bucket = list(range(n)), list(range(n)), [-1] * n, [0] * n, [[] for _ in range(n)]

    def least(v: int) -> int:
        """The node of least semidominator on the way up in the forest."""
        path, x = [], v
        while above[x] >= 0 and above[above[x]] >= 0:
            path.append(x)
            x = above[x]
        for x in reversed(path):
            up = above[x]
            if semi[label[up]] < semi[label[x]]:
                label[x] = label[up]
            above[x] = above[up]
        return label[v]

    for w in range(n - 1, 0, -1):
        p = s = parent[w]
        for u in into[start[w] : start[w + 1]]:
            s = min(s, semi[least(u)] if above[u] >= 0 else u)
        semi[w] = s
        bucket[s].append(w)
        above[w] = p
        for u in bucket[p]:
            y = least(u)
            idom[u] = y if semi[y] < semi[u] else p
        bucket[p] = []
    size, first, after = [1] * n, [0] * n, [1] * n
    for w in range(1, n):
        if idom[w] != semi[w]:
            idom[w] = idom[idom[w]]
    for w in range(n - 1, 0, -1):
        size[idom[w]] += size[w]
    for w in range(1, n):  # places in the dominator tree: a node's subtree follows it
        d = idom[w]
        first[w] = after[d]
        after[d] += size[w]
        after[w] = first[w] + 1
    size, first = np.array(size), np.array(first)
    outside = (first[a] < first[b]) | (first[a] >= first[b] + size[b])
    return outside & (np.bincount(b[outside], minlength=n)[b] == 1)


def strong_bridges(of: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of edges inside of strong components (of: each node's): whether no other way leads from a to b. That is so for the
    bridges seen from any one node of the component, along the edges or against them."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = codes[: len(a)] + 1, codes[len(a) :] + 1
    heads = np.unique(of[nodes], return_index=True)[1] + 1
    above = np.zeros(len(heads), np.int64)  # one node before all
    ways = [flow_bridges(len(nodes) + 1, np.concatenate([above, x]), np.concatenate([heads, y]))[len(heads) :] for x, y in ((a, b), (b, a))]
    return ways[0] | ways[1]


def longer_ways(n: int, a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether another way leads from a to b, for each of the edges (a, b) of a graph without cycles, where a > b."""
    found = np.zeros(len(a), bool)
    open_ = np.flatnonzero((np.bincount(a, minlength=n)[a] > 1) & (np.bincount(b, minlength=n)[b] > 1))
    start, to = adjacent(n, a, b)
    targets, place = np.unique(b[open_], return_inverse=True)
    block = max(64, bits // max(n, 1))
    for low in range(0, len(targets), block):
        own = [0] * n
        for k, t in enumerate(targets[low : low + block].tolist()):
            own[t] = 1 << k
        mine = open_[(place >= low) & (place < low + block)]
        asked: dict[int, list[int]] = {}
        for e in mine.tolist():
            asked.setdefault(int(a[e]), []).append(e)
        reach = [0] * n
        for v in range(n):
            far = near = 0
            for w in to[start[v] : start[v + 1]]:
                far |= reach[w]
                near |= own[w]
            reach[v] = far | near
            for e in asked.get(v, ()):
                found[e] = far & own[int(b[e])] != 0
    return found


def needed(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether an edge (a, b) is the only way from a to b. Edges are distinct and none is a loop."""
    of = strong(n, a, b)
    x, y = of[a], of[b]
    inside, out = x == y, np.zeros(len(a), bool)
    if inside.any():
        out[inside] = strong_bridges(of, a[inside], b[inside])
    pairs, pair, times = np.unique(x[~inside] * n + y[~inside], return_inverse=True, return_counts=True)
    out[~inside] = ((times == 1) & ~longer_ways(n, pairs // n, pairs % n))[pair]
    return out


def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """source, target, type of the needed edges; batches (source, target, type, top), whole components in order of top."""
    for part in _whole(batches):
        k = len(part)
        kind = part.column(2).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        ids = pa.chunked_array([*part.column(0).chunks, *part.column(1).chunks]).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        nodes, codes = np.unique(np.concatenate([kind, kind]) * (2 * k) + ids, return_inverse=True)
        keep = needed(len(nodes), codes[:k], codes[k:])
        yield from part.select([0, 1, 2]).filter(pa.array(keep)).combine_chunks().to_batches()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    kept, rows = [], 0
    for batch in batches:
        kept.append(batch)
        rows += len(batch)
        if rows >= PART:
            part = pa.Table.from_batches(kept)
            top = part.column(3).to_numpy()
            cut = int(np.searchsorted(top, top[-1]))
            if cut:
                yield part.slice(0, cut)
                kept, rows = part.slice(cut).to_batches(), rows - cut
    if rows:
        yield pa.Table.from_batches(kept)

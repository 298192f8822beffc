"""Passes over graphs held in a task's arrays: vertices 0 to n - 1 in order of their ids, edges in a given order.

Each takes time linear in the edges, or that times a logarithm, whatever the shape, and some twenty arrays of numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


def chunks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows in tables of ``most`` rows, the last of less."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, most - n)
            b = b.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def batches_of(columns: dict[str, np.ndarray | pa.Array], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    yield from pa.table(columns).to_batches(max_chunksize=rows)


def dense(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids, sorted, and both ends as places in them."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    return ids, at[: len(u)], at[len(u) :]


def least(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest vertex that each reaches."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = _ends(label)


def _ends(to: np.ndarray) -> np.ndarray:
    """Where each comes to by following ``to``."""
    while True:
        far = to[to]
        if (far == to).all():
            return to
        to = far


def first_forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which edges Kruskal takes in their order: Boruvka, by the first edge out of every part."""
    tree = np.zeros(len(u), bool)
    at, a, b = np.arange(len(u)), u, v
    while True:
        apart = a != b
        at, a, b = at[apart], a[apart], b[apart]
        if not len(at):
            return tree
        best = np.full(n, len(at))
        place = np.arange(len(at))
        np.minimum.at(best, a, place)
        np.minimum.at(best, b, place)
        own = np.flatnonzero(best < len(at))
        pick = best[own]
        tree[at[pick]] = True
        to = np.arange(n)
        to[own] = a[pick] + b[pick] - own
        both = own[(to[to[own]] == own) & (own < to[own])]  # two parts that took the same edge
        to[both] = both
        to = _ends(to)
        a, b = to[a], to[b]


@dataclass
class Walk:
    """A forest rooted at the smallest vertex of each tree. ``top`` is the root, ``pre`` numbers all vertices tree after tree, those below one follow it, ``size`` with itself; roots have themselves as parent and -1 as edge."""

    top: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    depth: np.ndarray
    pre: np.ndarray
    size: np.ndarray


def rooted(n: int, u: np.ndarray, v: np.ndarray) -> Walk:
    """By an Euler tour, ranked by pointer doubling."""
    m = len(u)
    top = least(n, u, v)
    roots = np.flatnonzero(top == np.arange(n))
    tree = np.searchsorted(roots, top)
    sizes = np.bincount(tree, minlength=len(roots))
    start = np.cumsum(sizes) - sizes
    parent, edge, depth = np.arange(n), np.full(n, -1), np.zeros(n, np.int64)
    pre, size = np.empty(n, np.int64), np.empty(n, np.int64)
    pre[roots], size[roots] = start, sizes
    if not m:
        return Walk(top, parent, edge, depth, pre, size)
    src = np.concatenate([u, v])
    order = np.argsort(src, kind="stable")
    src, dst = src[order], np.concatenate([v, u])[order]
    place = np.empty(2 * m, np.int64)
    place[order] = np.arange(2 * m)
    twin = place[(order + m) % (2 * m)]
    first = np.searchsorted(src, np.arange(n + 1))
    after = twin + 1
    after = np.where(after == first[dst + 1], first[dst], after)
    is_head = np.zeros(2 * m, bool)
    is_head[first[roots][sizes > 1]] = True
    ends = np.flatnonzero(is_head[after])
    after[ends] = ends
    left = np.ones(2 * m, np.int64)  # arcs from here to the end of the tour
    left[ends] = 0
    while True:
        far = after[after]
        if (far == after).all():
            left += left[after]
            break
        left += left[after]
        after = far
    del after, is_head, place
    # a tree of k vertices has 2 (k - 1) arcs
    at = (2 * (start - np.arange(len(roots))) + 2 * (sizes - 1) - 1)[tree[src]] - left
    down = at < at[twin]
    runs = np.empty(2 * m, np.int64)
    runs[at] = np.where(down, 1, -1)
    run = np.cumsum(runs)
    downs = np.cumsum(runs > 0)
    k = np.flatnonzero(down)
    x = dst[k]
    parent[x], edge[x] = src[k], order[k] % m
    depth[x] = run[at[k]]
    pre[x] = downs[at[k]] + tree[x]
    size[x] = (at[twin[k]] - at[k] + 1) // 2
    return Walk(top, parent, edge, depth, pre, size)


def range_least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, none) -> np.ndarray:
    """The least of ``values[lo:hi]`` for each range, ``none`` for an empty one. One power of two after the other, so no table of all is held."""
    out = np.full(len(lo), none, values.dtype)
    length = hi - lo
    power = np.frexp(np.maximum(length, 1).astype(np.float64))[1] - 1
    power[length <= 0] = -1
    t, span, k = values.copy(), 1, 0
    longest = int(power.max()) if len(power) else -1
    while k <= longest:
        s = np.flatnonzero(power == k)
        out[s] = np.minimum(t[lo[s]], t[hi[s] - span])
        if span < len(t):
            t[:-span] = np.minimum(t[:-span], t[span:])
        span, k = span * 2, k + 1
    return out


def uncovered(w: Walk, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which vertices have no edge ``a, b`` off the tree from below them to elsewhere: the edge to their parent is a bridge."""
    n = len(w.pre)
    a, b = w.pre[a], w.pre[b]
    low, high = np.arange(n), -np.arange(n)
    np.minimum.at(low, a, b)
    np.minimum.at(low, b, a)
    np.minimum.at(high, a, -b)
    np.minimum.at(high, b, -a)
    end = w.pre + w.size
    return (w.edge >= 0) & (range_least(low, w.pre, end, n) >= w.pre) & (-range_least(high, w.pre, end, n) < end)


def blocks(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest vertex of the two-edge-connected component of each."""
    tree = first_forest(n, u, v)
    w = rooted(n, u[tree], v[tree])
    kept = np.flatnonzero((w.edge >= 0) & ~uncovered(w, u[~tree], v[~tree]))
    return least(n, kept, w.parent[kept])

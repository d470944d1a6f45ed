"""A hierarchical index over bit codes in Gray order (numpy).

Codes sorted by Gray rank have neighbours that differ in few bits. Runs of ``FAN`` neighbours are
factored into an upper node, the bits that all of them share (a mask and a pattern), and so on upward.
A search goes down from the top, adds up the differences that each node's newly shared bits show, and
leaves out whole groups once the sum exceeds the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN = 4
BLOCK = 512  # queries searched together
SMALL = 64  # codes of a sampled node that is compared directly
PAIRS = 1 << 17


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Gray ranks of codes, (n, words) of uint64 with the highest word first."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    for w in range(1, rank.shape[1]):  # the parity of what stands before flips the rest
        rank[:, w] ^= np.where(rank[:, w - 1] & np.uint64(1), ~np.uint64(0), np.uint64(0))
    return rank


def gray_order(codes: np.ndarray) -> np.ndarray:
    """Order of codes by Gray rank."""
    return np.lexsort(gray_rank(codes).T[::-1])


class GrayIndex:
    """Codes, or (mask, pattern) nodes over ranges of them, in Gray order."""

    def __init__(self, codes: np.ndarray, mask: np.ndarray | None = None):
        self.levels = [(np.full(codes.shape, ~np.uint64(0)) if mask is None else mask, codes)]  # upward: (mask, pattern)
        while len(self.levels[-1][0]) > FAN:
            mask, pattern = self.levels[-1]
            cuts = np.arange(0, len(mask), FAN)
            first = np.repeat(pattern[cuts], np.diff(np.append(cuts, len(mask))), axis=0)
            shared = np.bitwise_and.reduceat(mask & ~(pattern ^ first), cuts, axis=0)
            self.levels.append((shared, pattern[cuts] & shared))

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, distance) of all pairs at ``radius`` or less."""
        mask, pattern = self.levels[-1]
        q = np.repeat(np.arange(len(queries)), len(mask))
        node = np.tile(np.arange(len(mask)), len(queries))
        told = np.zeros((1, queries.shape[1]), np.uint64)  # bits that upper nodes have compared
        seen, dist = np.repeat(told, len(q), axis=0), np.zeros(len(q), np.int16)
        for depth in range(len(self.levels) - 1, -1, -1):
            mask, pattern = self.levels[depth]
            new = (queries[q] ^ pattern[node]) & mask[node] & ~seen
            dist = dist + np.bitwise_count(new).sum(1, dtype=np.int16)
            keep = np.flatnonzero(dist <= radius)
            q, node, dist = q[keep], node[keep], dist[keep]
            if depth:
                below = len(self.levels[depth - 1][0])
                seen = mask[node]
                first = node * FAN
                n = np.minimum(first + FAN, below) - first
                at = np.repeat(np.arange(len(node)), n)
                node = np.repeat(first, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                q, dist, seen = q[at], dist[at], seen[at]
        return q, node, dist


class Forest:
    """A growing spanning forest over n places: ``add`` returns the links that join two trees."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if (up == r).all():
                break
            r = up
        self.parent[x] = r
        return r

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places, in the two arrays, of the links taken, in their order."""
        taken: list[int] = []
        live = np.flatnonzero(self.roots(a) != self.roots(b))
        step = 4096
        for at in range(0, len(live), step):
            part = live[at : at + step]
            if at:  # links inside what is joined by now need no look
                part = part[self.roots(a[part]) != self.roots(b[part])]
            for k in part.tolist():
                i, j = self.root(int(a[k])), self.root(int(b[k]))
                if i != j:
                    self.parent[max(i, j)] = min(i, j)
                    taken.append(k)
        return np.array(taken, np.int64)


class RangeIndex:
    """The index of one range of codes, and a forest of the links found in it so far."""

    def __init__(self, codes: np.ndarray, radius: int):
        self.codes, self.radius = codes[gray_order(codes)], radius
        self.index, self.forest = GrayIndex(self.codes), Forest(len(codes) + BLOCK)

    def inside(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(code, code, distance): links between the range's own codes that join two trees."""
        for at in range(0, len(self.codes), BLOCK):
            q, c, d = self.index.within(self.codes[at : at + BLOCK], self.radius)
            later = np.flatnonzero(c > q + at)
            q, c, d = q[later] + at, c[later], d[later]
            taken = self.forest.add(q, c)
            yield self.codes[q[taken]], self.codes[c[taken]], d[taken]

    def with_others(self, probes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same between its codes and those of other ranges, each of which comes once."""
        n = len(self.codes)
        for at in range(0, len(probes), BLOCK):
            block = probes[at : at + BLOCK]
            q, c, d = self.index.within(block, self.radius)
            self.forest.parent[n:] = np.arange(n, n + BLOCK)  # own codes are the roots, so these can be forgotten
            taken = self.forest.add(c, n + q)
            yield self.codes[c[taken]], block[q[taken]], d[taken]


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _links(codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of all links of one node, by its index."""
    order = gray_order(codes)
    ordered = codes[order]
    index = GrayIndex(ordered)
    found = []
    for start in range(0, len(codes), BLOCK):
        q, c, x = index.within(ordered[start : start + BLOCK], radius)
        keep = c > q + start
        found.append((order[(q + start)[keep]], order[c[keep]], x[keep].astype(np.int16)))
    return tuple(np.concatenate(x) for x in zip(*found))


def small_links(codes: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for many nodes of at most SMALL codes, which gain nothing from upper levels: all pairs of a
    node, many nodes at once, about PAIRS pairs at a time."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16))]
    starts, pairs = np.cumsum(sizes) - sizes, np.cumsum(sizes * (sizes - 1) // 2)
    cuts = np.unique(np.searchsorted(pairs, np.arange(0, pairs[-1] if len(pairs) else 0, PAIRS), side="right").tolist() + [0, len(sizes)])
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        n = sizes[lo:hi]
        first = np.repeat(starts[lo:hi], n)
        at = starts[lo] + np.arange(int(n.sum()))
        place = at - first
        j = np.repeat(at, place)
        i = np.repeat(first, place) + np.arange(len(j)) - np.repeat(np.cumsum(place) - place, place)
        d = np.bitwise_count(codes[i] ^ codes[j]).sum(1, dtype=np.int16)
        keep = d <= radius
        found.append((i[keep], j[keep], d[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> list[tuple[int, int, int]]:
    """A spanning forest of links, the closest first."""
    by = np.argsort(d, kind="stable")
    a, b, d = a[by], b[by], d[by]
    parent, forest, step = list(range(n)), [], max(4096, 4 * n)
    for at in range(0, len(a), step):
        part = slice(at, at + step)
        if at:  # links inside what is joined already need no look
            roots = np.array([_root(parent, i) for i in range(n)])
            live = np.flatnonzero(roots[a[part]] != roots[b[part]]) + at
        else:
            live = range(at, min(at + step, len(a)))
        for k in live:
            i, j = _root(parent, int(a[k])), _root(parent, int(b[k]))
            if i != j:
                parent[max(i, j)] = min(i, j)
                forest.append((int(a[k]), int(b[k]), int(d[k])))
    return forest


def spanning_forest(codes: np.ndarray, sizes: np.ndarray, radius: int) -> list[tuple[int, int, int]]:
    """codes: those of nodes of the given sizes, one after the other. (i, j, distance): for each node a
    spanning forest of its links at ``radius`` or less.

    The forest joins what the links join, at that radius and at any smaller one, with fewer edges than
    codes.
    """
    starts = np.cumsum(sizes) - sizes
    small = np.flatnonzero(sizes <= SMALL)
    at = np.repeat(starts[small], sizes[small]) + np.arange(sizes[small].sum()) - np.repeat(np.cumsum(sizes[small]) - sizes[small], sizes[small])
    i, j, d = small_links(codes[at], sizes[small], radius)
    used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    forest = [(int(at[used[x]]), int(at[used[y]]), z) for x, y, z in _forest(len(used), place[: len(i)], place[len(i) :], d)]
    for k in np.flatnonzero(sizes > SMALL):
        s, n = int(starts[k]), int(sizes[k])
        forest += [(s + x, s + y, z) for x, y, z in _forest(n, *_links(codes[s : s + n], radius))]
    return forest


def between(codes: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): links at ``radius`` or less that join the codes of different roots, as a forest. Each such link
    has an end outside the most common root, so only those codes are looked up."""
    values, tree, count = np.unique(roots, return_inverse=True, return_counts=True)
    if len(values) < 2:
        return (np.zeros(0, np.int64),) * 2
    order = gray_order(codes)
    index, forest, found = GrayIndex(codes[order]), Forest(len(values)), []
    others = np.flatnonzero(tree != count.argmax())
    for at in range(0, len(others), 64):
        q, c, _ = index.within(codes[others[at : at + 64]], radius)
        i, j = others[at + q], order[c]
        taken = forest.add(tree[i], tree[j])
        found.append((i[taken], j[taken]))
    return tuple(np.concatenate(x) for x in zip(*found))

"""Vantage-point trees over 64-bit fingerprints under Hamming distance, and forests of them that lose no near pair."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np


def block_masks(n_blocks: int, within: int) -> list[tuple[int, int]]:
    """(mask, radius) such that two words at distance <= within differ in at most radius bits under some mask.

    n_blocks <= within: each block is a mask, and one of them has at most within // n_blocks of the
    differences. More blocks: at least n_blocks - within of them have none, so every union of that many
    blocks is a mask of radius 0.
    """
    edges = [round(64 * i / n_blocks) for i in range(n_blocks + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    if n_blocks <= within:
        return [(b, within // n_blocks) for b in blocks]
    return [(sum(c), 0) for c in combinations(blocks, n_blocks - within)]


@dataclass
class VPTree:
    """A tree over the Hamming metric of the bits in mask: a node keeps a vantage point and a distance; nearer points go left.

    Points within radius of a node's boundary go both ways, so each leaf, a shard, holds its own points and
    all within radius of them: every pair within radius meets in a leaf.
    """

    mask: int
    radius: int
    vantage: np.ndarray | list[int] = field(default_factory=list)
    limit: np.ndarray | list[int] = field(default_factory=list)
    left: np.ndarray | list[int] = field(default_factory=list)
    right: np.ndarray | list[int] = field(default_factory=list)
    leaves: int = 1

    @classmethod
    def build(cls, sample: np.ndarray, mask: int, radius: int, leaf_size: int) -> VPTree:
        """Splits a sample until leaves hold leaf_size of it, border points included, or no vantage point parts them well."""
        tree = cls(mask, radius)
        rng = np.random.default_rng(mask % (1 << 32))
        todo, leaves = [(sample, None)], 0
        while todo:
            points, where = todo.pop()
            at = tree._split(points, rng) if len(points) > leaf_size else None
            if at is None:
                ref, leaves = -1 - leaves, leaves + 1
            else:
                vantage, limit, d = at
                ref = len(tree.vantage)
                tree.vantage.append(int(vantage)), tree.limit.append(limit), tree.left.append(0), tree.right.append(0)
                todo += [(points[d - radius <= limit], (tree.left, ref)), (points[d + radius > limit], (tree.right, ref))]
            if where:
                where[0][where[1]] = ref
        tree.leaves = max(1, leaves)
        tree.vantage, tree.limit, tree.left, tree.right = (np.array(x, dtype=t) for x, t in ((tree.vantage, np.uint64), (tree.limit, np.int16), (tree.left, np.int32), (tree.right, np.int32)))
        return tree

    def _split(self, points: np.ndarray, rng) -> tuple | None:
        """(vantage point, limit, distances) of the best of some vantage points and limits: that whose larger side is least."""
        best, most = None, 0.9 * len(points)
        for v in points[rng.integers(0, len(points), 8)]:
            d = np.bitwise_count((points ^ v) & np.uint64(self.mask)).astype(np.int16)
            middle = int(np.median(d))
            for limit in range(middle - 2, middle + 2):
                left, right = int((d - self.radius <= limit).sum()), int((d + self.radius > limit).sum())
                if left and right and max(left, right) < most:
                    best, most = (v, limit, d), max(left, right)
        return best

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, places of the points that belong to it or lie within radius of its boundary).

        By the triangle inequality a point at distance d from the vantage point has no point within
        radius on the left unless d - radius <= limit, and none on the right unless d + radius > limit:
        such a branch is pruned.
        """
        if not len(self.vantage):
            yield 0, np.arange(len(points))
            return
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                yield -1 - node, at
                continue
            d = np.bitwise_count((points[at] ^ self.vantage[node]) & np.uint64(self.mask)).astype(np.int16)
            todo += [(int(self.left[node]), at[d - self.radius <= self.limit[node]]), (int(self.right[node]), at[d + self.radius > self.limit[node]])]


def spanning_links(points: np.ndarray, within: int) -> list[tuple[int, int]]:
    """Links (places) that join exactly the points that a chain of pairs at distance <= within joins.

    Points are sorted by distance to a vantage point, so those within reach of one lie in a window of
    2 * within + 1 distances. A point leaves once it is reached, so dense clusters cost little and no
    more than len(points) - 1 links come out.
    """
    n = len(points)
    if n < 2:
        return []
    d = np.bitwise_count(points ^ points[0]).astype(np.int16)
    order = np.argsort(d, kind="stable")
    p, d = points[order], d[order]
    low, high = np.searchsorted(d, d - within), np.searchsorted(d, d + within, side="right")
    alive, out = np.ones(n, dtype=bool), []
    for start in range(n):
        if not alive[start]:
            continue
        alive[start] = False
        todo = [start]
        while todo:
            i = todo.pop()
            a, b = low[i], high[i]
            hits = np.nonzero((np.bitwise_count(p[a:b] ^ p[i]) <= within) & alive[a:b])[0] + a
            if len(hits):
                alive[hits] = False
                out += [(int(order[i]), int(order[j])) for j in hits]
                todo += hits.tolist()
    return out


#: Groups of points alike in the mask whose pairs are made at once; pairs made at a time.
SMALL, PAIRS = 32, 1 << 20


def leaf_links(points: np.ndarray, mask: int, radius: int, within: int) -> list[tuple[int, int]]:
    """Links within a leaf, of pairs that differ in at most radius bits of the mask: the others meet under another mask."""
    if radius > 1:
        return spanning_links(points, within)
    masked = points & np.uint64(mask)
    order = np.argsort(masked, kind="stable")
    p, m = points[order], masked[order]
    first = np.concatenate([[0], np.nonzero(np.diff(m))[0] + 1]) if len(m) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(m)]]))
    found: list[np.ndarray] = []

    def near(i: np.ndarray, j: np.ndarray) -> None:
        hit = np.bitwise_count(p[i] ^ p[j]) <= within
        found.append(np.stack([i[hit], j[hit]], axis=1))

    # alike in the mask: all pairs of small groups, a spanning forest of large ones, whose trees are named by label
    small, label = np.repeat(size <= SMALL, size), np.arange(len(p))
    for k in range(1, min(SMALL, int(size.max(initial=0)))):
        i = np.nonzero((m[k:] == m[:-k]) & small[k:])[0]
        near(i, i + k)
    for g in np.nonzero(size > SMALL)[0]:
        links = np.array(spanning_links(p[first[g] : first[g] + size[g]], within), dtype=np.int64).reshape(-1, 2) + first[g]
        for i, j in links.tolist():
            label[j] = label[i]
        found.append(links)
    # one bit of the mask apart
    values = m[first]
    for bit in range(64 if radius else 0):
        if not mask >> bit & 1:
            continue
        other = values ^ np.uint64(1 << bit)
        at = np.minimum(np.searchsorted(values, other), max(0, len(values) - 1))
        g = np.nonzero((values[at] == other) & (values < other))[0]
        h = at[g]
        many = (size[g] > SMALL) | (size[h] > SMALL)
        for a, b in zip(g[many].tolist(), h[many].tolist(), strict=True):
            a, b = (a, b) if size[a] <= size[b] else (b, a)
            large = np.arange(first[b], first[b] + size[b])
            for q in range(first[a], first[a] + size[a]):
                hits = large[np.bitwise_count(p[large] ^ p[q]) <= within]
                hits = hits[np.unique(label[hits], return_index=True)[1]]  # one of each tree will do
                found.append(np.stack([np.full(len(hits), q), hits], axis=1))
        g, h = g[~many], h[~many]
        pairs = size[g] * size[h]
        ends = np.cumsum(pairs)
        start = 0
        while start < len(g):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS)))
            n = pairs[start:stop]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(size[h[start:stop]], n)
            near(np.repeat(first[g[start:stop]], n) + k // width, np.repeat(first[h[start:stop]], n) + k % width)
            start = stop
    links = order[np.concatenate(found)] if found else np.zeros((0, 2), np.int64)
    return [(int(i), int(j)) for i, j in links.tolist()]

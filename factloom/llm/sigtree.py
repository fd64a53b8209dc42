"""Signature trees: nodes hold OR-combined token bitmaps and size ranges, and a dual traversal prunes pairs of nodes.

A set's bitmap has at least twice as many bits as the set has members.  A member of both sets sets a bit in both bitmaps, so
two sets share at most (members of a) - (bits of a that b lacks) members, and sets below two nodes at most the common
bits of the nodes plus the most members that share a bit with another in one set.  Nodes that can't reach the overlap
which the threshold asks for, or whose size ranges don't meet, are left out with all that is below them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Similarity as a fraction, and sets in a leaf and nodes below a node.
OVER, UNDER = 4, 5
LEAF, FANOUT = 32, 8


def bits_for(n: int) -> int:
    """Bits of the bitmap of a set of n members: a power of two, 64 at least."""
    return 1 << max(6, int(2 * n - 1).bit_length())


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """The set's bitmap as 64-bit words, from the low bits of its members' hashes."""
    m = bits_for(len(hashes))
    flags = np.zeros(m, np.uint8)
    flags[(hashes & np.uint64(m - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def fold(maps: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of half (a quarter, ...) the bits: the upper halves joined onto the lower ones."""
    while maps.shape[-1] > width:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] | maps[..., half:]
    return maps


def needed(a, b):
    """The least overlap of sets of a and b members that are similar enough."""
    return -(-OVER * (a + b) // (OVER + UNDER))


class Forest:
    """Union-find over indices."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while True:
            more = self.up[r]
            if (more == r).all():
                break
            r = more
        self.up[at] = r
        return r

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


class Node:
    __slots__ = ("at", "below", "excess", "high", "low", "map")

    def __init__(self, at, low, high, excess, map_, below):
        self.at, self.low, self.high, self.excess, self.map, self.below = at, low, high, excess, map_, below


def tree(at: np.ndarray, sizes: np.ndarray, maps: np.ndarray) -> Node:
    """A tree over the sets `at` (ordered by size); maps has their bitmaps, all of one width."""
    excess = sizes - np.bitwise_count(maps).sum(1)
    level = [Node(at[i : i + LEAF], int(sizes[i]), int(sizes[i : i + LEAF][-1]), int(excess[i : i + LEAF].max()), np.bitwise_or.reduce(maps[i : i + LEAF], 0), maps[i : i + LEAF]) for i in range(0, len(at), LEAF)]
    while len(level) > 1:
        level = [Node(np.concatenate([x.at for x in level[i : i + FANOUT]]), level[i].low, max(x.high for x in level[i : i + FANOUT]), max(x.excess for x in level[i : i + FANOUT]), np.bitwise_or.reduce([x.map for x in level[i : i + FANOUT]], 0), level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
    return level[0]


def _apart(x: Node, y: Node, width: int) -> bool:
    """No set below x is similar to one below y."""
    if OVER * y.low > UNDER * x.high or OVER * x.low > UNDER * y.high:
        return True
    common = int(np.bitwise_count(fold(x.map, width) & fold(y.map, width)).sum())
    # folding may bring more members of a set onto one bit: then the bound is void for the wider one
    slack = min(n.excess for n in (x, y) if n.map.shape[-1] == width)
    return common + slack < needed(x.low, y.low)


def link(forest: Forest, sizes: np.ndarray, maps: list[np.ndarray], similar: Callable[[int, int], bool] | None, at: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Joins all similar sets in the forest; returns the links that joined two trees of it.

    maps: a bitmap for each set.  similar: an exact test, or None if the bound on the overlap is enough (then sets that
    are not similar may be joined, never the other way round).  at: the sets to look at (all, if None).
    """
    links: list[tuple[int, int]] = []
    at = np.arange(len(sizes)) if at is None else at
    roots = forest.roots(at)
    if len(at) < 2 or (roots == roots[0]).all():
        return links
    at = at[np.argsort(sizes[at], kind="stable")]
    width = np.array([len(maps[i]) for i in at])
    trees = [tree(at[width == w], sizes[at[width == w]], np.stack([maps[i] for i in at[width == w]])) for w in np.unique(width)]
    stack = [(x, y) for i, x in enumerate(trees) for y in trees[i : i + 2] if y is x or len(y.map) <= 2 * len(x.map)]
    while stack:
        x, y = stack.pop()
        w = min(len(x.map), len(y.map))
        if x is not y and _apart(x, y, w):
            continue
        rx, ry = forest.roots(x.at), forest.roots(y.at)
        if rx[0] == ry[0] and (rx == rx[0]).all() and (ry == rx[0]).all():
            continue
        inner_x, inner_y = isinstance(x.below, list), isinstance(y.below, list)
        if not inner_x and not inner_y:
            _leaves(forest, sizes, x, y, w, similar, links)
        elif x is y:
            stack += [(a, b) for i, a in enumerate(x.below) for b in x.below[i:]]
        elif inner_x and (not inner_y or len(x.at) >= len(y.at)):
            stack += [(a, y) for a in x.below]
        else:
            stack += [(x, b) for b in y.below]
    return links


def _leaves(forest: Forest, sizes: np.ndarray, x: Node, y: Node, w: int, similar, links: list[tuple[int, int]]) -> None:
    mx, my = fold(x.below, w), fold(y.below, w)
    sx, sy = sizes[x.at][:, None], sizes[y.at][None]
    lack_x = np.stack([np.bitwise_count(m & ~my).sum(1) for m in mx])  # bits of x's sets that y's sets lack
    lack_y = np.bitwise_count(my).sum(1)[None] + lack_x - np.bitwise_count(mx).sum(1)[:, None]
    most = np.minimum(sx - lack_x, sy - lack_y)
    ok = (most >= needed(sx, sy)) & (OVER * sy <= UNDER * sx) & (OVER * sx <= UNDER * sy)
    if x is y:
        ok = np.triu(ok, 1)
    i, j = np.nonzero(ok)
    for k in np.argsort(-most[i, j], kind="stable"):  # the likeliest first, so that joined sets need no test
        a, b = int(x.at[i[k]]), int(y.at[j[k]])
        if forest.root(a) != forest.root(b) and (similar is None or similar(a, b)):
            forest.join(a, b)
            links.append((a, b))

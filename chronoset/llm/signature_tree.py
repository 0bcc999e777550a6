"""Signature trees over sets of 64-bit tokens: every node holds an OR of token bitmaps, a range of set sizes and an excess.

A bitmap has one bit for each hash place, so tokens can share a bit; a set's excess is its size less its bits. Two sets below
nodes A and B share at most popcount(A & B) + min(excess of A, excess of B) tokens; where that is less than what the smallest
sizes below them need, the pair of nodes is dropped with all below it. A pair is also dropped if everything below both is in
one component already, as only components are asked for: a group of n alike sets costs about n comparisons, not n squared.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FANOUT = 8
LEAST_BITS, MOST_BITS = 256, 1 << 15


def width(n: int) -> int:
    """Bits of a bitmap for n tokens: a power of two of 2 n or more within the bounds."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 2 * n):
        bits *= 2
    return bits


def bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(width(len(tokens)), dtype=bool)
    bits[(tokens & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def narrow(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of half the width has the OR of both halves."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


class Components:
    def __init__(self, n: int, labels: list[int] | None = None):
        self.up = list(range(n))
        first: dict[int, int] = {}
        for i, x in enumerate(labels or ()):
            self.up[i] = first.setdefault(x, i)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(i)] = self.find(j)


def links(maps: list[np.ndarray], sizes: list[int], num: int, den: int, exact: Callable[[int, int], bool] | None = None, labels: list[int] | None = None, right: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of places whose Jaccard similarity can be num / den or more and for which exact() holds: a forest with the components
    that all such pairs have.

    labels: places of a label count as linked before. right: only pairs with a place of the right side are asked for.
    """
    known = Components(len(maps), labels)
    out: list[tuple[int, int]] = []
    widths = np.array([len(m) for m in maps])
    for words in np.unique(widths):  # linked sets differ by one step of width at most
        which = np.flatnonzero((widths == words) | ((widths == 2 * words) if num * 2 > den else (widths > words)))
        if len(which) > 1:
            size = np.array([sizes[i] for i in which], dtype=np.int64)
            out += _traverse(which, np.stack([narrow(maps[i], words) for i in which]), size, num, den, exact, known, None if right is None else right[which])
    return out


def _traverse(which: np.ndarray, maps: np.ndarray, size: np.ndarray, num: int, den: int, exact: Callable[[int, int], bool] | None, known: Components, right: np.ndarray | None) -> list[tuple[int, int]]:
    order = np.lexsort((maps[:, 0], size))
    which, maps, size = which[order], maps[order], size[order]
    name = which.tolist()
    excess = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
    levels = [(maps, size, size, excess, None if right is None else right[order])]
    while len(levels[-1][0]) > 1:
        maps, least, most, excess, asked = levels[-1]
        at = np.arange(0, len(maps), FANOUT)
        levels.append((np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.maximum.reduceat(excess, at), None if asked is None else np.logical_or.reduceat(asked, at)))
    span = [FANOUT**k for k in range(len(levels))]
    uniform = [[True] * len(name)] + [[False] * len(x[0]) for x in levels[1:]]
    find = known.find

    def one(k: int, i: int) -> bool:
        """All below node i of level k is in one component."""
        if not uniform[k][i]:
            root = find(name[i * span[k]])
            uniform[k][i] = all(one(k - 1, c) and find(name[c * span[k - 1]]) == root for c in range(i * FANOUT, min((i + 1) * FANOUT, len(uniform[k - 1]))))
        return uniform[k][i]

    out: list[tuple[int, int]] = []
    stack = [(len(levels) - 1, 0, 0)]
    while stack:
        k, i, j = stack.pop()
        if find(name[i * span[k]]) == find(name[j * span[k]]) and one(k, i) and one(k, j):
            continue
        if k == 0:
            if exact is None or exact(name[i], name[j]):
                out.append((name[i], name[j]))
                known.join(name[i], name[j])
            continue
        maps, least, most, excess, asked = levels[k - 1]
        a, b, c, d = i * FANOUT, min((i + 1) * FANOUT, len(maps)), j * FANOUT, min((j + 1) * FANOUT, len(maps))
        need = -(-num * (least[a:b, None] + least[c:d]) // (den + num))
        shared = np.bitwise_count(maps[a:b, None] & maps[c:d]).sum(axis=2, dtype=np.int64) + np.minimum(excess[a:b, None], excess[c:d])
        keep = (shared >= need) & (most[a:b, None] * den >= num * least[c:d]) & (most[c:d] * den >= num * least[a:b, None])
        if asked is not None:
            keep &= asked[a:b, None] | asked[c:d]
        x, y = np.nonzero(keep)
        if len(x):
            pairs = [(k - 1, a + p, c + q) for p, q in zip(x.tolist(), y.tolist(), strict=True) if i != j or p < q or (p == q and k > 1)]
            pairs.sort(key=lambda t: (t[1] != t[2], t[1], t[2]), reverse=True)  # a node with itself comes off the stack first
            stack += pairs
    return out


def set_links(sets: list[np.ndarray], num: int, den: int, labels: list[int] | None = None, right: np.ndarray | None = None) -> list[tuple[int, int]]:
    """links() of sorted sets of distinct tokens, each checked exactly."""

    def exact(i: int, j: int) -> bool:
        a, b = sets[i], sets[j]
        both = np.concatenate((a, b))
        both.sort()
        shared = int((both[1:] == both[:-1]).sum())
        return shared * (den + num) >= num * (len(a) + len(b))

    return links([bitmap(s) for s in sets], [len(s) for s in sets], num, den, exact, labels, right)

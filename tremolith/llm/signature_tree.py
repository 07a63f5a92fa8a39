"""Signature trees over sets, and the dual traversal that joins two of them.

A set's signature is a bitmap with a bit for each of its tokens.  A node holds
the OR of its sets' bitmaps, the range of their sizes and the least number of
bits any of them has.  Two nodes are skipped if no pair below them can reach the
similarity: their sizes lie too far apart, all sets below carry one label, or
the largest overlap that the bitmaps allow is too small.

Bounds.  x's bits within node B's OR lie in OR(A) & OR(B) for x below A, so at
least bits(x) - |OR(A) & OR(B)| tokens of x are in no set below B, and the
overlap is at most size(x) minus that.  Jaccard(x, y) >= 3/4 holds exactly if
7 * overlap >= 3 * (size(x) + size(y)).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Sets of a leaf, and tokens of its sets together unless it holds one set only.
LEAF, LEAF_TOKENS = 48, 400_000
FANOUT = 6


def bits_for(size: int) -> int:
    """The signature width for a set: two to four bits a token, 256 at least."""
    return max(256, 2 << max(0, int(size) - 1).bit_length())


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The signature of a set of 64-bit tokens; ``bits`` is a power of two."""
    out = np.zeros(bits, bool)
    out[tokens & np.uint64(bits - 1)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Signatures (rows) cut to ``words`` words, as if built with that width."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def near(sizes: tuple[int, int], maps: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether the signatures allow two sets to link."""
    m, n = sizes
    if 4 * m < 3 * n or 4 * n < 3 * m:
        return False
    words = min(map(len, maps))
    a, b = (fold(x[None, :], words)[0] for x in maps)
    shared = int(np.bitwise_count(a & b).sum())
    most = min(m - (int(np.bitwise_count(a).sum()) - shared), n - (int(np.bitwise_count(b).sum()) - shared))
    return 7 * most >= 3 * (m + n)


class Tree:
    """Sets given by size, signature and label."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, labels: np.ndarray):
        self.sizes, self.maps, self.labels = sizes, maps, labels
        self.counts = np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        order = np.lexsort((labels, sizes))
        level, a, tokens = [], 0, np.cumsum(sizes[order])
        while a < len(order):
            most = int(np.searchsorted(tokens, (tokens[a - 1] if a else 0) + LEAF_TOKENS, "right"))
            b = max(a + 1, min(a + LEAF, most))
            level.append(self._leaf(order[a:b]))
            a = b
        while len(level) > 1:
            level = [self._join(level[a : a + FANOUT]) for a in range(0, len(level), FANOUT)]
        self.root = level[0]

    def _leaf(self, rows: np.ndarray) -> tuple:
        s, n = self.sizes[rows], self.labels[rows]
        return (s.min(), s.max(), n.min(), n.max(), self.counts[rows].min(), np.bitwise_or.reduce(self.maps[rows], axis=0), rows, None)

    def _join(self, nodes: list[tuple]) -> tuple:
        low = [min(n[k] for n in nodes) for k in (0, 2, 4)]
        high = [max(n[k] for n in nodes) for k in (1, 3)]
        return (low[0], high[0], low[1], high[1], low[2], np.bitwise_or.reduce(np.stack([n[5] for n in nodes]), axis=0), None, nodes)


def _apart(a: tuple, b: tuple) -> bool:
    """Whether no pair below the two nodes can link."""
    if 4 * a[1] < 3 * b[0] or 4 * b[1] < 3 * a[0] or a[2] == a[3] == b[2] == b[3]:
        return True
    shared = int(np.bitwise_count(a[5] & b[5]).sum())
    most = min(a[1] - max(0, a[4] - shared), b[1] - max(0, b[4] - shared))
    return 7 * most < 3 * (a[0] + b[0])


def dual_join(left: Tree, right: Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of different labels that may reach 3/4, leaf pair by leaf pair."""
    stack = [(left.root, right.root)]
    while stack:
        a, b = stack.pop()
        if _apart(a, b):
            continue
        if a[7] is None and b[7] is None:
            x, y = a[6], b[6]
            sx, sy = left.sizes[x][:, None], right.sizes[y][None, :]
            shared = np.stack([np.bitwise_count(left.maps[i] & right.maps[y]).sum(axis=1) for i in x]).astype(np.int64)
            most = np.minimum(sx - (left.counts[x][:, None] - shared), sy - (right.counts[y][None, :] - shared))
            i, j = np.nonzero((7 * most >= 3 * (sx + sy)) & (left.labels[x][:, None] != right.labels[y][None, :]))
            if len(i):
                yield x[i], y[j]
        elif b[7] is None or (a[7] is not None and a[1] - a[0] >= b[1] - b[0]):
            stack += [(n, b) for n in a[7]]
        else:
            stack += [(a, n) for n in b[7]]


def join_sets(sizes: np.ndarray, maps: list[np.ndarray], labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of the rows ``left`` with the rows ``right``.  Signatures
    differ in width, which follows the sizes, so only widths one doubling apart
    can hold similar sets; the wider one is folded."""
    widths = np.array([len(m) for m in maps])

    def by_width(rows: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return {w: (some := rows[widths[rows] == w], np.stack([maps[i] for i in some])) for w in np.unique(widths[rows]).tolist()}

    ours, theirs = by_width(left), by_width(right)
    for w, (rows, mine) in ours.items():
        for v in (w // 2, w, 2 * w):
            if v in theirs:
                others, yours = theirs[v]
                u = min(v, w)
                for i, j in dual_join(Tree(sizes[rows], fold(mine, u), labels[rows]), Tree(sizes[others], fold(yours, u), labels[others])):
                    yield rows[i], others[j]


#: Words of signatures that are laid side by side at once.
_AT_ONCE = 1 << 20


def join_leaves(sizes: np.ndarray, maps: list[np.ndarray], labels: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As :func:`join_sets`, of many groups at once that are a leaf on either side:
    candidate pairs of the rows ``left`` with the rows ``right`` of the same group.
    Both are sorted by ``group``, which names each row's."""
    begin, end = (np.searchsorted(group[right], group[left], s) for s in ("left", "right"))
    total = np.concatenate(([0], np.cumsum(end - begin)))
    a = 0
    while a < len(left):
        b = max(a + 1, int(np.searchsorted(total, total[a] + _AT_ONCE, "right")) - 1)
        many = (end - begin)[a:b]
        x = np.repeat(left[a:b], many)
        y = right[np.arange(len(x)) - np.repeat(total[a:b] - total[a], many) + np.repeat(begin[a:b], many)]
        a = b
        keep = (labels[x] != labels[y]) & (4 * sizes[x] >= 3 * sizes[y]) & (4 * sizes[y] >= 3 * sizes[x])
        x, y = x[keep], y[keep]
        if len(x):
            yield from _near_many(sizes, maps, x, y)


def _near_many(sizes: np.ndarray, maps: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The row pairs that :func:`near` allows."""
    widths = np.zeros(len(maps), np.int64)
    rows = np.unique(np.concatenate((x, y)))
    widths[rows] = [len(maps[i]) for i in rows.tolist()]
    narrow = np.minimum(widths[x], widths[y])
    place = np.zeros(len(maps), np.int64)
    for w in np.unique(narrow).tolist():
        i, j = x[narrow == w], y[narrow == w]
        used = np.unique(np.concatenate((i, j)))
        place[used] = np.arange(len(used))
        flat = np.stack([maps[k] if len(maps[k]) == w else fold(maps[k][None, :], w)[0] for k in used.tolist()])
        bits = np.bitwise_count(flat).sum(axis=1, dtype=np.int64)
        step = max(1, _AT_ONCE // w)
        for c in range(0, len(i), step):
            p, q = i[c : c + step], j[c : c + step]
            pp, qq = place[p], place[q]
            shared = np.bitwise_count(flat[pp] & flat[qq]).sum(axis=1, dtype=np.int64)
            most = np.minimum(sizes[p] - (bits[pp] - shared), sizes[q] - (bits[qq] - shared))
            keep = 7 * most >= 3 * (sizes[p] + sizes[q])
            if keep.any():
                yield p[keep], q[keep]

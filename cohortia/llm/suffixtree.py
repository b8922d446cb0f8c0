"""Suffix trees of integer sequences with constant-time longest common extensions, a batch of queries at a time."""

from __future__ import annotations

import numpy as np

#: Places of a range-minimum block; a query looks at no more places than this one by one.
BLOCK = 16


class RangeMinimum:
    """Minima of ranges of ``x``: blocks with a sparse table over their minima, prefixes and suffixes inside."""

    def __init__(self, x: np.ndarray):
        n = -(-len(x) // BLOCK)
        padded = np.full(n * BLOCK, np.iinfo(x.dtype).max, x.dtype)
        padded[: len(x)] = x
        rows = padded.reshape(n, BLOCK)
        self.x = padded
        self.prefix = np.minimum.accumulate(rows, axis=1).reshape(-1)
        self.suffix = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.levels = [rows.min(axis=1)]
        while (step := 1 << (len(self.levels) - 1)) * 2 <= n:
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima of x[lo..hi], both ends included."""
        a, b = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.suffix[lo], self.prefix[hi])
        same = np.flatnonzero(a == b)
        if len(same):
            at, end = lo[same], hi[same]
            least = self.x[at]
            for k in range(1, BLOCK):
                least = np.minimum(least, self.x[np.minimum(at + k, end)])
            out[same] = least
        far = np.flatnonzero(b - a > 1)
        if len(far):
            first, many = a[far] + 1, b[far] - a[far] - 1
            level = np.frexp(many.astype(np.float64))[1] - 1
            for k in np.unique(level):
                pick = level == k
                table, f = self.levels[k], first[pick]
                out[far[pick]] = np.minimum(out[far[pick]], np.minimum(table[f], table[f + many[pick] - (1 << k)]))
        return out


def _ukkonen(s: list[int], width: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Ukkonen's construction over ``s``, whose last symbol stands nowhere else; symbols are under ``width``.

    Nodes are numbers, 0 the root. Returns children by node * width + first symbol, and where the label of the edge
    into a node starts and ends in ``s`` (a leaf's end is -1: up to the end).
    """
    child: dict[int, int] = {}
    start, end, link = [0], [0], [0]
    node = edge = length = left = 0
    for i, c in enumerate(s):
        left += 1
        waiting = 0  # the inner node whose suffix link is still to be set
        while left:
            if not length:
                edge = i
            key = node * width + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i)
                end.append(-1)
                link.append(0)
                if waiting:
                    link[waiting] = node
                    waiting = 0
            else:
                begin, stop = start[below], end[below]
                size = (stop if stop >= 0 else i + 1) - begin
                if length >= size:
                    edge += size
                    length -= size
                    node = below
                    continue
                if s[begin + length] == c:
                    length += 1
                    if waiting:
                        link[waiting] = node
                    break
                split = len(start)
                start.append(begin)
                end.append(begin + length)
                link.append(0)
                child[key] = split
                child[split * width + c] = split + 1
                start.append(i)
                end.append(-1)
                link.append(0)
                start[below] = begin + length
                child[split * width + s[begin + length]] = below
                if waiting:
                    link[waiting] = split
                waiting = split
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - left + 1
    return child, start, end


class SuffixTree:
    """The suffix tree of ``s`` (symbols from 1 on) with an end mark 0; ``rank`` is the order of the suffixes, the end mark's first."""

    def __init__(self, s: np.ndarray):
        n = len(s) + 1
        text = [*s.tolist(), 0]
        width = max(text) + 1
        child, start, end = _ukkonen(text, width)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        below = np.fromiter(child.values(), np.int64, len(child))
        del child
        order = np.argsort(keys)
        below, parent = below[order], keys[order] // width
        bounds = np.searchsorted(parent, np.arange(len(start) + 1)).tolist()
        below = below.tolist()
        # Euler tour of string depths: the smallest one between two leaves is that of their lowest common ancestor
        depth = [0] * len(start)
        tour: list[int] = []
        self.leaf = np.zeros(n, np.int64)  # where the tour meets the leaf of a suffix
        by_rank: list[int] = []
        stack = [0]
        while stack:
            v = stack.pop()
            if v < 0:
                tour.append(depth[~v])
                continue
            d = depth[v]
            lo, hi = bounds[v], bounds[v + 1]
            if lo == hi:
                by_rank.append(n - d)
                self.leaf[n - d] = len(tour)
            tour.append(d)
            for k in range(hi - 1, lo - 1, -1):
                w = below[k]
                depth[w] = d + (end[w] if end[w] >= 0 else n) - start[w]
                stack += (~v, w)
        self.rank = np.empty(n, np.int64)
        self.rank[by_rank] = np.arange(n)
        self.least = RangeMinimum(np.array(tour, np.int32))

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places i != j the length of the longest common prefix of the suffixes from there."""
        a, b = self.leaf[i], self.leaf[j]
        return self.least(np.minimum(a, b), np.maximum(a, b)).astype(np.int64)

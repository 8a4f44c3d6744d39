"""Brandes' accumulation for a batch of sources at once, over a graph that one task can hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs of source and vertex whose state is held at once, and edges that are walked at once.
PAIRS, SLICE = 1 << 20, 1 << 20


def _rows(at: np.ndarray, to: np.ndarray, m: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Edges by their end ``at``: where each vertex's begin, their other ends, their numbers of parallel edges."""
    order = np.argsort(at, kind="stable")
    begin = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(at, minlength=n), out=begin[1:])
    return begin, to[order], None if (m == 1).all() else m[order]


class Near:
    """Edges (src, dst, m), each pair once. ``score`` has the betweenness of ``ids`` from all sources so far.

    State is kept for pairs b * n + v of the batch's source b and vertex v. Of a level's edges those that leave it are
    walked, or those that come into what may be the next level, whichever are fewer.
    """

    def __init__(self, src: np.ndarray, dst: np.ndarray, m: np.ndarray):
        self.ids = np.union1d(np.unique(src), np.unique(dst))
        self.n = len(self.ids)
        a, b = (np.searchsorted(self.ids, x).astype(np.int32) for x in (src, dst))
        self.out, self.into = _rows(a, b, m, self.n), _rows(b, a, m, self.n)
        self.batch = max(1, PAIRS // max(1, self.n))
        self.score = np.zeros(self.n)
        size = self.batch * self.n
        self.level, self.slot = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        self.sigma, self.told, self.got = np.zeros(size), np.zeros(size), np.zeros(size)

    def add(self, sources: np.ndarray, times: np.ndarray) -> None:
        """Sources (ids), each to be counted so many times; those without edges add nothing."""
        if not self.n:
            return
        at = np.minimum(np.searchsorted(self.ids, sources), self.n - 1)
        known = self.ids[at] == sources
        at, times = at[known], times[known].astype(np.float64)
        for i in range(0, len(at), self.batch):
            levels = self._forward(at[i : i + self.batch])
            self._backward(levels, times[i : i + self.batch])
            for keys in levels:
                self.level[keys], self.sigma[keys], self.told[keys] = -1, 0, 0

    def _many(self, rows: tuple, keys: np.ndarray) -> int:
        v = keys % self.n
        return int((rows[0][v + 1] - rows[0][v]).sum())

    def _walk(self, rows: tuple, keys: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray | float]]:
        """A slice of keys, and of its edges the key's place in the slice, the pair at the other end, and m."""
        begin, to, m = rows
        v = keys % self.n
        first, base = begin[v], keys - v
        many = begin[v + 1] - first
        upto = np.cumsum(many)
        lo = 0
        while lo < len(keys):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SLICE, "right")))
            s = slice(lo, hi)
            of = np.repeat(np.arange(hi - lo), many[s])
            where = (first[s] - (upto[s] - many[s]) + (upto[lo] - many[lo]))[of] + np.arange(len(of))
            yield s, of, to[where] + base[s][of], 1.0 if m is None else m[where]
            lo = hi

    def _forward(self, at: np.ndarray) -> list[np.ndarray]:
        """The pairs of each level; sets level and sigma, the number of shortest paths."""
        level, sigma, size = self.level, self.sigma, len(at) * self.n
        keys = np.arange(len(at)) * self.n + at
        level[keys], sigma[keys] = 0, 1
        levels, unseen = [], len(at) * len(self.into[1])
        while len(keys):
            levels.append(keys)
            unseen -= self._many(self.into, keys)
            k, new = len(levels), []
            if unseen + size // 4 < self._many(self.out, keys):
                todo = np.flatnonzero(level[:size] < 0)
                for s, of, t, m in self._walk(self.into, todo):
                    got = np.bincount(of, np.where(level[t] == k - 1, sigma[t], 0.0) * m, s.stop - s.start)
                    hit = np.flatnonzero(got)
                    new.append(todo[s][hit])
                    sigma[new[-1]] = got[hit]
                for x in new:
                    level[x] = k
            else:
                for s, of, t, m in self._walk(self.out, keys):
                    there = level[t]
                    open_ = (there < 0) | (there == k)
                    np.add.at(sigma, t[open_], (sigma[keys[s]][of] * m)[open_])
                    t = t[there < 0]
                    n_th = np.arange(len(t), dtype=np.int32)
                    self.slot[t] = n_th
                    new.append(t[self.slot[t] == n_th])
                    level[new[-1]] = k
            keys = np.concatenate(new) if new else keys[:0]
        return levels

    def _backward(self, levels: list[np.ndarray], times: np.ndarray) -> None:
        """Adds to the score; told is (1 + delta) / sigma in the level below, and 0 elsewhere. Sources don't count."""
        level, sigma, told = self.level, self.sigma, self.told
        told[levels[-1]] = 1 / sigma[levels[-1]]
        for k in range(len(levels) - 2, 0, -1):
            keys, below = levels[k], levels[k + 1]
            if self._many(self.into, below) < self._many(self.out, keys):
                for s, of, t, m in self._walk(self.into, below):
                    here = level[t] == k
                    np.add.at(self.got, t[here], (told[below[s]][of] * m)[here])
                got = self.got[keys]
                self.got[keys] = 0
            else:
                got = np.empty(len(keys))
                for s, of, t, m in self._walk(self.out, keys):
                    got[s] = np.bincount(of, told[t] * m, s.stop - s.start)
            delta = sigma[keys] * got
            told[below] = 0
            told[keys] = (1 + delta) / sigma[keys]
            np.add.at(self.score, keys % self.n, delta * times[keys // self.n])

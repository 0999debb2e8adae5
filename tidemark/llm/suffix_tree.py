"""Suffix trees of integer sequences with constant-time longest common extensions."""

from __future__ import annotations

import numpy as np

#: Steps of an Euler tour that share one entry of the sparse table.
BLOCK = 16


class Minima:
    """Least value of any stretch of an array in constant time: whole blocks by a sparse table, ends by running minima in a block."""

    def __init__(self, values: np.ndarray):
        n = -(-len(values) // BLOCK)
        grid = np.full(n * BLOCK, np.iinfo(values.dtype).max, values.dtype)
        grid[: len(values)] = values
        grid = grid.reshape(n, BLOCK)
        self.grid = grid
        self.from_left = np.minimum.accumulate(grid, axis=1).ravel()
        self.to_right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [grid.min(axis=1)]
        while 2 ** len(self.levels) <= n:
            below, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(below[:-half], below[half:]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """min(values[a..b]), both included, a <= b."""
        first, last = a // BLOCK, b // BLOCK
        out = np.minimum(self.to_right[a], self.from_left[b])
        same = np.flatnonzero(first == last)
        if len(same):
            place = np.arange(BLOCK)
            inside = (place >= (a[same] % BLOCK)[:, None]) & (place <= (b[same] % BLOCK)[:, None])
            out[same] = np.where(inside, self.grid[first[same]], np.iinfo(out.dtype).max).min(axis=1)
        width = last - first - 1
        wide = np.flatnonzero(width > 0)
        if len(wide):
            level = np.frexp(width[wide])[1] - 1
            for k in np.unique(level):
                at = wide[level == k]
                row = self.levels[k]
                out[at] = np.minimum(out[at], np.minimum(row[first[at] + 1], row[last[at] - (1 << int(k))]))
        return out


class SuffixTree:
    """The suffix tree of a list of numbers (1 and up), built by Ukkonen's algorithm; a 0 is put at its end.

    Time and memory grow with the length of the list (about 1 kB a number while it is built).
    """

    def __init__(self, sequence: list[int]):
        self.text = [*sequence, 0]
        self.n = len(self.text)
        self._build()
        self._tour()

    def _build(self) -> None:
        text, n = self.text, self.n
        base = max(text) + 1
        # per node: first and last (excluded) place of the edge above it, the suffix that ends in it (leaves), its suffix link
        first, last, suffix, link = [0], [0], [-1], [0]
        child: dict[int, int] = {}
        node = edge = size = waiting = 0
        for i, c in enumerate(text):
            waiting += 1
            split = -1
            while waiting:
                if not size:
                    edge = i
                key = node * base + text[edge]
                below = child.get(key, -1)
                if below < 0:
                    child[key] = len(first)
                    first.append(i)
                    last.append(n)
                    suffix.append(i - waiting + 1)
                    link.append(0)
                    if split >= 0:
                        link[split] = node
                        split = -1
                else:
                    start, length = first[below], min(last[below], i + 1) - first[below]
                    if size >= length:
                        node, edge, size = below, edge + length, size - length
                        continue
                    if text[start + size] == c:
                        size += 1
                        if split >= 0:
                            link[split] = node
                        break
                    middle = len(first)
                    child[key] = middle
                    child[middle * base + text[start + size]] = below
                    child[middle * base + c] = middle + 1
                    first += [start, i]
                    last += [start + size, n]
                    suffix += [-1, i - waiting + 1]
                    link += [0, 0]
                    first[below] = start + size
                    if split >= 0:
                        link[split] = middle
                    split = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif size:
                    size -= 1
                    edge = i - waiting + 1
        self.suffix = suffix
        self.length = (np.array(last) - np.array(first)).tolist()
        # children in order of (node, number): a node's lie side by side
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        self.children = np.fromiter(child.values(), np.int64, len(child))[order].tolist()
        self.begin = np.searchsorted(keys[order], np.arange(len(first) + 1) * base).tolist()

    def _tour(self) -> None:
        """The Euler tour: depth (in numbers) of each node met, where each suffix' leaf stands, and suffixes in rising order."""
        begin, children, length, suffix = self.begin, self.children, self.length, self.suffix
        tour, place, ordered = [0], [0] * self.n, []
        stack = [(0, begin[0], 0)]
        while stack:
            node, at, depth = stack.pop()
            if at > begin[node]:
                tour.append(depth)
            if at < begin[node + 1]:
                stack.append((node, at + 1, depth))
                below = children[at]
                deeper = depth + length[below]
                if suffix[below] >= 0:
                    place[suffix[below]] = len(tour)
                    ordered.append(suffix[below])
                    tour.append(deeper)
                else:
                    tour.append(deeper)
                    stack.append((below, begin[below], deeper))
        self.place, self.minima = np.array(place), Minima(np.array(tour))
        self.rank = np.empty(self.n, np.int64)
        self.rank[ordered] = np.arange(self.n)

    def rank_turned(self) -> np.ndarray:
        """Rank of each suffix where numbers count from large to small, but the end still comes first."""
        begin, children, suffix = self.begin, self.children, self.suffix
        ordered, stack = [], [0]
        while stack:
            node = stack.pop()
            if suffix[node] >= 0:
                ordered.append(suffix[node])
                continue
            below = children[begin[node] : begin[node + 1]]
            ends = self.text[suffix[below[0]] + self._depth_to(below[0])] == 0 if suffix[below[0]] >= 0 else False
            # the stack gives the last one first
            stack += [*below[1:], below[0]] if ends else below
        rank = np.empty(self.n, np.int64)
        rank[ordered] = np.arange(self.n)
        return rank

    def _depth_to(self, leaf: int) -> int:
        return self.n - self.suffix[leaf] - self.length[leaf]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and b (a != b): the depth of their lowest common ancestor."""
        x, y = self.place[a], self.place[b]
        return self.minima.between(np.minimum(x, y), np.maximum(x, y))

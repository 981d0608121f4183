"""A run-length index of a text of integer symbols: the runs of its Burrows-Wheeler transform with samples at run ends.

For suffixes sorted side by side, the length of the common prefix with the neighbour drops by at most one from one text
place to the next, and is known everywhere from its values at the ends of the transform's runs.  So the samples, two a
run, give the matching statistics of the text against its own other places in one streaming pass.
"""

from __future__ import annotations

import numpy as np


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and each one's rank (equal keys alike)."""
    order = np.argsort(keys)
    held = keys[order]
    new = np.zeros(len(keys), np.int64)
    new[1:] = held[1:] != held[:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def sort_suffixes(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffix array by doubling, and per step (length, ranks of the substrings of that length).  The last symbol must be unique."""
    n = len(text)
    _, rank = _dense(text)
    levels = [(1, rank.astype(np.int32))]
    length = 1
    while True:
        following = np.zeros(n, np.int64)
        following[: max(0, n - length)] = rank[length:] + 1
        order, rank = _dense(rank * (n + 1) + following)
        length *= 2
        if rank[order[-1]] == n - 1 or length >= n:
            return order, levels
        levels.append((length, rank.astype(np.int32)))


class RunIndex:
    """first, last: text places of the suffixes at the heads and ends of the runs; heads: the run's symbol."""

    def __init__(self, text: np.ndarray):
        order, self._levels = sort_suffixes(text)
        n = len(text)
        bwt = text[order - 1]
        change = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        begins, ends = np.concatenate(([0], change)), np.concatenate((change, [n])) - 1
        self.size, self.symbols, self.lengths = n, bwt[begins], ends - begins + 1
        self.first, self.last = order[begins], order[ends]
        none = np.zeros(1, np.int64)
        self.above = np.concatenate((none, self._common(order[begins[1:]], order[begins[1:] - 1])))
        self.below = np.concatenate((self._common(order[ends[:-1]], order[ends[:-1] + 1]), none))
        del self._levels

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes a and b."""
        n = self.size
        held = np.zeros(len(a), np.int64)
        for length, rank in reversed(self._levels):
            x, y = a + held, b + held
            inside = (x + length <= n) & (y + length <= n)
            same = inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
            held += length * same
        return held

    def statistics(self) -> np.ndarray:
        """For each place the length of the longest match that starts there and at another place too."""
        return np.maximum(self._stream(self.first, self.above), self._stream(self.last, self.below))

    def _stream(self, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        known = np.zeros(self.size, np.int64)
        sampled = np.zeros(self.size, np.int64)
        known[places] = values
        sampled[places] = places
        at = np.maximum.accumulate(sampled)
        return np.maximum(0, known[at] - (np.arange(self.size) - at))

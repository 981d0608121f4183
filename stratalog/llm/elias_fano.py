"""Elias-Fano sequences and a two-level trie of n-grams made of them, as compact bytes that can be memory-mapped."""

from __future__ import annotations

import numpy as np

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(axis=1).astype(np.int64)
# The place of the k-th one in a byte.
_SELECT = np.full((256, 8), 8, np.int64)
for _byte in range(256):
    _at = np.flatnonzero(_BITS[_byte])
    _SELECT[_byte, : len(_at)] = _at


class EliasFano:
    """A non-decreasing sequence below `bound`: low bits side by side, high bits in unary, a count of ones for each byte block."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = _ONES[high]
        self._ones = np.cumsum(ones)  # up to and with each byte
        self._zeros = 8 * np.arange(1, len(high) + 1) - self._ones

    @staticmethod
    def pack(values: np.ndarray) -> tuple[np.ndarray, bytes]:
        """(n, low_bits, bytes of low, bytes of high) and the bytes."""
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (max(1, top) // max(1, n)).bit_length() - 1)
        places = (values >> low_bits) + np.arange(n)
        high = np.zeros((int(places[-1]) + 9) // 8 * 8 if n else 8, np.uint8)
        high[places] = 1
        bits = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel()
        low = np.concatenate((np.packbits(bits, bitorder="little"), np.zeros(8, np.uint8)))
        packed = np.packbits(high, bitorder="little")
        return np.array([n, low_bits, len(low), len(packed)], "<i8"), low.tobytes() + packed.tobytes()

    @classmethod
    def read(cls, data: np.ndarray, at: int) -> tuple[EliasFano, int]:
        n, low_bits, low, high = data[at : at + 32].view("<i8").tolist()
        at += 32
        return cls(n, low_bits, data[at : at + low], data[at + low : at + low + high]), at + low + high

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        bit = i * self.low_bits
        byte = bit >> 3
        if self.low_bits <= 57:  # all within the 8 bytes from the first one on, of which the padding has enough
            out = np.ndarray(len(self.low) - 7, "<u8", self.low, strides=(1,))[byte]
        else:
            out = np.zeros(len(i), np.uint64)
            for k in range(8):
                out |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        return ((out >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        byte = np.searchsorted(self._ones, i, side="right")
        own = self.high[byte]
        place = 8 * byte + _SELECT[own, i - (self._ones[byte] - _ONES[own])]
        return ((place - i) << self.low_bits) | self._lows(i)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have a lower high part: the ones before its zero."""
        zero = np.maximum(high - 1, 0)
        byte = np.minimum(np.searchsorted(self._zeros, zero, side="right"), len(self.high) - 1)
        own = self.high[byte]
        rest = np.clip(zero - (self._zeros[byte] - (8 - _ONES[own])), 0, 7)
        place = 8 * byte + _SELECT[~own & 0xFF, rest]
        at = np.where(high > 0, np.minimum(place + 1 - high, self.n), 0)
        at[(high > 0) & (zero >= self._zeros[-1])] = self.n
        return at

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Places of the first values that are not below x (n if there is none): by halving among those with x's high part."""
        want = x >> self.low_bits
        at, end = self._below(want), self._below(want + 1)
        live = np.flatnonzero(at < end)
        low, start, stop = (x & ((1 << self.low_bits) - 1))[live], at[live], end[live]
        while len(live):
            middle = (start + stop) >> 1
            less = self._lows(middle) < low
            start, stop = np.where(less, middle + 1, start), np.where(less, stop, middle)
            done = start >= stop
            if done.any():
                at[live[done]] = start[done]
                left = ~done
                live, low, start, stop = live[left], low[left], start[left], stop[left]
        return at


class Trie:
    """Bigrams with a quantised value: contexts, pointers to their successors, and the successors.

    The successors of a context are held relative to the last value of the context before it, so the whole level is one
    rising sequence; a successor w of context u is looked for as that base plus w, within u's range.
    """

    def __init__(self, data: np.ndarray):
        self.contexts, at = EliasFano.read(data, 0)
        self.pointers, at = EliasFano.read(data, at)
        self.successors, at = EliasFano.read(data, at)
        self.least, self.step = data[at : at + 16].view("<f8").tolist()
        self.codes = data[at + 16 : at + 16 + self.successors.n]

    @staticmethod
    def pack(u: np.ndarray, w: np.ndarray, values: np.ndarray) -> bytes:
        """From bigrams sorted by (u, w) and their values."""
        begin = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1]))) if len(u) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate((begin, [len(u)])))
        tops = w[begin + sizes - 1] + 1  # one more than the last, so that ranges never touch
        bases = np.cumsum(tops) - tops
        least, most = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
        step = (most - least) / 255 or 1.0
        codes = np.rint((values - least) / step).astype(np.uint8)
        parts = [EliasFano.pack(x) for x in (u[begin], np.concatenate((begin, [len(u)])), np.repeat(bases, sizes) + w)]
        # Sequences start at multiples of 8.
        out = b"".join(head.tobytes() + body for head, body in parts)
        return out + np.array([least, step], "<f8").tobytes() + codes.tobytes()

    def find(self, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which bigrams are held, and the values of those."""
        found = np.zeros(len(u), bool)
        if not self.successors.n or not len(u):
            return found, np.zeros(0)
        at = self.contexts.successor(u)
        live = np.flatnonzero(at < self.contexts.n)
        live = live[self.contexts.access(at[live]) == u[live]]
        at = at[live]
        low, high = self.pointers.access(at), self.pointers.access(at + 1)
        base = np.zeros(len(live), np.int64)
        later = low > 0
        base[later] = self.successors.access(low[later] - 1) + 1
        want = base + w[live]
        place = self.successors.successor(want)
        inside = np.flatnonzero(place < high)
        inside = inside[self.successors.access(place[inside]) == want[inside]]
        found[live[inside]] = True
        return found, self.least + self.step * self.codes[place[inside]]

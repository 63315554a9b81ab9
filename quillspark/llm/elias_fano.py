"""Elias-Fano sequences in numpy: rising numbers in about 2 + log2(range / count) bits each.

Low bits are packed at a fixed width; high bits stand in unary in a bit vector, with a
directory of the ones before every eighth word. Access selects a one; search selects the
two zeros that bound a high part and goes on by the low bits. All work on arrays.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
GROUP = 8  # words for one directory entry


ONES, HIGHS = U(0x0101010101010101), U(0x8080808080808080)
#: Position of the r-th set bit of a byte.
IN_BYTE = np.array([[([i for i in range(8) if x >> i & 1] + [8] * 8)[r] for r in range(8)] for x in range(256)], np.uint8).ravel()


def select_in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the r-th (from 0) set bit: sums over bytes by one product, then a table for the byte."""
    r = r.astype(np.uint64)
    s = word - (word >> U(1) & U(0x5555555555555555))
    s = (s & U(0x3333333333333333)) + (s >> U(2) & U(0x3333333333333333))
    s = (s + (s >> U(4)) & U(0x0F0F0F0F0F0F0F0F)) * ONES  # byte i: ones in bytes 0 .. i
    at = np.bitwise_count(((r * ONES | HIGHS) - s) & HIGHS).astype(np.uint64) << U(3)
    rest = r - (s << U(8) >> at & U(255))
    return (at + IN_BYTE[((word >> at & U(255)) << U(3) | rest).astype(np.int64)]).astype(np.int64)


class EliasFano:
    """``values`` must not fall; ``arrays`` / ``of`` give and take what a file stores."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        n = len(values)
        self.n = n
        self.base = values[0] if n else U(0)
        values = values - self.base
        top = int(values[-1]) if n else 0
        self.low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        high = (values >> U(self.low_bits)).astype(np.int64)
        ones = high + np.arange(n)
        words = np.zeros(((int(ones[-1]) if n else 0) // 64 // GROUP + 2) * GROUP, np.uint64)
        at = ones >> 6
        heads = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if n else np.empty(0, np.int64)
        if n:
            words[at[heads]] = np.bitwise_or.reduceat(U(1) << (ones & 63).astype(np.uint64), heads)
        self.words = words
        self.low = self._pack(values)
        self._directory()

    def _pack(self, values: np.ndarray) -> np.ndarray:
        b, n = self.low_bits, self.n
        if not b or not n:
            return np.zeros(16, np.uint8)
        v = values & U((1 << b) - 1)
        at = np.arange(n, dtype=np.uint64) * U(b)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        out = np.zeros(int(word[-1]) + 3, np.uint64)
        heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out[word[heads]] = np.bitwise_or.reduceat(v << shift, heads)
        over = (v >> U(1)) >> (U(63) - shift)
        cross = np.flatnonzero(shift + U(b) > U(64))
        out[word[cross] + 1] |= over[cross]
        return out.view(np.uint8)

    def _directory(self) -> None:
        per = np.bitwise_count(self.words).reshape(-1, GROUP).sum(axis=1, dtype=np.int64)
        self.ones_before = np.concatenate(([0], np.cumsum(per)))
        self.zeros_before = np.arange(len(self.ones_before)) * (64 * GROUP) - self.ones_before

    def arrays(self) -> dict[str, np.ndarray]:
        return {"head": np.array([self.n, self.base, self.low_bits], np.uint64), "words": self.words, "low": self.low}

    @staticmethod
    def of(arrays: dict[str, np.ndarray]) -> "EliasFano":
        out = EliasFano.__new__(EliasFano)
        out.n, out.base, out.low_bits = int(arrays["head"][0]), arrays["head"][1], int(arrays["head"][2])
        out.words, out.low = arrays["words"], arrays["low"]
        out._directory()
        return out

    def _select(self, r: np.ndarray, before: np.ndarray, flip: np.uint64) -> np.ndarray:
        group = np.searchsorted(before, r, side="right") - 1
        rest = r - before[group]
        word = group * GROUP
        for _ in range(GROUP - 1):
            n = np.bitwise_count(self.words[word] ^ flip).astype(np.int64)
            go = rest >= n
            rest = rest - np.where(go, n, 0)
            word = word + go
            if not go.any():
                break
        return word * 64 + select_in_word(self.words[word] ^ flip, rest)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        b = self.low_bits
        if not b:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * U(b)
        words = self.low.view("<u8")
        word, shift = (bit >> U(6)).astype(np.int64), bit & U(63)
        got = words[word] >> shift | words[word + 1] << U(1) << (U(63) - shift)
        return got & U((1 << b) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        ones = self._select(i, self.ones_before, U(0))
        return ((ones - i).astype(np.uint64) << U(self.low_bits) | self._lows(i)) + self.base

    def _next_zero(self, at: np.ndarray) -> np.ndarray:
        """Position of the first zero after each of ``at``."""
        at = at + 1
        word = at >> 6
        left = ~self.words[word] >> (at & 63).astype(np.uint64)
        out = at + np.bitwise_count(~left & left - U(1))
        again = np.flatnonzero(left == 0)
        while len(again):
            word[again] += 1
            left = ~self.words[word[again]]
            out[again] = word[again] * 64 + np.bitwise_count(~left & left - U(1))
            again = again[left == 0]
        return out

    def _search(self, values: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First index not below each value, where its share of equal high parts ends, and its low part."""
        v = np.where(values > self.base, values - self.base, U(0))
        part = (v >> U(self.low_bits)).astype(np.int64)
        inside = part < int(self.zeros_before[-1]) - 1
        h = np.where(inside, part, 0)
        zero = np.where(h > 0, self._select(np.maximum(h - 1, 0), self.zeros_before, ~U(0)), -1)
        start, stop = zero - h + 1, self._next_zero(zero) - h
        if low is not None:
            start, stop = np.maximum(start, low), np.minimum(stop, high)
        start, stop = np.minimum(np.where(inside, start, self.n), self.n), np.minimum(np.where(inside, stop, self.n), self.n)
        end, wanted = stop, v & U((1 << self.low_bits) - 1)
        stop = stop.copy()
        at = np.flatnonzero(start < stop)
        while len(at):
            middle = (start[at] + stop[at]) >> 1
            below = self._lows(middle) < wanted[at]
            start[at] = np.where(below, middle + 1, start[at])
            stop[at] = np.where(below, stop[at], middle)
            at = at[start[at] < stop[at]]
        return start, end, wanted

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of the first element not below each value (``n`` if none)."""
        return self._search(values)[0]

    def locate(self, values: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """Index of an element equal to each value, within ``low`` to ``high`` where given; -1 where there is none."""
        at, end, wanted = self._search(values, low, high)
        out = np.full(len(values), -1, np.int64)
        i = np.flatnonzero((at < end) & (values >= self.base))
        same = i[self._lows(at[i]) == wanted[i]]
        out[same] = at[same]
        return out

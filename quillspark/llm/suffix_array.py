"""Suffix arrays by difference covers, in numpy.

Positions that are 1 or 2 modulo 3 are sampled, sorted by their triples and named; if
names repeat, the order comes from the suffix array of the names. The other suffixes are
sorted by their first letter and the rank that follows, and both lists are merged by
counting, for each unsampled suffix, the sampled ones before it.
"""

from __future__ import annotations

import numpy as np


def _argsort(key: np.ndarray, most: int) -> np.ndarray:
    """Stable order of non-negative keys up to ``most``: packed with the index where both fit."""
    n = len(key)
    room = max(1, n - 1).bit_length()
    if most.bit_length() + room <= 64:
        packed = key.astype(np.uint64) << np.uint64(room) | np.arange(n, dtype=np.uint64)
        packed.sort()
        return (packed & np.uint64((1 << room) - 1)).astype(np.int64)
    return np.argsort(key, kind="stable")


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``x`` (non-negative numbers) in lexicographic order."""
    n = len(x)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: x[i:].tolist()), np.int64)
    padded = np.zeros(n + 4, np.uint64)
    padded[:n] = x
    padded[:n] += np.uint64(1)
    most = int(padded.max()) + 1
    bits = most.bit_length()
    ends = n + (n % 3 == 1)  # an empty suffix closes the sample where its parts would touch
    sample = np.concatenate((np.arange(1, ends, 3), np.arange(2, ends, 3)))
    if 3 * bits <= 64:
        key = padded[sample] << np.uint64(2 * bits) | padded[sample + 1] << np.uint64(bits) | padded[sample + 2]
        order = _argsort(key, 1 << 3 * bits)
        key = key[order]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
    else:
        last = _argsort(padded[sample + 2], most)
        if 2 * bits > 64:
            last = last[np.argsort(padded[sample[last] + 1], kind="stable")]
            last = last[np.argsort(padded[sample[last]], kind="stable")]
            order = last
        else:
            pair = padded[sample] << np.uint64(bits) | padded[sample + 1]
            order = last[np.argsort(pair[last], kind="stable")]
        a, b, c = padded[sample[order]], padded[sample[order] + 1], padded[sample[order] + 2]
        fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])))
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(fresh) - 1
    if not fresh.all():
        order = suffix_array(names)
    sampled = sample[order]
    rank = np.zeros(n + 4, np.uint64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    sampled = sampled[sampled < n]
    step = np.uint64(len(sample) + 2)
    rest = np.arange(0, n, 3)
    one = lambda i: padded[i] * step + rank[i + 1]
    rest = rest[_argsort(one(rest), most * int(step))]
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(one(ones), one(rest))
    if 2 * bits + int(step).bit_length() <= 64:
        two = lambda i: (padded[i] << np.uint64(bits) | padded[i + 1]) * step + rank[i + 2]
        before += np.searchsorted(two(twos), two(rest))
    else:  # the two letters and the rank do not fit one number: rank the first pair of both lists together
        first = lambda i: padded[i] * np.uint64(most + 1) + padded[i + 1]
        values = np.unique(np.concatenate((first(twos), first(rest))))
        two = lambda i: np.searchsorted(values, first(i)).astype(np.uint64) * step + rank[i + 2]
        before += np.searchsorted(two(twos), two(rest))
    out = np.empty(n, np.int64)
    place = np.arange(len(rest)) + before
    free = np.ones(n, bool)
    free[place] = False
    out[place] = rest
    out[free] = sampled
    return out


def same_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes from ``a[i]`` and from ``b[i]`` are equal; all lie within ``data``."""
    out = np.ones(len(a), bool)
    if length < 8:
        for i in range(length):
            out &= data[a + i] == data[b + i]
        return out
    words = np.lib.stride_tricks.as_strided(data, (max(0, len(data) - 7), 8), (1, 1))
    live = np.arange(len(a))
    for at in [*range(0, length - 7, 8), length - 8]:
        equal = (words[a[live] + at] == words[b[live] + at]).all(axis=1)
        out[live[~equal]] = False
        live = live[equal]
    return out


def repeat_classes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A number for each of ``starts``, equal where the ``length`` bytes from there are equal."""
    order = suffix_array(data)
    wanted = np.full(len(data), -1, np.int64)
    wanted[starts] = np.arange(len(starts))
    order = wanted[order]
    order = order[order >= 0]
    at = starts[order]
    fresh = np.concatenate(([True], ~same_prefix(data, at[:-1], at[1:], length))) if len(at) else np.empty(0, bool)
    out = np.empty(len(starts), np.int64)
    out[order] = np.cumsum(fresh)
    return out

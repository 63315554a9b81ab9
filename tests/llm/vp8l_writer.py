"""A slow writer that uses every feature of the format, to test the decoder with."""

import struct

import numpy as np

from quillspark.llm import webp


class Out:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, v, k):
        self.value |= int(v) << self.n
        self.n += k

    def bytes(self):
        return self.value.to_bytes((self.n + 7) // 8, "little")


def prefix_of(v):
    """(prefix, extra bits, value of them) of a length or distance."""
    v -= 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, top - 1, v & ((1 << (top - 1)) - 1)


def put_code(out, counts):
    used = np.flatnonzero(counts).tolist() or [0]
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 2 and max(used) < 256:
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        wide = used[0] > 1
        out.put(wide, 1)
        out.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            out.put(used[1], 8)
            lengths[used] = 1
        return lengths, webp.code_words(lengths)
    if len(used) == 1:
        counts = counts.copy()
        counts[0] += 1
    lengths = webp.code_lengths(counts)
    out.put(*webp.write_code(lengths))
    return lengths, webp.code_words(lengths)


def put_image(out, argb, width, main, cache_bits=0, block=0, search=True):
    """``argb`` flat; back-references where ``search``; one group of codes a block if ``block``."""
    out.put(bool(cache_bits), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    height = len(argb) // width
    across = -(-width >> block) if block else 1
    if main:
        out.put(bool(block), 1)
        if block:
            out.put(block - 2, 3)
            n = across * -(-height >> block)
            put_image(out, (np.arange(n) % 3 << 8).astype(np.uint32), across, False)
    n_groups = (min(3, across * -(-height >> block)) if block else 1)
    symbols, at, cache, seen = [], 0, {}, {}
    pixels = argb.tolist()
    near = {max(1, x + y * width): i + 1 for i, (x, y) in reversed(list(enumerate(webp.NEAR)))}
    key = lambda p: (p * webp.CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)
    while at < len(pixels):
        y, x = divmod(at, width)
        group = ((y >> block) * across + (x >> block)) % 3 if block else 0
        best = 0
        if search and tuple(pixels[at : at + 3]) in seen:
            back = at - seen[tuple(pixels[at : at + 3])]
            while at + best < len(pixels) and best < 4096 and pixels[at + best] == pixels[at + best - back]:
                best += 1
        if best >= 3:
            a = prefix_of(best)
            d = prefix_of(near.get(back, back + 120))
            symbols.append((group, [(0, 256 + a[0]), (None, a[1:]), (4, d[0]), (None, d[1:])]))
        elif cache_bits and cache.get(key(pixels[at])) == pixels[at]:
            best = 1
            symbols.append((group, [(0, 280 + key(pixels[at]))]))
        else:
            best, p = 1, pixels[at]
            symbols.append((group, [(0, p >> 8 & 255), (1, p >> 16 & 255), (2, p & 255), (3, p >> 24)]))
        for i in range(at, at + best):
            if cache_bits:
                cache[key(pixels[i])] = pixels[i]
            if i >= 2:
                seen[tuple(pixels[i - 2 : i + 1])] = i - 2
        at += best
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[np.zeros(n, np.int64) for n in sizes] for _ in range(n_groups)]
    for g, parts in symbols:
        for c, s in parts:
            if c is not None:
                counts[g][c][s] += 1
    codes = [[put_code(out, c) for c in group] for group in counts]
    for g, parts in symbols:
        for c, s in parts:
            if c is None:
                out.put(s[1], s[0])
            else:
                lengths, names = codes[g][c]
                out.put(names[s], int(lengths[s]))


def forward_predictor(argb, modes, block):
    height, width = argb.shape
    x = webp.channels(argb)
    out = x.copy()
    for y in range(height):
        for i in range(width):
            if y == 0 and i == 0:
                p = np.array([0, 0, 0, 255])
            elif y == 0:
                p = x[0, i - 1]
            elif i == 0:
                p = x[y - 1, 0]
            else:
                right = x[y - 1, i + 1] if i + 1 < width else x[y, 0]
                p = webp.predict(int(modes[y >> block, i >> block]), x[y, i - 1], x[y - 1, i], right, x[y - 1, i - 1])
            out[y, i] = x[y, i] - p
    return webp.words(out)


def forward_cross(argb, factors, block):
    x = webp.channels(argb)
    f = webp.channels(factors)
    height, width = argb.shape
    s = lambda v: (int(v) & 255 ^ 128) - 128
    for y in range(height):
        for i in range(width):
            b, g, r = (int(v) for v in x[y, i, :3])
            e = f[y >> block, i >> block]
            x[y, i, 0] = b - (s(e[1]) * s(g) >> 5) - (s(e[2]) * s(r) >> 5)
            x[y, i, 2] = r - (s(e[0]) * s(g) >> 5)
    return webp.words(x)


def write(argb, kinds=(), cache_bits=0, block=0, search=True, seed=0):
    """A WebP file of (height, width) words with the transforms ``kinds`` in this order."""
    r = np.random.default_rng(seed)
    height, width = argb.shape
    out = Out()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    for kind in kinds:
        out.put(1, 1)
        out.put(kind, 2)
        height, width = argb.shape
        shape = (-(-height >> 2), -(-width >> 2))
        if kind == 0:
            out.put(0, 3)
            modes = r.integers(0, 14, shape).astype(np.uint32)
            put_image(out, (modes << 8).ravel(), shape[1], False)
            argb = forward_predictor(argb, modes, 2)
        elif kind == 1:
            out.put(0, 3)
            factors = r.integers(0, 1 << 24, shape).astype(np.uint32)
            put_image(out, factors.ravel(), shape[1], False)
            argb = forward_cross(argb, factors, 2)
        elif kind == 2:
            x = webp.channels(argb)
            x[..., 0] -= x[..., 1]
            x[..., 2] -= x[..., 1]
            argb = webp.words(x)
        else:
            table, index = np.unique(argb, return_inverse=True)
            index = index.reshape(argb.shape)
            n = len(table)
            out.put(n - 1, 8)
            x = webp.channels(table)
            x[1:] -= x[:-1].copy()
            put_image(out, webp.words(x), n, False)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            packed = np.zeros((height, -(-width >> pack)), np.uint32)
            for i in range(width):
                packed[:, i >> pack] |= (index[:, i] << (i % (1 << pack)) * (8 >> pack)).astype(np.uint32)
            argb = packed << 8 | np.uint32(0xFF000000)
    out.put(0, 1)
    put_image(out, np.ascontiguousarray(argb).ravel(), argb.shape[1], True, cache_bits, block, search)
    data = out.bytes()
    padded = data + b"\0" * (len(data) & 1)
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(padded), b"WEBP", b"VP8L", len(data)) + padded

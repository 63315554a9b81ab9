"""Lossless WebP (VP8L): a full decoder and a fast writer, and media columns made with them.

The decoder reads prefix codes (simple and normal, with meta prefix images),
back-references and the colour cache, and inverts the predictor, cross-colour,
subtract-green and palette transforms, as the public format specification has them. Where
one group of codes covers the image, it looks up, for many bit positions at once, the
pixel that would start there and where it would end, follows the chain of literal pixels
through composed jumps, and handles back-references and cache hits one by one.

The writer stores literal pixels under prefix codes fitted to each image. A text's bytes,
padded with blanks to rows of 64 RGB pixels, are its image; payloads over 16384 rows
become several images, one file after the other.

Defined cases: a null or empty text is one row of blanks; equal texts give equal media and
features; null and repeated ids each give a row; an empty table gives no rows; other
columns are ignored; a damaged stream raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import storage

# Fixed values of the format: order of code-length codes, and the near distances as (x, y).
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
OPAQUE = 0xFF000000


@lru_cache(maxsize=32)
def reversed_bits(n: int) -> np.ndarray:
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate((out * 2, out * 2 + 1))
    return out


class PrefixCode:
    """Canonical code; ``symbol`` and ``size`` are indexed by the next ``bits`` bits, first bit lowest."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) == 1:
            self.bits, self.symbol, self.size = 0, used.astype(np.int64), np.zeros(1, np.int64)
            return
        order = used[np.argsort(lengths[used], kind="stable")]
        sizes = lengths[order].astype(np.int64)
        self.bits = int(sizes[-1]) if len(used) else 0
        spread = 1 << (self.bits - sizes)
        if not len(used) or int(spread.sum()) != 1 << self.bits:
            raise ValueError("prefix code is not complete")
        turn = reversed_bits(self.bits)
        self.symbol, self.size = np.repeat(order, spread)[turn], np.repeat(sizes, spread)[turn]

    @staticmethod
    def single(symbol: int) -> "PrefixCode":
        code = PrefixCode.__new__(PrefixCode)
        code.bits, code.symbol, code.size = 0, np.array([symbol]), np.zeros(1, np.int64)
        return code


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(16), 0, 8 * len(data)

    def read(self, n: int) -> int:
        byte = self.at >> 3
        value = int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise ValueError("stream ends early")
        return value

    def symbol(self, code: PrefixCode) -> int:
        if not code.bits:
            return int(code.symbol[0])
        byte = self.at >> 3
        key = int.from_bytes(self.data[byte : byte + 4], "little") >> (self.at & 7) & ((1 << code.bits) - 1)
        self.at += int(code.size[key])
        if self.at > self.end:
            raise ValueError("stream ends early")
        return int(code.symbol[key])


def read_code(bits: Bits, alphabet: int) -> PrefixCode:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        if not two:
            return PrefixCode.single(first)
        lengths = np.zeros(max(alphabet, 256), np.uint8)
        lengths[[first, bits.read(8)]] = 1
        return PrefixCode(lengths)
    inner = np.zeros(19, np.uint8)
    for i in range(4 + bits.read(4)):
        inner[CODE_LENGTH_ORDER[i]] = bits.read(3)
    code = PrefixCode(inner)
    tokens = alphabet
    if bits.read(1):
        tokens = 2 + bits.read(2 + 2 * bits.read(3))
    lengths: list[int] = []
    previous = 8
    while len(lengths) < alphabet and tokens:
        tokens -= 1
        s = bits.symbol(code)
        if s < 16:
            lengths.append(s)
            previous = s or previous
        elif s == 16:
            lengths += [previous] * (3 + bits.read(2))
        else:
            lengths += [0] * (3 + bits.read(3) if s == 17 else 11 + bits.read(7))
    if len(lengths) > alphabet:
        raise ValueError("too many code lengths")
    return PrefixCode(np.array(lengths, np.uint8))


def extended(bits: Bits, prefix: int) -> int:
    """Value of a length or distance prefix and its extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


class LiteralRuns:
    """Where pixels end that start at any bit of a window of the stream."""

    WINDOW = 1 << 16

    def __init__(self, bits: Bits, codes: list[PrefixCode]):
        self.bits, self.codes, self.first = bits, codes, None

    def _load(self, at: int) -> None:
        data = np.frombuffer(self.bits.data, np.uint8)
        byte = at >> 3
        span = min(self.WINDOW >> 3, len(data) - 8 - byte)
        words = np.lib.stride_tricks.as_strided(data[byte:], (span, 8), (1, 1)).copy().view("<u8")
        w = (words >> np.arange(8, dtype=np.uint64)).ravel()
        self.first, n = byte << 3, len(w)
        argb, used, special = np.zeros(n, np.uint32), np.zeros(n, np.int64), None
        for code, shift in zip(self.codes, (8, 16, 0, 24), strict=True):
            if not code.bits:
                symbol = np.full(1, code.symbol[0])
            else:
                key = (w & np.uint64((1 << code.bits) - 1)).astype(np.int64)
                symbol, size = code.symbol[key], code.size[key]
                used += size
                w = w >> size.astype(np.uint64)
            if special is None:
                special = symbol > 255
            argb |= ((symbol & 255) << shift).astype(np.uint32)
        index = np.arange(n)
        jump = index + used
        jump[np.broadcast_to(special, n) | (jump >= n - 64)] = -1
        jump = np.where(jump < 0, index, jump)  # stays: not a literal, or out of sight
        self.argb, self.used, self.special, self.jump = argb, used, np.broadcast_to(special, n), jump
        self.far = jump
        for _ in range(4):
            self.far = self.far[self.far]

    def take(self, most: int) -> np.ndarray:
        """Literal pixels from the current position on, up to ``most`` or to the next other symbol."""
        out = []
        while most:
            at = self.bits.at
            if self.first is None or not self.first <= at < self.first + len(self.jump) - 128:
                self._load(at)
            p = at - self.first
            if self.special[p]:
                break
            if self.jump[p] == p:  # at the window's edge, or codes without bits
                if self.used[p]:
                    if self.first + p + 64 >= self.first + len(self.jump) and self.first + len(self.jump) < self.bits.end:
                        self._load(at)
                        continue
                    out.append(self.argb[p : p + 1])
                    self.bits.at += int(self.used[p])
                    most -= 1
                    continue
                out.append(np.full(most, self.argb[p], np.uint32))
                break
            marks, far = [p], self.far
            while len(marks) * 16 < most:
                q = int(far[marks[-1]])
                if q == marks[-1]:
                    break
                marks.append(q)
            steps = np.empty((16, len(marks)), np.int64)
            steps[0] = marks
            for i in range(1, 16):
                steps[i] = self.jump[steps[i - 1]]
            chain = steps.T.ravel()
            moves = self.jump[chain] != chain
            n = min(most, int(moves.argmin()) if not moves.all() else len(chain))
            chain = chain[:n]
            out.append(self.argb[chain])
            self.bits.at = self.first + int(self.jump[chain[-1]])
            most -= n
        if self.bits.at > self.bits.end:
            raise ValueError("stream ends early")
        return np.concatenate(out) if out else np.empty(0, np.uint32)


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB words, row by row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    cache = np.zeros(1 << cache_bits, np.uint32)
    group_of, n_groups, block = None, 1, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        group_of = read_pixels(bits, across, -(-height >> block), False) >> 8 & 0xFFFF
        n_groups = int(group_of.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[read_code(bits, n) for n in sizes] for _ in range(n_groups)]
    total = width * height
    out = np.zeros(total, np.uint32)
    at = stored = 0

    def store(upto: int) -> None:
        nonlocal stored
        if cache_bits and stored < upto:
            seen = out[stored:upto]
            cache[(seen * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)] = seen
            stored = upto

    fast = LiteralRuns(bits, groups[0][:4]) if group_of is None and sum(c.bits for c in groups[0][:4]) <= 56 else None
    while at < total:
        if fast:
            run = fast.take(total - at)
            out[at : at + len(run)] = run
            at += len(run)
            if at == total:
                break
            green, red, blue, alpha, distance = groups[0]
        else:
            y, x = divmod(at, width)
            green, red, blue, alpha, distance = groups[int(group_of[(y >> block) * across + (x >> block)]) if group_of is not None else 0]
        s = bits.symbol(green)
        if s < 256:
            r, b = bits.symbol(red), bits.symbol(blue)
            out[at] = bits.symbol(alpha) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            n = extended(bits, s - 256)
            far = extended(bits, bits.symbol(distance))
            if far <= 120:
                dx, dy = NEAR[far - 1]
                far = max(1, dx + dy * width)
            else:
                far -= 120
            if far > at or at + n > total:
                raise ValueError("back-reference out of the image")
            while n:  # the source may overlap what is being written
                step = min(n, far)
                out[at : at + step] = out[at - far : at - far + step]
                at, n = at + step, n - step
        else:
            store(at)
            if s - 280 >= len(cache):
                raise ValueError("no such cache entry")
            out[at] = cache[s - 280]
            at += 1
    return out


def channels(argb: np.ndarray) -> np.ndarray:
    """(..., 4) signed numbers in the order blue, green, red, alpha."""
    return np.ascontiguousarray(argb).view(np.uint8).reshape(*argb.shape, 4).astype(np.int32)


def words(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((x & 255).astype(np.uint8)).view("<u4")[..., 0]


def predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Prediction of a pixel from left, top, top-right and top-left, per channel."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return (((left + right) >> 1) + top) >> 1
    if mode == 6:
        return (left + corner) >> 1
    if mode == 7:
        return (left + top) >> 1
    if mode == 8:
        return (corner + top) >> 1
    if mode == 9:
        return (top + right) >> 1
    if mode == 10:
        return (((left + corner) >> 1) + ((top + right) >> 1)) >> 1
    if mode == 11:
        return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = (left + top) >> 1
        twice = mean - corner
        return np.clip(mean + (twice + (twice < 0)) // 2, 0, 255)
    return np.array([0, 0, 0, 255], np.int32)


ROW_MODES = (0, 2, 3, 4, 8, 9)


def invert_predictor(argb: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    """Undo the predictor; runs of modes that do not look left are done at once."""
    height, width = argb.shape
    out = channels(argb)
    out[0, 0, 3] += 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[0] = (row[0] + above[0]) & 255
        x = 1
        while x < width:
            mode = int(modes[y >> block, x >> block])
            stop = min(width, (x >> block) + 1 << block)
            if mode in ROW_MODES or mode > 13:
                # The pixel right above and beyond the last column is this row's first.
                beyond = np.concatenate((above, row[:1]))
                row[x:stop] = (row[x:stop] + predict(mode, above[x:stop], above[x:stop], beyond[x + 1 : stop + 1], above[x - 1 : stop - 1])) & 255
            elif mode == 1:
                row[x:stop] = (row[x - 1] + np.cumsum(row[x:stop], axis=0)) & 255
            else:
                for i in range(x, stop):
                    right = above[i + 1] if i + 1 < width else row[0]
                    row[i] = (row[i] + predict(mode, row[i - 1], above[i], right, above[i - 1])) & 255
            x = stop
    return words(out)


def signed(x: np.ndarray) -> np.ndarray:
    return (x & 255 ^ 128) - 128


def invert_cross_colour(argb: np.ndarray, factors: np.ndarray, block: int) -> np.ndarray:
    height, width = argb.shape
    f = channels(np.repeat(np.repeat(factors, 1 << block, axis=0)[:height], 1 << block, axis=1)[:, :width])
    out = channels(argb)
    green = signed(out[..., 1])
    out[..., 2] = (out[..., 2] + (signed(f[..., 0]) * green >> 5)) & 255
    out[..., 0] += (signed(f[..., 1]) * green >> 5) + (signed(f[..., 2]) * signed(out[..., 2]) >> 5)
    return words(out)


def invert_palette(argb: np.ndarray, table: np.ndarray, width: int, pack: int) -> np.ndarray:
    index = (argb >> 8 & 255).astype(np.int64)
    if pack:
        each = 8 >> pack
        index = np.repeat(index, 1 << pack, axis=1)[:, :width] >> (np.arange(width) % (1 << pack)) * each & (1 << each) - 1
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index]


def decode_stream(data: bytes) -> np.ndarray:
    """(height, width) ARGB words of a VP8L stream; ``ValueError`` if it is damaged."""
    try:
        return _decoded(data)
    except (IndexError, OverflowError, struct.error) as e:
        raise ValueError("a damaged stream") from e


def _decoded(data: bytes) -> np.ndarray:
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    inverse, seen, coded = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (0, 1):
            block = bits.read(3) + 2
            shape = (-(-height >> block), -(-coded >> block))
            part = read_pixels(bits, shape[1], shape[0], False).reshape(shape)
            if kind == 0:
                inverse.append(lambda p, m=part >> 8 & 255, b=block: invert_predictor(p, m, b))
            else:
                inverse.append(lambda p, f=part, b=block: invert_cross_colour(p, f, b))
        elif kind == 2:
            def add_green(p: np.ndarray) -> np.ndarray:
                x = channels(p)
                x[..., 0] += x[..., 1]
                x[..., 2] += x[..., 1]
                return words(x)

            inverse.append(add_green)
        else:
            n = bits.read(8) + 1
            table = words(np.cumsum(channels(read_pixels(bits, n, 1, False)), axis=0))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            inverse.append(lambda p, t=table, w=coded, k=pack: invert_palette(p, t, w, k))
            coded = -(-coded >> pack)
    pixels = read_pixels(bits, coded, height, True).reshape(height, coded)
    for step in reversed(inverse):
        pixels = step(pixels)
    return pixels


def files(data: bytes) -> Iterator[bytes]:
    """The VP8L streams of one or more WebP files that follow each other."""
    at = 0
    while at < len(data):
        if len(data) - at < 20:
            raise ValueError("no lossless WebP file")
        riff, size, form, kind, length = struct.unpack_from("<4sI4s4sI", data, at)
        if riff != b"RIFF" or form != b"WEBP" or kind != b"VP8L" or at + 20 + length > len(data):
            raise ValueError("no lossless WebP file")
        yield data[at + 20 : at + 20 + length]
        at += 8 + size


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) pixels of a lossless WebP file, as red, green, blue, alpha."""
    stream = next(files(data), None)
    if stream is None:
        raise ValueError("an empty file")
    pixels = decode_stream(stream)
    return pixels.view(np.uint8).reshape(*pixels.shape, 4)[..., [2, 1, 0, 3]]


def code_lengths(counts: np.ndarray, most: int = 12) -> np.ndarray:
    """Lengths of a prefix code for ``counts``, none over ``most``."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    weights = counts[used]
    while True:
        heap = [(int(c), i, None) for i, c in enumerate(weights.tolist())]
        heapq.heapify(heap)
        n = len(heap)
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heapq.heapreplace(heap, (a[0] + heap[0][0], n, (a, heap[0])))
            n += 1
        stack, deepest = [(heap[0], 0)], 0
        while stack:
            (_, i, kids), depth = stack.pop()
            if kids is None:
                lengths[used[i]] = max(1, depth)
                deepest = max(deepest, depth)
            else:
                stack += [(kids[0], depth + 1), (kids[1], depth + 1)]
        if deepest <= most:
            return lengths
        weights = np.maximum(weights, weights.sum() >> most - 2)


def code_words(lengths: np.ndarray) -> np.ndarray:
    """Canonical code words, first bit lowest."""
    out, word, last = np.zeros(len(lengths), np.uint64), 0, 0
    used = np.flatnonzero(lengths)
    for s in used[np.argsort(lengths[used], kind="stable")].tolist():
        n = int(lengths[s])
        word <<= n - last
        out[s] = int(f"{word:0{n}b}"[::-1], 2)
        word, last = word + 1, n
    return out


def write_code(lengths: np.ndarray) -> tuple[int, int]:
    """Bits (as a number, and how many) that declare a code of three symbols or more."""
    # Sixteen code-length symbols of four bits each: 0 to 12, and the three repeats.
    rank = {s: int(f"{i:04b}"[::-1], 2) for i, s in enumerate([*range(13), 16, 17, 18])}
    value, n = 0, 0

    def put(v: int, k: int) -> None:
        nonlocal value, n
        value |= v << n
        n += k

    put(0, 1)
    put(12, 4)
    for _ in range(16):
        put(4, 3)
    put(0, 1)
    at = 0
    for s in [*np.flatnonzero(lengths).tolist(), len(lengths)]:
        gap = s - at
        while gap >= 3:
            run = min(gap, 138)
            if run >= 11:
                put(rank[18], 4)
                put(run - 11, 7)
            else:
                put(rank[17], 4)
                put(run - 3, 3)
            gap -= run
        for _ in range(gap):
            put(rank[0], 4)
        if s < len(lengths):
            put(rank[int(lengths[s])], 4)
        at = s + 1
    return value, n


def encode_rgb(rgb: np.ndarray) -> bytes:
    """A lossless WebP file of (height, width, 3) bytes: literal pixels, codes fitted to them."""
    height, width, _ = rgb.shape
    head, n = 0x2F | (width - 1) << 8 | (height - 1) << 22, 40
    n += 3  # no transform, no colour cache, one group of codes
    samples = rgb.reshape(-1, 3)
    value, total = np.zeros(len(samples), np.uint64), np.zeros(len(samples), np.uint64)
    simple = lambda symbols: 1 | (len(symbols) - 1) << 1 | 1 << 2 | sum(s << 3 + 8 * i for i, s in enumerate(symbols))
    for channel, alphabet in ((1, 280), (0, 256), (2, 256)):
        column = samples[:, channel]
        counts = np.bincount(column, minlength=alphabet)
        used = np.flatnonzero(counts).tolist()
        if len(used) <= 2:
            head |= simple(used) << n
            n += 3 + 8 * len(used)
            if len(used) == 2:
                value |= (column == used[1]).astype(np.uint64) << total
                total += np.uint64(1)
            continue
        lengths = code_lengths(counts)
        declared, k = write_code(lengths)
        head |= declared << n
        n += k
        value |= code_words(lengths)[column] << total
        total += lengths[column].astype(np.uint64)
    head |= simple([255]) << n
    n += 11
    head |= simple([0]) << n
    n += 11
    at = np.cumsum(total) - total + np.uint64(n)
    end = int(at[-1] + total[-1])
    out = np.zeros((end >> 6) + 2, "<u8")
    first = head.to_bytes((n + 63) // 64 * 8, "little")
    out[: len(first) // 8] = np.frombuffer(first, "<u8")
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out[word[starts]] |= np.bitwise_or.reduceat(value << shift, starts)
    over = (value >> np.uint64(1)) >> (np.uint64(63) - shift)
    cross = np.flatnonzero(over)
    out[word[cross] + 1] |= over[cross]
    data = out.tobytes()[: (end + 7) // 8]
    padded = data + b"\0" * (len(data) & 1)
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(padded), b"WEBP", b"VP8L", len(data)) + padded


ROW, MOST_ROWS = 192, 16384


def text_media(text: bytes) -> bytes:
    payload = text + b" " * (-len(text) % ROW or (ROW if not text else 0))
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    return b"".join(encode_rgb(rows[i : i + MOST_ROWS]) for i in range(0, len(rows), MOST_ROWS))


def media_pixels(media: bytes) -> np.ndarray:
    """(rows, 64, 3) pixels of a text's media."""
    parts = [decode_stream(f) for f in files(media)]
    argb = np.concatenate(parts) if len(parts) > 1 else parts[0]
    return argb.view(np.uint8).reshape(*argb.shape, 4)[..., 2::-1]


def feature_of(pixels: np.ndarray) -> str:
    """Rows, mean of each channel, and which columns are brighter than the whole."""
    columns = pixels.sum(axis=(0, 2), dtype=np.int64)
    bright = np.packbits(columns * len(columns) > columns.sum()).tobytes().hex()
    means = pixels.reshape(-1, 3).mean(axis=0)
    return f"{len(pixels)}x{pixels.shape[1]};{means[0]:.3f},{means[1]:.3f},{means[2]:.3f};{bright}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Store each text as lossless WebP, read it back, and describe both.

    With ``with_media`` the file and the pixels read back from it are columns too.
    """
    schema = SCHEMA + ", media binary, pixels binary" * with_media
    target = to_arrow_schema(StructType.fromDDL(schema))

    def row(text: bytes) -> tuple:
        media = text_media(text)
        pixels = media_pixels(media)
        payload = pixels.tobytes()
        out = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(pixels))
        return out + (media, payload) if with_media else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                made: dict[bytes, tuple] = {}
                rows = []
                for text in storage.texts_of(batch.column(1).slice(at, 512)):
                    if text not in made:
                        made[text] = row(text)
                    rows.append(made[text])
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(target)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), *columns], target.names)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(storage.tidy(run), schema)

"""Removal of every byte covered by a ``length``-byte string that also starts earlier.

Strings repeat only where an anchor repeats: of each window of ``length`` bytes, the
``gram``-byte piece with the least hash (the last of equals) is the anchor, so equal
windows have equal anchors at equal places, and about one position in 35 is one. The
windows that share an anchor form a context of at most ``2 * length - gram`` bytes.

1. Every task finds the anchors of its texts and hashes of anchor and context. Of equal
   contexts in a task only the first goes on; the windows of the others start earlier
   elsewhere and are marked. The exchange is dealt by anchor hash.
2. Equal contexts are settled the same way between tasks. Where an anchor has several
   different contexts (the borders of a repeat), the first document of each fetches its
   bytes, and the contexts go to the task of their anchor. There a difference-cover suffix
   array puts the suffixes in order, adjacent prefixes of ``length`` bytes are compared,
   and all windows of a class but the first are marked. An anchor with more than
   ``many`` contexts would make one task hot: its windows go out singly under their own
   hash, first reduced to one a task, and equal ones meet wherever that hash leads.
3. Marked windows meet their texts, and the union of what they cover is cut.

The suffix order is thus taken over contexts that share an anchor, not over all suffixes:
ordering every suffix of the input costs several times the input in each of many
exchanges, while windows with a unique anchor cannot repeat. Contexts are told apart by 64-bit hashes
within one 64-bit anchor hash; suffix classes are compared byte by byte.

Defined cases: a null text counts as empty; null ids come before all others; rows of one
id count in the order of a hash of their text, and an exact repeat of a row is the same
document and gives the same row; an empty table gives no rows. ``cut_texts`` passes other
columns through and drops a character that a cut leaves incomplete.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage
from .suffix_array import repeat_classes

GRAM, MANY = 32, 400
NO_ID = -(1 << 63)
CHUNK = 1 << 18  # bytes hashed at once
FLUSH = 120_000  # records sorted at once
LOT = 120_000  # records settled at once, about
SORTED = 1 << 19  # bytes in one suffix array, about
U = np.uint64
BASES = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))


def inverse(odd: int) -> int:
    return pow(int(odd), -1, 1 << 64)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)


@lru_cache(maxsize=4)
def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2**64."""
    base = BASES[which]
    return tuple(np.multiply.accumulate(np.concatenate(([U(1)], np.full(n, b, np.uint64)))) for b in (base, U(inverse(base))))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(31)) * U(0xBF58476D1CE4E5B9)
    return x ^ x >> U(29)


class Rolling:
    """Hashes of any piece of a run of bytes."""

    def __init__(self, data: np.ndarray, which: int):
        size = 1 << max(16, len(data).bit_length())
        self.up, self.down = powers(which, size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters()[data] * self.up[: len(data)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[starts + lengths] - self.sums[starts]) * self.down[starts])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def least_ahead(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n, have, step = len(v) - width + 1, v, 1
    while 2 * step <= width:
        have = np.minimum(have[:-step], have[step:])
        step *= 2
    return np.minimum(have[:n], have[width - step :][:n])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of documents laid end to end (``bounds``: where each begins, and the end).

    Gives document number, position in ``data``, bytes from the first window to the anchor,
    windows besides the first, hash of the anchor, hash of the context.
    """
    if len(data) < length:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),) * 2
    first = Rolling(data, 0)
    grams = first.every(gram)
    place = U(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64)
    least = least_ahead(grams & U(0xFFFFFFFF00000000) | place, length - gram + 1)
    at = (U(0xFFFFFFFF) - (least & U(0xFFFFFFFF))).astype(np.int64)
    inside = np.ones(len(at), bool)
    for end in bounds[1:-1].tolist():
        inside[max(0, end - length + 1) : end] = False
    fresh = inside.copy()
    fresh[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    begin = np.flatnonzero(fresh)
    last = inside.copy()
    last[:-1] &= (at[1:] != at[:-1]) | ~inside[1:]
    span = np.flatnonzero(last) - begin
    position = at[begin]
    document = np.searchsorted(bounds, begin, side="right") - 1
    context = Rolling(data, 1).hash(begin, span + length) ^ mixed((position - begin + (span << 20)).astype(np.uint64) + U(77))
    # Least hashes lie near 0; mixed once more they are even again, so that parts are.
    return document, position, position - begin, span, mixed(grams[position] + U(99)), context


def pack(*columns: np.ndarray) -> bytes:
    return pa.compress(np.array([len(columns[0])], "<u8").tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns), codec="zstd", asbytes=True)


def unpack(blob: bytes, size: int, kinds: tuple[str, ...]) -> list[np.ndarray]:
    raw = pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True)
    n, at, out = int(np.frombuffer(raw[:8], "<u8")[0]), 8, []
    for kind in kinds:
        width = np.dtype(kind).itemsize * n
        out.append(np.frombuffer(raw[at : at + width], kind))
        at += width
    return [*out, np.frombuffer(raw[at:], np.uint8)]


WHO = ("<i8", "<i4", "<i8")  # id, text hash, position
PLACE = (*WHO, "<u1", "<u1")  # and bytes before, windows besides
NAMED = ("<u8", "<u8", *PLACE)
EXCHANGE = "part int, kind int, size long, blob binary"


def packed_rows(rows: list[tuple[int, int, list[np.ndarray]]]) -> pa.RecordBatch:
    sizes = [8 + sum(c.nbytes for c in columns) for _, _, columns in rows]
    blobs = [pack(*columns) for *_, columns in rows]
    return pa.RecordBatch.from_arrays([pa.array([p for p, *_ in rows], pa.int32()), pa.array([k for _, k, _ in rows], pa.int32()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["part", "kind", "size", "blob"])


def dealt(hashes: np.ndarray, n: int) -> np.ndarray:
    """Part 0 .. n - 1 of each hash, rising with it."""
    return ((hashes >> U(32)) * U(n) >> U(32)).astype(np.int64)


def spread(columns: list[np.ndarray], kind: int, n: int, turn: int) -> list[tuple[int, int, list[np.ndarray]]]:
    """Records that need no company, in even lots."""
    total = len(columns[0])
    lot = max(1, -(-total // n), min(total, 1000))
    return [((turn + i) % n, kind, [c[a : a + lot] for c in columns]) for i, a in enumerate(range(0, total, lot))]


def by_part(columns: list[np.ndarray], kind: int, n: int) -> list[tuple[int, int, list[np.ndarray]]]:
    """Records sorted by their first column, a hash, in runs of one part."""
    parts = dealt(columns[0], n)
    edges = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1]))) if len(parts) else np.empty(0, np.int64)
    ends = np.concatenate((edges[1:], [len(parts)]))
    return [(int(parts[a]), kind, [c[a:b] for c in columns]) for a, b in zip(edges.tolist(), ends.tolist(), strict=True)]


def settled(columns: list[np.ndarray], keys: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Records in order of their ``keys`` first columns, then id, text hash and position; and which begin a key.

    Records that agree in all of these (repeated rows) become one.
    """
    order = np.lexsort(tuple(columns[i] for i in range(keys + 2, -1, -1)))
    columns = [c[order] for c in columns]
    same = lambda many: np.logical_and.reduce([c[1:] == c[:-1] for c in columns[:many]])
    once = np.concatenate(([True], ~same(keys + 3))) if len(order) else np.empty(0, bool)
    columns = [c[once] for c in columns]
    return columns, np.concatenate(([True], ~same(keys))) if len(columns[0]) else np.empty(0, bool)


def _who(df: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(text).bitwiseAND(0x7FFFFFFF).cast("int")


def find_anchors(df: DataFrame, id_col: str, text_col: str, length: int, n: int, chunk: int = CHUNK) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = turn = 0

        def flush() -> pa.RecordBatch:
            nonlocal turn
            columns, first = settled([np.concatenate(c) for c in zip(*held, strict=True)], 2)
            again = [c[~first] for c in columns]
            turn += 1
            return packed_rows(by_part([c[first] for c in columns], 1, n) + spread(again[2:], 0, n, turn))

        def take(ids: list[int], hashes: list[int], texts: list[bytes], offset: int = 0) -> None:
            nonlocal count
            bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            document, position, back, span, gram, context = anchors(np.frombuffer(b"".join(texts), np.uint8), bounds, length)
            held.append([gram, context, np.array(ids, np.int64)[document], np.array(hashes, np.int32)[document], position - bounds[document] + offset, back.astype(np.uint8), span.astype(np.uint8)])
            count += len(document)

        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, batch.num_rows, 1024):
                group: list[tuple[int, int, bytes]] = []
                size = 0
                for i, h, text in zip(ids[at:], hashes[at:], storage.texts_of(batch.column(2).slice(at, 1024)), strict=False):
                    if len(text) < length:
                        continue
                    if len(text) > chunk:  # windows of a very long text, some at a time
                        for a in range(0, len(text) - length + 1, chunk):
                            take([i], [h], [text[a : a + chunk + length - 1]], a)
                        continue
                    group.append((i, h, text))
                    size += len(text)
                    if size >= chunk:
                        take(*map(list, zip(*group, strict=True)))
                        group, size = [], 0
                if group:
                    take(*map(list, zip(*group, strict=True)))
                if count >= FLUSH:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    who = _who(df, id_col, text_col)
    return df.select(who[0].alias("id"), who[1].alias("th"), F.col(text_col).cast("string").alias("text")).mapInArrow(storage.tidy(run), EXCHANGE)


MARKS = "id long, th int, position long, back int, span int, kind int, gram long"


def marks(columns: list[np.ndarray], kind: np.ndarray | int, gram: np.ndarray | int = 0) -> pa.RecordBatch:
    n = len(columns[0])
    full = lambda x, dtype: np.broadcast_to(np.asarray(x), n).astype(dtype)
    arrays = [columns[0].astype(np.int64), columns[1].astype(np.int32), columns[2].astype(np.int64), columns[3].astype(np.int32), columns[4].astype(np.int32), full(kind, np.int32), np.ascontiguousarray(np.broadcast_to(np.asarray(gram, np.uint64), n)).view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], [x.split()[0] for x in MARKS.split(", ")])


def settle_contexts(records: DataFrame, many: int = MANY) -> DataFrame:
    """Marks of equal contexts (kind 0), and the contexts to be compared (kind 1; 2 for anchors with many)."""
    def settle(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        columns, first = settled(columns, 2)
        yield marks([c[~first] for c in columns[2:]], 0)
        columns = [c[first] for c in columns]
        new = np.concatenate(([True], columns[0][1:] != columns[0][:-1]))
        starts = np.flatnonzero(new)
        size = np.repeat(counts := np.diff(np.concatenate((starts, [len(new)]))), counts)
        several = size > 1
        yield marks([c[several] for c in columns[2:]], np.where(size[several] > many, 2, 1), columns[0][several])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What waits is held compressed, and settled in ranges of the anchor hash.
        held: list[tuple[int, bytes]] = []
        total, low, high = 0, (1 << 64) - 1, 0
        for batch in batches:
            for kind, size, blob in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if kind == 0:
                    yield marks(unpack(blob, size, PLACE)[:5], 0)
                    continue
                grams = unpack(blob, size, NAMED)[0]
                held.append((size, blob))
                total, low, high = total + len(grams), min(low, int(grams[0])), max(high, int(grams[-1]))
        ranges = max(1, -(-total // LOT))
        edges = [low + (high + 1 - low) * i // ranges for i in range(ranges)]
        for n, first in enumerate(edges if held else []):
            parts = []
            for size, blob in held:
                columns = unpack(blob, size, NAMED)[:7]
                a = int(np.searchsorted(columns[0], U(first)))
                b = int(np.searchsorted(columns[0], U(edges[n + 1]))) if n + 1 < ranges else len(columns[0])
                if a < b:
                    parts.append([c[a:b] for c in columns])
            if parts:
                yield from settle([np.concatenate(c) for c in zip(*parts, strict=True)])

    return records.mapInArrow(storage.tidy(run), MARKS)


def fetch_contexts(texts: DataFrame, length: int, n: int) -> DataFrame:
    """``texts`` (id, th, text, wanted) to packed contexts, or single windows of anchors with many contexts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        windows: list[list[np.ndarray]] = []
        size = count = turn = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            turn += 1
            rows = []
            if held:
                held.sort(key=lambda r: r[0])
                parts = dealt(np.array([r[0] for r in held], np.uint64), n)
                edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(held)]
                for a, b in zip(edges, edges[1:], strict=False):
                    some = held[a:b]
                    columns = [np.array([r[i] for r in some], k) for i, k in enumerate(("<u8", *PLACE))]
                    rows.append((int(parts[a]), 1, [*columns, np.frombuffer(b"".join(r[6] for r in some), np.uint8)]))
            if windows:
                columns, first = settled([np.concatenate(c) for c in zip(*windows, strict=True)], 2)
                rows += by_part([c[first] for c in columns], 2, n) + spread([c[~first] for c in columns[2:]], 0, n, turn)
            if rows:
                yield packed_rows(rows)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, hashes, wanted = (part.column(i).to_pylist() for i in (0, 1, 3))
                for i, h, want, text in zip(ids, hashes, wanted, storage.texts_of(part.column(2)), strict=True):
                    for w in want:
                        begin = w["position"] - w["back"]
                        piece = text[begin : begin + w["span"] + length]
                        if w["kind"] == 1:
                            held.append((w["gram"] & (1 << 64) - 1, i, h, w["position"], w["back"], w["span"], piece))
                            size += len(piece)
                        else:
                            data = np.frombuffer(piece, np.uint8)
                            own = Rolling(data, 1).every(length)
                            m = len(own)
                            windows.append([own, np.full(m, w["gram"] & (1 << 64) - 1, np.uint64), np.full(m, i, np.int64), np.full(m, h, np.int32), begin + np.arange(m), np.zeros(m, np.uint8), np.zeros(m, np.uint8)])
                            count += m
                    if size > 1 << 21 or count > FLUSH:
                        yield from flush()
                        held, windows, size, count = [], [], 0, 0
        yield from flush()

    return texts.mapInArrow(storage.tidy(run), EXCHANGE)


def compare_contexts(records: DataFrame, length: int, most_bytes: int = SORTED) -> DataFrame:
    """Marks of all windows whose bytes start earlier in another context of their anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts: list[list[np.ndarray]] = []
        windows: list[list[np.ndarray]] = []
        for batch in batches:
            for kind, size, blob in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if kind == 0:
                    yield marks(unpack(blob, size, PLACE)[:5], 0)
                elif kind == 1:
                    contexts.append(unpack(blob, size, ("<u8", *PLACE)))
                else:
                    windows.append(unpack(blob, size, NAMED)[:7])
        if windows:
            columns, first = settled([np.concatenate(c) for c in zip(*windows, strict=True)], 2)
            yield marks([c[~first] for c in columns[2:]], 0)
        if not contexts:
            return
        anchor, id_, th, position, back, span, data = (np.concatenate(c) for c in zip(*contexts, strict=True))
        contexts.clear()
        span = span.astype(np.int64)
        sizes = span + length
        begins = np.cumsum(sizes) - sizes
        # Contexts of one anchor hash stay together; a task's share is sorted in lots of bounded size.
        order = np.argsort(anchor, kind="stable")
        closes = np.flatnonzero(np.concatenate((anchor[order][1:] != anchor[order][:-1], [True]))) + 1
        filled = np.cumsum(sizes[order])[closes - 1]
        a = 0
        while a < len(order):
            base = int(filled[np.searchsorted(closes, a, side="right") - 1]) if a else 0
            b = int(closes[max(np.searchsorted(filled, base + most_bytes, side="right") - 1, np.searchsorted(closes, a, side="right"))])
            lot = order[a:b]
            a = b
            width = sizes[lot]
            ends = np.cumsum(width)
            source = np.repeat(begins[lot] - ends + width, width) + np.arange(ends[-1])
            each = span[lot] + 1
            which = np.repeat(np.arange(len(lot)), each)
            inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            classes = repeat_classes(data[source], (ends - width)[which] + inside, length)
            owner = lot[which]
            columns, first = settled([classes, id_[owner], th[owner], position[owner] - back[owner] + inside], 1)
            again = [c[~first] for c in columns[1:]]
            # Neighbouring windows of a document become one mark.
            order2 = np.lexsort((again[2], again[1], again[0]))
            again = [c[order2] for c in again]
            if len(order2):
                joint = (again[0][1:] == again[0][:-1]) & (again[1][1:] == again[1][:-1]) & (again[2][1:] == again[2][:-1] + 1)
                heads = np.flatnonzero(np.concatenate(([True], ~joint)))
                run_length = np.diff(np.concatenate((heads, [len(order2)]))) - 1
                yield marks([again[0][heads], again[1][heads], again[2][heads], np.zeros(len(heads)), run_length], 0)

    return records.mapInArrow(storage.tidy(run), MARKS)


def covered(marked: DataFrame, length: int) -> DataFrame:
    """``(id, th, runs)``: first bytes and lengths of what the marked windows cover, one row a document."""
    run = F.struct((F.col("position") - F.col("back")).alias("a"), (F.col("span") + length).cast("long").alias("n"))
    return marked.groupBy("id", "th").agg(F.collect_list(run).alias("runs"))


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, many: int = MANY, chunk: int = CHUNK) -> DataFrame:
    """``(id, th, runs)`` of the documents that lose bytes."""
    n = storage.shards(df.sparkSession)
    records = find_anchors(df, id_col, text_col, length, n, chunk).repartitionById(n, F.col("part"))
    marked = storage.settle(settle_contexts(records, many), "substring-marks")
    wanted = marked.where("kind > 0").groupBy("id", "th").agg(F.collect_list(F.struct("position", "back", "span", "kind", "gram")).alias("wanted"))
    who = _who(df, id_col, text_col)
    texts = df.select(who[0].alias("id"), who[1].alias("th"), F.col(text_col).cast("string").alias("text")).join(wanted.hint("merge"), ["id", "th"])
    contexts = fetch_contexts(texts.select("id", "th", "text", "wanted"), length, n).repartitionById(n, F.col("part"))
    compared = storage.settle(compare_contexts(contexts, length), "substring-compared")
    return covered(marked.where("kind = 0").unionByName(compared), length)


def cut(text: bytes, runs: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left of a text, how many bytes went, and in how many runs."""
    if not runs:
        return text, 0, 0
    a = np.array([r["a"] for r in runs], np.int64)
    b = a + np.array([r["n"] for r in runs], np.int64)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    heads = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
    begins, ends = a[heads], b[np.concatenate((heads[1:] - 1, [len(b) - 1]))]
    kept = [text[x:y] for x, y in zip([0, *ends.tolist()], [*begins.tolist(), len(text)], strict=True)]
    return b"".join(kept), int((ends - begins).sum()), len(heads)


def _joined(df: DataFrame, id_col: str, text_col: str, length: int, **limits) -> DataFrame:
    gone = removals(df, id_col, text_col, length, **limits).withColumnsRenamed({"id": "__id", "th": "__th", "runs": "__runs"})
    who = _who(df, id_col, text_col)
    return df.withColumns({"__id": who[0], "__th": who[1]}).join(gone.hint("merge"), ["__id", "__th"], "left").drop("__id", "__th")


def substring_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, **limits) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                got: list[list] = [[], [], [], []]
                for text, runs in zip(storage.texts_of(batch.column(1).slice(at, 1024)), batch.column(2).slice(at, 1024).to_pylist(), strict=True):
                    kept, removed, spans = cut(text, runs)
                    for column, v in zip(got, (len(text), removed, spans, hashlib.sha256(kept).hexdigest()), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1024), *(pa.array(c, pa.int64()) for c in got[:3]), pa.array(got[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _joined(slim, "doc_id", "text", length, **limits).select("doc_id", "text", "__runs").mapInArrow(storage.tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """``df`` with its texts cut and all other columns as they were."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(batch.num_columns - 1).to_pylist()
            texts = [cut(t, r)[0].decode("utf-8", "ignore") if r else t.decode("utf-8", "replace") for t, r in zip(storage.texts_of(batch.column(at)), runs, strict=True)]
            known = batch.column(at).is_valid().to_pylist()
            column = pa.array([t if k else None for t, k in zip(texts, known, strict=True)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([column if i == at else batch.column(i) for i in range(batch.num_columns - 1)], batch.schema.names[:-1])

    return _joined(df, id_col, text_col, length).select(*df.columns, "__runs").mapInArrow(storage.tidy(run), df.schema)

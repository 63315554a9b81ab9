"""Sequence packing balanced by attention cost.

A piece of ``n`` tokens costs ``linear * n + quadratic * n * n``. Documents are taken in
descending length; each goes whole to the cheapest sequence that has room for it, and a
document that fits nowhere whole is cut over the cheapest sequences that have any room.
Packing works on blocks of ``block_tokens`` tokens in the order in which a task reads
them, so it needs no exchange, its memory is one block, and a lost task repeats alone.

A block holds as many full sequences as its tokens fill; the fewer than ``length`` tokens
that remain become sequences of the powers of two that sum to them, so nothing is padded.

Defined cases: a null or empty text is a document of the end id alone; null and repeated
document ids each keep their own pieces; ties in length go by document order and ties in
cost by sequence number; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .tokens import tokenizer_path, word_ids

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def assign(lengths: list[int], length: int = 4096, linear: float = 1.0, quadratic: float = 1 / 4096) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, size, sequence, offset)`` of one block of documents."""
    out: list[tuple[int, int, int, int, int]] = []
    taken, at = 0, [0] * len(lengths)
    for i, n in enumerate(lengths):  # what fills a sequence alone has no choice
        while n - at[i] >= length:
            out.append((i, at[i], length, taken, 0))
            at[i] += length
            taken += 1
    rest = np.array([n - a for n, a in zip(lengths, at, strict=True)], np.int64)
    total = int(rest.sum())
    sizes = [length] * (total // length) + [1 << b for b in range(length.bit_length() - 1, -1, -1) if total % length >> b & 1]
    if not sizes:
        return out
    room, cost = np.array(sizes, np.int64), np.zeros(len(sizes))
    size = room.copy()
    never = np.inf

    def put(i: int, n: int, s: int) -> None:
        out.append((i, at[i], n, taken + s, int(size[s] - room[s])))
        at[i] += n
        room[s] -= n
        cost[s] = never if not room[s] else cost[s] + linear * n + quadratic * n * n

    for i in np.argsort(-rest, kind="stable").tolist():
        n = int(rest[i])
        if not n:
            break
        fits = np.where(room >= n, cost, never)
        s = int(fits.argmin())
        if fits[s] < never:
            put(i, n, s)
            continue
        while n:
            s = int(cost.argmin())
            put(i, part := min(n, int(room[s])), s)
            n -= part
    return out


def pack_sequences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2, length: int = 4096, block_tokens: int = 1 << 22, linear: float = 1.0, quadratic: float = 1 / 4096, with_ids: bool = False) -> DataFrame:
    """One row per piece; with ``with_ids`` also its token ids, as an array column ``ids``."""
    path = path or tokenizer_path()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_ids(path), int(end_id).to_bytes(4, "little")
        held: list[tuple[int | None, bytes]] = []
        tokens, used = 0, TaskContext.get().partitionId() << 40

        def pieces() -> pa.RecordBatch:
            nonlocal used
            found = assign([len(b) // 4 for _, b in held], length, linear, quadratic)
            got: list[list] = [[] for _ in range(8)]
            for i, start, n, s, offset in found:
                doc_id, ids = held[i]
                part = ids[4 * start : 4 * (start + n)]
                for column, v in zip(got, (doc_id, start, n, zlib.crc32(part), len(ids) // 4, used + s, offset, part), strict=True):
                    column.append(v)
            used += 1 + max(s for *_, s, _ in found)
            columns = [pa.array(c, pa.int64()) for c in got[:7]]
            if with_ids:
                columns.append(pa.array([np.frombuffer(b, "<i4") for b in got[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids)

        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), encoder.documents(batch.column(1)), strict=True):
                held.append((doc_id, found + end))
                tokens += len(found) // 4 + 1
                if tokens >= block_tokens:
                    yield pieces()
                    held, tokens = [], 0
        if held:
            yield pieces()

    chosen = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(storage.tidy(pack), SCHEMA + ", ids array<int>" * with_ids)

"""Token-id output: files of fixed-width packed ids with block offsets.

Every id takes the fewest bits that hold the vocabulary. Ids are packed, low bits first,
into blocks of ``block_ids`` ids that start on byte borders, so that a reader unpacks any
range with a few numpy operations and without touching other blocks.

File, all little-endian: the blocks; then block offsets u64[n_blocks + 1], document ids
i64[n_docs], a null flag u8[n_docs] each, document ends u64[n_docs] (in ids); last a
trailer of five u64 (bits, block_ids, n_ids, n_docs, n_blocks) and the magic ``QTOKBITS``.

Defined cases: a null text counts as empty (only the end id is stored); null document ids
come first; rows of one id follow each other in byte order of their texts and each keeps
its own ids; an empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .tokens import tokenizer_path, word_ids

MAGIC = b"QTOKBITS"
TRAILER = struct.Struct("<5Q8s")


def width(vocabulary: int) -> int:
    """Fewest bits for ids 0 .. vocabulary - 1."""
    return max(1, (max(1, vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flat = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(flat.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: np.ndarray, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from index ``first`` of a packed run of bytes."""
    if count <= 0:
        return np.empty(0, np.uint32)
    if bits in (8, 16, 32):
        step = bits // 8
        return data[first * step : (first + count) * step].view(f"<u{step}").astype(np.uint32)
    at = (np.arange(first, first + count, dtype=np.uint64)) * np.uint64(bits)
    low, last = int(at[0]) >> 3, (int(at[-1]) + bits + 7) >> 3
    part = np.zeros(last - low + 8, np.uint8)
    part[: last - low] = data[low:last]
    words = np.lib.stride_tricks.as_strided(part.view(np.uint8), (last - low, 8), (1, 1))
    at -= np.uint64(low << 3)
    got = np.ascontiguousarray(words[(at >> np.uint64(3)).astype(np.int64)]).view("<u8").ravel()
    return ((got >> (at & np.uint64(7))) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class TokenFileWriter:
    """Streams documents into one file; memory is one block and the document index."""

    def __init__(self, sink, vocabulary: int, block_ids: int = 1 << 14):
        self.sink, self.bits, self.block_ids = sink, width(vocabulary), block_ids
        self.rest: list[np.ndarray] = []
        self.waiting = self.n_ids = self.at = 0
        self.offsets, self.ids, self.null, self.ends = [0], [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.waiting += len(ids)
        self.n_ids += len(ids)
        self.ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.ends.append(self.n_ids)
        if self.waiting >= 64 * self.block_ids:
            self._flush(False)

    def _flush(self, everything: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.empty(0, np.uint32)
        full = len(ids) if everything else len(ids) - len(ids) % self.block_ids
        for i in range(0, full, self.block_ids):
            self.at += self.sink.write(block := pack(ids[i : min(i + self.block_ids, full)], self.bits)) or len(block)
            self.offsets.append(self.at)
        self.rest, self.waiting = [ids[full:]], len(ids) - full

    def close(self) -> None:
        self._flush(True)
        for values, kind in ((self.offsets, "<u8"), (self.ids, "<i8"), (self.null, "<u1"), (self.ends, "<u8")):
            self.sink.write(np.array(values, kind).tobytes())
        self.sink.write(TRAILER.pack(self.bits, self.block_ids, self.n_ids, len(self.ids), len(self.offsets) - 1, MAGIC))
        self.sink.close()


class TokenFile:
    """Random access to a written file, over a memory map where the store allows one."""

    def __init__(self, data: pa.Buffer | bytes):
        self.data = np.frombuffer(data, np.uint8)
        size = len(self.data)
        self.bits, self.block_ids, self.n_ids, self.n_docs, n_blocks, magic = TRAILER.unpack(self.data[size - TRAILER.size :].tobytes())
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        at = size - TRAILER.size - 8 * (n_blocks + 1) - 17 * self.n_docs
        take = lambda n, kind: np.frombuffer(self.data[at : at + n * np.dtype(kind).itemsize].tobytes(), kind)
        self.offsets = take(n_blocks + 1, "<u8")
        at += 8 * (n_blocks + 1)
        self.doc_ids = take(self.n_docs, "<i8")
        at += 8 * self.n_docs
        self.null = take(self.n_docs, "<u1")
        at += self.n_docs
        self.ends = take(self.n_docs, "<u8")

    def ids(self, first: int, stop: int) -> np.ndarray:
        """Ids ``first`` to ``stop`` of the file, whatever blocks they lie in."""
        out = []
        while first < stop:
            block, inside = divmod(first, self.block_ids)
            n = min(stop - first, self.block_ids - inside)
            out.append(unpack(self.data[int(self.offsets[block]) : int(self.offsets[block + 1])], self.bits, inside, n))
            first += n
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        start = 0
        for doc_id, null, end in zip(self.doc_ids.tolist(), self.null.tolist(), self.ends.tolist(), strict=True):
            yield None if null else doc_id, start, self.ids(start, end)
            start = end


def write_token_files(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int | None = 1, block_ids: int = 1 << 14) -> DataFrame:
    """Encode ``text_col`` and write packed files in ascending order of ``id_col``.

    One range exchange puts the texts in order; each task then writes one file and returns
    one row ``(part, path, n_ids, n_docs)``. A file's name holds the task attempt, so a
    repeated attempt never meets a half-written file, and only files that a row names count.
    """
    path = path or tokenizer_path()
    key, text = F.col(id_col), F.col(text_col)
    ordered = df.select(key.cast("long").alias("id"), text.cast("string").alias("text")).repartitionByRange(F.col("id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, encoder = TaskContext.get(), None, word_ids(path)
        where = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.tok"
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), encoder.documents(batch.column(1)), strict=True):
                out = out or TokenFileWriter(storage.create(where), max(encoder.tokenizer.get_vocab_size(), (end_id or 0) + 1), block_ids)
                out.add(doc_id, np.frombuffer(found + end, "<u4"))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [where], "n_ids": [out.n_ids], "n_docs": [len(out.ids)]})

    return ordered.mapInArrow(storage.tidy(write), "part long, path string, n_ids long, n_docs long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document of the files in ``manifest``: id, start among all ids, count, CRC-32.

    The manifest has one row a file (a bounded number: the tasks of the write), so that its
    running total is taken on the driver.
    """
    spark = manifest.sparkSession
    rows, start = [], 0
    for n, r in enumerate(sorted(manifest.collect(), key=lambda r: r["part"])):
        rows.append((n, r["path"], start))
        start += r["n_ids"]
    files = spark.createDataFrame(rows, "n int, path string, base long").repartitionById(max(1, len(rows)), F.col("n"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                got: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                for doc_id, at, ids in TokenFile(storage.mapped(where)).documents():
                    for k, v in zip(got, (doc_id, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        got[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in got.values()], list(got))

    return files.mapInArrow(storage.tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(df: DataFrame, **options) -> DataFrame:
    """Write ``df``'s texts as packed token files below the shared folder and read them back."""
    folder = storage.scratch(df.sparkSession, "tokens")
    manifest = storage.settle(write_token_files(df, folder, **options), "token-manifest")
    return read_token_files(manifest)

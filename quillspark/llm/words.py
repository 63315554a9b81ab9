"""Arrow string columns as runs of bytes, cut into pieces without a Python object a piece."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def lots(column: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Start and length of runs of rows with about ``most_bytes`` of text each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = int(total[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(total, before + most_bytes, side="right")))
        yield at, stop - at
        at = stop


def laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with a blank after each, and where those blanks are; null counts as empty."""
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    bounds = np.frombuffer(column.buffers()[1], "<i8" if wide else "<i4")[column.offset : column.offset + n + 1].astype(np.int64)
    stops = bounds[1:] - bounds[0] + np.arange(n)
    out = np.full(int(bounds[-1] - bounds[0]) + n, 32, np.uint8)
    if bounds[0] < bounds[-1]:
        inside = np.ones(len(out), bool)
        inside[stops] = False
        out[inside] = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return out, stops


def numbered(packed: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Pieces that lie end to end: the number of each, and the distinct ones in order of appearance."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
    n = len(coded.dictionary)
    if not n:
        return np.empty(0, np.int32), []
    edges = np.frombuffer(coded.dictionary.buffers()[1], np.int32)[: n + 1].tolist()
    raw = coded.dictionary.buffers()[2].to_pybytes()
    return coded.indices.to_numpy(zero_copy_only=False), [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in lower case A-Z: their numbers, how many each text has, the distinct ones."""
    data, stops = laid_out(column)
    if not len(data):
        return np.empty(0, np.int32), np.zeros(len(column), np.int64), []
    full = ~BLANK[data]
    last = np.flatnonzero(full[:-1] & ~full[1:])  # the data end with a blank
    packed = LOWER[data][full]
    ends = np.cumsum(full, dtype=np.int32)[last]
    index, distinct = numbered(packed, ends)
    return index, np.diff(np.searchsorted(last, stops), prepend=0), distinct

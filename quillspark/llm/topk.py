"""Exact top-k inner-product search on a bit-sliced index.

Vectors become integers ``floor(scale * x)``. A block of rows stores, for every attribute,
bit slices of its coarse value (the ``drop`` lowest bits left off). For one query the
slices are added as bitmaps: each non-zero signed digit of a query weight contributes a
shifted slice (its complement, for a negative digit), and carry-save adders fold them into
the slices of all rows' coarse scores at once. Walking those from the most significant
slice down gives the k-th best coarse score; rows that could still beat it, given the
bound on what the dropped bits add, are read out and scored exactly.

Query blocks meet row blocks, never single rows, and each meeting keeps k rows a query.

Defined cases: vectors that are null or hold a null or non-finite component take no part,
nor do rows without id; vectors of another length than the query's are no candidates; all
rows of the query's own id are left out; a repeated row counts as often as it occurs; ties
go to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage


def signed_digits(value: int) -> list[tuple[int, int]]:
    """Non-adjacent form: ``value`` as a sum of sign * 2**place with few terms."""
    out, place = [], 0
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            out.append((place, digit))
            value -= digit
        value >>= 1
        place += 1
    return out


class SlicedBlock:
    """Rows of one dimension: exact values, and slices of their coarse values."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, drop: int = 2):
        self.ids, self.values, self.drop = ids, values, drop
        coarse = values >> drop
        self.low = coarse.min(axis=0)
        coarse = coarse - self.low
        self.bits = max(1, int(coarse.max()).bit_length())
        n, d = values.shape
        words = -(-n // 64)
        self.slices = np.zeros((self.bits * d, words), np.uint64)
        for b in range(self.bits):
            flat = np.zeros((d, words * 8), np.uint8)
            packed = np.packbits((coarse.T >> b & 1).astype(np.uint8), axis=1, bitorder="little")
            flat[:, : packed.shape[1]] = packed
            self.slices[b * d : (b + 1) * d] = flat.view(np.uint64)
        full = np.zeros(words * 8, np.uint8)
        ones = np.packbits(np.ones(n, np.uint8), bitorder="little")
        full[: len(ones)] = ones
        self.valid = full.view(np.uint64)

    def coarse_scores(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least first, of every row's coarse score plus a constant."""
        d = len(query)
        by_weight: dict[int, list[tuple[int, bool]]] = {}
        for j, q in enumerate(query.tolist()):
            for place, sign in signed_digits(q):
                for b in range(self.bits):
                    by_weight.setdefault(place + b, []).append((b * d + j, sign < 0))
        out: list[np.ndarray] = []
        carried: dict[int, list[np.ndarray]] = {}
        w = 0
        while by_weight or carried:
            terms = by_weight.pop(w, [])
            parts = carried.pop(w, [])
            if terms:
                plus = [i for i, negative in terms if not negative]
                minus = [i for i, negative in terms if negative]
                parts += [self.slices[plus]] * bool(plus) + [~self.slices[minus]] * bool(minus)
            x = np.concatenate(parts) if parts else np.zeros((1, self.slices.shape[1]), np.uint64)
            up = carried.setdefault(w + 1, [])
            while len(x) > 2:  # full adders: three bitmaps of this weight become one, and one of the next
                m = len(x) // 3
                a, b, c = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
                both = a ^ b
                up.append((a & b) | (both & c))
                x = np.concatenate((both ^ c, x[3 * m :]))
            if len(x) == 2:
                up.append((x[0] & x[1])[None])
                x = (x[0] ^ x[1])[None]
            if not up:
                del carried[w + 1]
            out.append(x[0])
            w += 1
        return out

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of this block's k best rows for a query."""
        others = self.valid.copy()
        for i in np.flatnonzero(self.ids == query_id).tolist():
            others[i >> 6] &= ~np.uint64(1 << (i & 63))
        slices = self.coarse_scores(query)
        alive, need, kth = others, k, 0
        for w in range(len(slices) - 1, -1, -1):
            hit = alive & slices[w]
            n = int(np.bitwise_count(hit).sum())
            if n >= need:
                alive, kth = hit, kth | 1 << w
            else:
                need -= n
                alive = alive & ~slices[w]
        slack = ((1 << self.drop) - 1) * int(np.abs(query).sum())  # the dropped bits move a score by no more
        least = max(0, kth - (slack >> self.drop) - 1)
        above, level = np.zeros_like(others), others
        for w in range(len(slices) - 1, -1, -1):
            if least >> w & 1:
                level = level & slices[w]
            else:
                above |= level & slices[w]
                level = level & ~slices[w]
        rows = np.flatnonzero(np.unpackbits((above | level).view(np.uint8), bitorder="little"))
        scores = self.values[rows].astype(np.int64) @ query
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[order]], scores[order]


def whole_numbers(batch: pa.RecordBatch, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Dimension -> ids and integer vectors of the rows of a batch that take part."""
    by: dict[int, list] = {}
    for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        if i is not None and v.is_valid and len(v) and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all():
                by.setdefault(len(x), []).append((i, x))
    return {d: (np.array([i for i, _ in r], np.int64), np.floor(scale * np.stack([x for _, x in r])).astype(np.int64)) for d, r in by.items()}


def _blocks(df: DataFrame, scale: float, rows: int, make) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def pour(d: int) -> Iterator[pa.RecordBatch]:
            ids, values = (np.concatenate(x) for x in zip(*held.pop(d), strict=True))
            for at in range(0, len(ids), rows):
                yield pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps(make(ids[at : at + rows], values[at : at + rows]))], pa.binary())})

        for batch in batches:
            for d, found in whole_numbers(batch, scale).items():
                held.setdefault(d, []).append(found)
                if sum(len(x) for x, _ in held[d]) >= rows:
                    yield from pour(d)
        for d in list(held):
            yield from pour(d)

    return df.mapInArrow(storage.tidy(build), "block binary")


def _index(ids: np.ndarray, values: np.ndarray) -> SlicedBlock:
    small = np.int16 if np.abs(values).max(initial=0) < 1 << 15 else np.int32 if np.abs(values).max(initial=0) < 1 << 31 else np.int64
    return SlicedBlock(ids, values.astype(small))


#: Blocks of the index in one task, about.
BLOCKS_HELD = 4


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, block_rows: int | None = None, block_queries: int = 1 << 10) -> DataFrame:
    """For each of ``queries``, the k rows with the highest integer inner product.

    A task holds a few blocks of the index (``block_rows`` rows each; by default as many as
    give every partition a block, 1,024 to 16,384) and all blocks of queries pass by it.
    """
    def pick(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    spark = rows.sparkSession
    shards = storage.shards(spark)
    block_rows = block_rows or min(1 << 14, max(1 << 10, -(-rows.count() // shards)))
    index = storage.settle(_blocks(pick(rows), scale, block_rows, _index), "topk-index")
    asked = storage.settle(_blocks(pick(queries), scale, block_queries, lambda i, v: (i, v)), "topk-queries")
    parts = max(shards, -(-index.count() // BLOCKS_HELD))
    held = index.select(F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), "block")
    passing = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "block")
    met = held.union(passing).repartitionById(parts, F.col("part")).sortWithinPartitions("kind")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[SlicedBlock] = []
        for batch in batches:
            for kind, raw in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if not kind:
                    blocks.append(pickle.loads(raw.as_py()))
                elif blocks:
                    ids, vectors = pickle.loads(raw.as_py())
                    for block in blocks:
                        if vectors.shape[1] == block.values.shape[1]:
                            found = [(i, *block.best(i, v, k)) for i, v in zip(ids.tolist(), vectors, strict=True)]
                            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in ([np.full(len(r), i) for i, r, _ in found], [r for _, r, _ in found], [s for *_, s in found])], ["query_id", "vec_id", "score"])

    near = met.mapInArrow(storage.tidy(meet), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""SimHash near-duplicates, compared on vertically stored bit planes.

Fingerprint: lower-case A-Z, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``n_words`` words
joined by spaces (repeats count; a shorter text is one shingle; no words: fingerprint 0);
a bit is set if over half of the shingles' XXH64 (seed 42) have it.

Links: fingerprints that differ in at most ``radius`` bits. The 64 bits are cut into
``bands``; two linked fingerprints agree on at least ``bands - radius`` of them, so each
distinct fingerprint is dealt to one bucket for every choice of that many bands. More
bands are taken as fingerprints become more numerous, so that buckets stay small; any
number finds every link. A bucket beyond ``piece`` members is compared as pairs of pieces.

Within a task the members of many buckets lie side by side in 64 bit planes. Shifting the
planes by d lanes sets every member against the d-th next one; XOR of the planes feeds
carry-save counters that update all distances at once, and blocks of 64 lanes in which
every distance is over the radius, or no open pair is left, are abandoned. Pairs already
joined are not compared again and only links that join two groups leave the task, so a
group of n near copies gives n - 1 links, not n * n.

Defined cases: a null text counts as empty; all texts without words share fingerprint 0;
null ids take part in links but never name a component (null if a group has no other id);
a repeated row gives a row again; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import storage
from .components import components


def fingerprint(text: bytes, n_words: int = 4, seed: int = 42) -> int:
    words = text.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(n_words)), strict=False)) if len(words) >= n_words else [b" ".join(words)]
    hashes = np.array([xxh64_intdigest(g, seed) for g in grams], "<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * votes > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 4) -> DataFrame:
    """``(doc_id, hash, bits)``: a hash of the text, and the unsigned fingerprint in a signed 64-bit column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                bits = np.array([fingerprint(t, n_words) for t in storage.texts_of(batch.column(1).slice(at, 1024))], "<u8")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1024), batch.column(2).slice(at, 1024), pa.array(bits.view("<i8"))], ["doc_id", "hash", "bits"])

    text = F.col(text_col).cast("string")
    chosen = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    return chosen.mapInArrow(storage.tidy(run), "doc_id long, hash long, bits long")


def band_masks(n: int, radius: int, most_per_bucket: float = 2.0) -> list[int]:
    """Masks of the band choices: the fewest bands that leave few of ``n`` random fingerprints together."""
    for bands in range(radius + 1, 4 * radius + 9):
        edges = [64 * i // bands for i in range(bands + 1)]
        parts = [((1 << b - a) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
        masks = [sum(c) for c in combinations(parts, bands - radius)]
        if n <= most_per_bucket * 2 ** min(m.bit_count() for m in masks) or len(masks) > 500:
            return masks
    return masks


def planes(bits: np.ndarray) -> np.ndarray:
    """(64, words): plane b holds bit b of all fingerprints, 64 lanes a word."""
    words = -(-len(bits) // 64)
    full = np.zeros(words * 64, "<u8")
    full[: len(bits)] = bits
    flat = np.unpackbits(full.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(flat.T), axis=1, bitorder="little").view("<u8")


def shifted(p: np.ndarray, d: int) -> np.ndarray:
    """Lane i of the result is lane i + d."""
    skip, rest = divmod(d, 64)
    out = np.zeros_like(p)
    if skip < p.shape[-1]:
        out[..., : p.shape[-1] - skip] = p[..., skip:]
    if rest:
        low = out >> np.uint64(rest)
        low[..., :-1] |= out[..., 1:] << np.uint64(64 - rest)
        return low
    return out


def within(diff: np.ndarray, radius: int, alive: np.ndarray) -> np.ndarray:
    """Lanes of ``alive`` whose planes in ``diff`` have at most ``radius`` bits set.

    Planes go eight at a time through carry-save adders into counter planes that stop at
    the first power of two over the radius; words with no lane left are dropped.
    """
    depth = radius.bit_length()
    keep = np.flatnonzero(alive)
    live = alive[keep].copy()
    count = np.zeros((depth, len(keep)), np.uint64)
    for at in range(0, 64, 8):
        x = diff[at : at + 8, keep]
        level, over = list(x), np.zeros(len(keep), np.uint64)
        for c in range(depth):
            up = []
            level.append(count[c])
            while len(level) >= 3:
                a, b, e = level.pop(), level.pop(), level.pop()
                both = a ^ b
                up.append((a & b) | (both & e))
                level.insert(0, both ^ e)
            if len(level) == 2:
                up.append(level[0] & level[1])
                level = [level[0] ^ level[1]]
            count[c] = level[0]
            level = up
        for carried in level:
            over |= carried
        live &= ~over
        more, equal = np.zeros_like(live), np.full_like(live, ~np.uint64(0))
        for c in range(depth - 1, -1, -1):
            if radius >> c & 1:
                equal &= count[c]
            else:
                more |= equal & count[c]
                equal &= ~count[c]
        live &= ~more
        left = live != 0
        if not left.all():
            keep, live, count = keep[left], live[left], count[:, left]
        if not len(keep):
            break
    out = np.zeros_like(alive)
    out[keep] = live
    return out


def lanes(mask: np.ndarray) -> np.ndarray:
    full = np.zeros(-(-len(mask) // 64) * 64, np.uint8)
    full[: len(mask)] = mask
    return np.packbits(full, bitorder="little").view("<u8")


def bucket_links(keys: np.ndarray, sides: np.ndarray, bits: np.ndarray, radius: int, names: np.ndarray | None = None) -> np.ndarray:
    """Links (two columns of row numbers) that join the members of each bucket; rows come sorted by key.

    With ``names``, members of one name are not compared, and every link between two names
    is returned, as a link that still has to be checked joins nothing.

    ``sides`` is 0 in an ordinary bucket. In a meeting of two pieces it is 1 or 2, and only
    members of different sides are compared (each piece is compared in itself elsewhere).
    """
    n = len(keys)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [n])))
    begins, ends = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
    parent, out = np.arange(n) if names is None else names, [np.empty((0, 2), np.int64)]
    d = 1

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    alive_rows = np.arange(n)
    p, row_bits, row_ends, row_sides = planes(bits), bits, ends, sides
    while True:
        open_ = alive_rows + d < row_ends
        if not open_.any():
            return np.concatenate(out)
        if open_.sum() * 2 < len(alive_rows):  # go on with the buckets that reach this far
            chosen = row_ends - begins[alive_rows] > d
            alive_rows, row_bits, row_ends, row_sides = alive_rows[chosen], row_bits[chosen], row_ends[chosen], row_sides[chosen]
            p = planes(row_bits)
            open_ = alive_rows + d < row_ends
        m = len(alive_rows)
        labels = parent[alive_rows]
        want = np.zeros(m, bool)
        want[: m - d] = open_[: m - d] & (labels[: m - d] != labels[d:]) & ((row_sides[: m - d] != row_sides[d:]) | (row_sides[: m - d] == 0))
        if want.any():
            hits = within(p ^ shifted(p, d), radius, lanes(want))
            found = np.flatnonzero(np.unpackbits(hits.view(np.uint8), bitorder="little"))
            if len(found) and names is not None:
                out.append(np.stack((alive_rows[found], alive_rows[found + d]), axis=1))
            elif len(found):
                joined = []
                for i, j in zip(alive_rows[found].tolist(), alive_rows[found + d].tolist(), strict=True):
                    a, b = root(i), root(j)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        joined.append((i, j))
                out.append(np.array(joined, np.int64).reshape(-1, 2))
                while not np.array_equal(up := parent[parent], parent):
                    parent = up
        d += 1


def links(distinct: DataFrame, radius: int = 4, piece: int = 2048) -> DataFrame:
    """``(a, b)``: fingerprints of the column ``bits`` joined by links within ``radius``."""
    spark = distinct.sparkSession
    masks = band_masks(distinct.count(), radius)
    choices = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(m - (1 << 64) if m >> 63 else m).alias("m")) for i, m in enumerate(masks)])
    dealt = distinct.withColumn("choice", F.explode(choices)).select("bits", F.xxhash64(F.col("choice.c"), F.col("bits").bitwiseAND(F.col("choice.m"))).alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    # Only a bucket's size is joined back.
    shared = storage.settle(shared, "buckets")
    keyed = in_pieces(dealt.join(shared, "bucket"), "bucket", "bits", piece, ["bits"])
    sorted_ = keyed.repartition(storage.shards(spark), "key").sortWithinPartitions("key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sides, bits in whole_buckets(batches):
            ends = bits[bucket_links(keys, sides, bits.view("<u8"), radius)]
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return sorted_.mapInArrow(storage.tidy(compare), "a long, b long")


def in_pieces(members: DataFrame, bucket: str, member: str, piece: int, columns: list[str]) -> DataFrame:
    """``(key, side, *columns)``: buckets of ``n`` members, those beyond ``piece`` spread over pairs of pieces."""
    members = members.withColumn("pieces", F.ceil(F.col("n") / piece).cast("int"))
    own = F.pmod(F.xxhash64(member), F.col("pieces")).cast("int")
    members = members.withColumn("own", own).withColumn("opposite", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    low, high = F.least("own", "opposite"), F.greatest("own", "opposite")
    side = F.when(low == high, 0).when(F.col("own") == low, 1).otherwise(2)
    return members.select(F.when(F.col("pieces") == 1, F.col(bucket)).otherwise(F.xxhash64(bucket, low, high)).alias("key"), side.cast("int").alias("side"), *columns)


def whole_buckets(batches: Iterator[pa.RecordBatch], most: int = 1 << 17) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of rows that come sorted by the first, about ``most`` at a time; no bucket is parted."""
    rest: list[tuple[np.ndarray, ...]] = []
    held = 0
    for batch in batches:
        rest.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        held += batch.num_rows
        if held >= most:
            whole = tuple(map(np.concatenate, zip(*rest, strict=True)))
            cut = int(np.searchsorted(whole[0], whole[0][-1]))
            rest = [tuple(x[cut:] for x in whole)]
            held = len(whole[0]) - cut
            if cut:
                yield tuple(x[:cut] for x in whole)
    if held:
        yield tuple(map(np.concatenate, zip(*rest, strict=True)))


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 4, radius: int = 4) -> DataFrame:
    """``(doc_id, hash, bits, label, component_id)`` for each row; equal labels are one group."""
    prints = storage.settle(fingerprints(df, id_col, text_col, n_words), "simhash")
    distinct = storage.settle(prints.groupBy("bits").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    labels = components(links(distinct.select("bits"), radius)).withColumnRenamed("node", "bits")
    labelled = storage.settle(distinct.join(labels, "bits", "left").select("bits", "first", F.coalesce("label", "bits").alias("label")), "simhash-labels")
    least = storage.settle(labelled.groupBy("label").agg(F.min("first").alias("component_id")), "simhash-least")
    named = storage.settle(labelled.join(least, "label").select("bits", "label", "component_id"), "simhash-named")
    return prints.join(named, "bits")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 4, radius: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``df``."""
    return grouped(df, id_col, text_col, n_words, radius).select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 4, radius: int = 4) -> DataFrame:
    """One row of each group, all columns: the smallest id (rows without id come last), then the least text hash."""
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("hash").alias("c"))
    chosen = grouped(df, id_col, text_col, n_words, radius).groupBy("label").agg(F.min(order).alias("f"))
    return storage.rows_of(df, id_col, text_col, chosen.select(F.col("f.b").alias("id"), F.col("f.c").alias("hash")))

"""Groups of texts whose sets of word shingles are similar, found through SimHash fingerprints.

Shingles: words as in ``simhash``, ``n_words`` in a row (a shorter text is one shingle, a
text without words has none); texts are linked where shared / all shingles >= ``similarity``.
Equal sets are one class (representative plus membership), and only classes are compared.

1. A class's fingerprint has a bit set where over half of its shingles' hashes have it. At
   similarity 0.8 two fingerprints differ in 9.7 of 64 bits on average; more than ``radius``
   = 24 of them differ in about 1 of 100,000 such pairs.
2. Classes meet under the ``keys`` = 12 least shingle hashes of each. Of the least 12 of two
   sets together, each is shared by both with the probability of their similarity, so a pair
   of 0.8 has no common key in 4 of a thousand million cases (in none if the sets are small,
   as those 12 then hold more than a fifth of the set).
3. Each class is set against the first holder of each of its keys: as many pairs as keys,
   however frequent a key is. Pairs within the radius are checked shingle by shingle.
4. Where holders of a key are still in different groups, they come together with their texts,
   at most ``piece`` at a time (a key with more is compared as pairs of pieces). All that are
   apart are compared on vertical bit planes (``simhash.bucket_links``), and pairs within the
   radius are checked there, but for those that other links have joined meanwhile. Groups
   that step 3 has joined, the usual case of many near copies, cost nothing more.

Defined cases: null texts and texts without words have the empty set, which equals itself;
of a group the row with the smallest id stays (rows without id come last, then the least
text hash); a repeated row counts once; an empty table gives no rows; further columns pass
through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import simhash, storage
from .components import components
from .words import lots, words

U = np.uint64
LOT = 1 << 21
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, 64).astype(np.uint64) * U(2) + U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(32)) * U(0x9E3779B97F4A7C15)
    x = (x ^ x >> U(29)) * U(0xBF58476D1CE4E5B9)
    return x ^ x >> U(32)


def shingle_sets(column: pa.Array, n_words: int) -> list[np.ndarray]:
    """Of each text, the hashes of its shingles in rising order."""
    index, sizes, distinct = words(column)
    hashes = np.array([xxh64_intdigest(w) for w in distinct], np.uint64)[index]
    whole = max(0, len(hashes) - n_words + 1)
    rows = np.zeros(whole, np.uint64)
    for k in range(n_words):
        rows += hashes[k : k + whole] * FACTORS[k]
    rows = mixed(rows)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= n_words:
            out.append(np.unique(rows[at : at + n - n_words + 1]))
        elif n:
            out.append(mixed((hashes[at : at + n] * FACTORS[:n]).sum(keepdims=True) + U(n)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def majority(held: np.ndarray) -> int:
    """64-bit fingerprint of a set of hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(held), 1 << 14):
        part = held[at : at + (1 << 14)]
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * votes > len(held)).astype(np.uint8), bitorder="little").view("<u8")[0])


def sketches(df: DataFrame, id_col: str, text_col: str, n_words: int, keys: int) -> DataFrame:
    """``(id, hash, node, bits, size, keys)`` of each row; ``node`` stands for the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in lots(batch.column(2), LOT):
                sets = shingle_sets(batch.column(2).slice(at, n), n_words)
                nodes = np.array([xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
                bits = np.array([majority(x) for x in sets], np.uint64).view(np.int64)
                least = pa.array([x[:keys].view(np.int64) for x in sets], pa.list_(pa.int64()))
                sizes = pa.array([len(x) for x in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(nodes), pa.array(bits), sizes, least], ["id", "hash", "node", "bits", "size", "keys"])

    text = F.col(text_col).cast("string")
    chosen = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    return chosen.mapInArrow(storage.tidy(run), "id long, hash long, node long, bits long, size int, keys array<long>")


def checked(pairs: DataFrame, texts: DataFrame, n_words: int, share: Fraction) -> DataFrame:
    """Those of ``pairs (a, b)`` whose sets are as similar as ``share`` asks; ``texts (node, text)``."""
    own, other = (texts.select(F.col("node").alias(end), F.col("text").alias(f"t{end}")).hint("merge") for end in "ab")
    met = pairs.join(own, "a").join(other, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                held: dict[int, np.ndarray] = {}
                for end in (0, 1):
                    nodes = part.column(end).to_pylist()
                    fresh = [i for i, x in enumerate(nodes) if nodes.index(x) == i and x not in held]
                    sets = shingle_sets(part.column(end + 2).take(pa.array(fresh, pa.int32())), n_words)
                    held.update(zip((nodes[i] for i in fresh), sets, strict=True))
                kept = []
                for i, (a, b) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                    x, y = held[a], held[b]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both * share.denominator >= share.numerator * (len(x) + len(y) - both):
                        kept.append(i)
                yield part.select(["a", "b"]).take(pa.array(kept, pa.int32()))

    return met.mapInArrow(storage.tidy(run), "a long, b long")


def linked_pairs(pairs: np.ndarray, sets: list[np.ndarray], names: np.ndarray, share: Fraction) -> list[tuple[int, int]]:
    """Those of ``pairs`` (row numbers) that are similar and join two of ``names``, which are joined on the way."""
    out: list[tuple[int, int]] = []
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    heads = np.flatnonzero(np.concatenate(([True], pairs[1:, 0] != pairs[:-1, 0]))) if len(pairs) else []
    sizes = np.array([len(x) for x in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    _, places = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(places), bool)
    for a, b in zip(heads, [*heads[1:], len(pairs)], strict=True):
        i, others = int(pairs[a, 0]), pairs[a:b, 1]
        least, most = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[(names[others] != names[i]) & (least * share.denominator >= most * share.numerator)]
        if not len(others):
            continue
        own = places[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        size = sizes[others]
        ends = np.cumsum(size)
        inside = np.repeat(starts[others] - ends + size, size) + np.arange(int(ends[-1]))
        both = np.add.reduceat(mark[places[inside]].astype(np.int64), ends - size)
        mark[own] = False
        for j in others[both * share.denominator >= share.numerator * (sizes[i] + size - both)].tolist():
            if names[i] != names[j]:
                names[names == names[j]] = names[i]
                out.append((i, j))
    return out


def links_within(members: DataFrame, n_words: int, radius: int, share: Fraction, piece: int = 1024) -> DataFrame:
    """``(a, b)``: similar ones of ``members (key, label, bits, node, text)`` that have a key in common and unlike labels."""
    spark = members.sparkSession
    counts = storage.settle(members.groupBy("key").agg(F.count("*").alias("n")), "similar-counts")
    dealt = simhash.in_pieces(members.join(counts.hint("merge"), "key"), "key", "node", piece, ["label", "bits", "node", "text"])
    sorted_ = dealt.repartition(storage.shards(spark), "key").sortWithinPartitions("key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256))
        for keys, sides, labels, bits, nodes, texts in simhash.whole_buckets(small, 2 * piece):
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
                _, names = np.unique(labels[a:b], return_inverse=True)
                near = simhash.bucket_links(keys[a:b], sides[a:b], bits[a:b].view(np.uint64), radius, names)
                if len(near):
                    used, back = np.unique(near, return_inverse=True)
                    sets = shingle_sets(pa.array(texts[a:b][used], pa.string()), n_words)
                    found = np.array(linked_pairs(back.reshape(-1, 2), sets, names[used], share), np.int64).reshape(-1, 2)
                    ends = nodes[a:b][used][found]
                    yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return sorted_.mapInArrow(storage.tidy(compare), "a long, b long").distinct()


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, similarity: float = 0.8, radius: int = 24, keys: int = 12) -> DataFrame:
    """``(id, hash, node, label)`` of each row; equal labels are one group."""
    share = Fraction(str(similarity))
    prints = storage.settle(sketches(df, id_col, text_col, n_words, keys), "similar-prints")
    classes = storage.settle(prints.dropDuplicates(["node"]), "similar-classes")
    info = classes.select("node", "bits", "size")
    held = classes.select("node", F.explode("keys").alias("key"))
    firsts = storage.settle(held.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1"), "similar-firsts")
    shared = storage.settle(held.join(firsts.hint("merge"), "key").join(info.hint("merge"), "node"), "similar-shared")

    text = F.col(text_col).cast("string")
    rows = df.select(F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text)).alias("row"), text.alias("text"))
    places = classes.select("node", F.xxhash64("id", "hash").alias("row"))

    def texts_of(nodes: DataFrame, name: str) -> DataFrame:
        wanted = places.join(nodes.distinct().hint("merge"), "node")
        texts = rows.join(wanted.hint("merge"), "row").dropDuplicates(["node"]).select("node", F.coalesce("text", F.lit("")).alias("text"))
        return storage.settle(texts, f"similar-{name}-texts")

    near = (F.bit_count(F.col("bits").bitwiseXOR(F.col("other"))) <= radius) & (F.least("size", "length") * share.denominator >= F.greatest("size", "length") * share.numerator)
    starred = shared.where("node <> first").select("node", "bits", "size", "first").distinct()
    starred = starred.join(info.select(F.col("node").alias("first"), F.col("bits").alias("other"), F.col("size").alias("length")).hint("merge"), "first")
    pairs = storage.settle(starred.where(near).select(F.col("first").alias("a"), F.col("node").alias("b")), "similar-pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    links = storage.settle(checked(pairs, texts_of(ends, "first"), n_words, share), "similar-first")
    labels = storage.settle(components(links), "similar-labels")

    named = shared.where("n > 2").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = storage.settle(named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key"), "similar-apart")
    members = storage.settle(named.where("node <> first").join(apart.hint("merge"), "key").select("key", "label", "bits", "node"), "similar-members")
    held = members.join(texts_of(members.select("node"), "rest").hint("merge"), "node").select("key", "label", "bits", "node", "text")
    more = storage.settle(links_within(held, n_words, radius, share), "similar-rest")
    labels = components(links.union(more)).withColumnRenamed("node", "of")
    return prints.join(labels.hint("merge"), F.col("node") == F.col("of"), "left").select("id", "hash", "node", F.coalesce("label", "node").alias("label"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group, all columns."""
    order = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("hash").alias("c"))
    chosen = grouped(df, id_col, text_col, **options).groupBy("label").agg(F.min(order).alias("f"))
    return storage.rows_of(df, id_col, text_col, chosen.select(F.col("f.b").alias("id"), F.col("f.c").alias("hash")))

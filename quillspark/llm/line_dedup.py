"""Line dedup by pairwise alignment.

Lines are compared by the XXH64 of their text without blanks at its ends; blank lines have
no hash. Documents with equal lines throughout are one class: the first stands for it, and
the others lose all their lines (if these come to ``min_chars``). Between classes:

* A line that at most ``rare`` classes hold pairs each of them with all earlier ones.
* Stretches of a document made of more frequent lines have no such line. There every
  shortest run of lines that reaches ``min_chars`` characters (from each line onwards, and
  up to each line) pairs each later holder of the run with its first holder, so that pairs
  grow with the lines and no line is too frequent to be found.

A longer block is the union of its shortest runs, each of which holds a rare line or lies in
such a stretch, so each block that any earlier document holds is found, whichever documents
hold its parts.

Each pair is aligned with patience diff: lines that occur once on both sides, their longest
increasing chain, the same again inside every gap, and equal neighbours of what is aligned.
A run of lines aligned one after the other is a block; blocks of ``min_chars`` characters or
more go from the later document. Runs of that length that the alignment leaves, as they are
repeated or moved, are looked up among all runs of the other side, so every occurrence goes.
What goes is the union over a document's partners, judged on the input, so the pairs need no
order among themselves. Shorter common blocks stay.

Hot lines: counts and first holders are aggregated in each task before they are exchanged
and written out, so that joins with them see plain exchanges that adaptive execution can
split. Only hashes and line lengths are moved until the removals meet the texts; the earlier
document of a pair goes without the lines that nobody else holds.

Defined cases: a null text stays null and an empty one empty; null ids come before all
others; rows of one id count in the order of their texts' hashes, and an exact repeat of a
row is the same document and gives the same result; an empty table gives no rows; further
columns pass through (``n_lines`` and ``n_removed`` are replaced).
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import storage


def chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest part of ``pairs`` (rising in the first place) that rises in the second too."""
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before[n] = last[at - 1] if at else -1
        tails[at:at + 1], last[at:at + 1] = [j], [n]
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def aligned(own: list, other: list) -> list[tuple[int, int]]:
    """Patience diff: pairs of positions, rising on both sides, of equal lines."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(own), 0, len(other))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and own[a] == other[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and own[b - 1] == other[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        left, right = Counter(own[a:b]), Counter(other[c:d])
        place = {h: j for j, h in enumerate(other[c:d], c) if right[h] == 1 and left[h] == 1 and h is not None}
        anchors = chain([(i, place[h]) for i, h in enumerate(own[a:b], a) if h in place])
        if not anchors:
            continue
        i, j = a, c
        for x, y in anchors:
            gaps.append((i, x, j, y))
            out.append((x, y))
            i, j = x + 1, y + 1
        gaps.append((i, b, j, d))
    return sorted(out)


def runs(lines: list[int], sizes: list[int], min_chars: int) -> Iterator[tuple[int, int, int]]:
    """``(start, stop, key)`` of the runs that just reach ``min_chars`` characters.

    From each line the shortest run that starts with it, and the shortest that ends with
    it: two a line, and each longer run is the union of those inside it. Blank lines at a
    run's edge enter the key by their number.
    """
    n, names, keys = len(lines), array("q", lines).tobytes(), {}
    ends, starts = [0] * n, [n] * n
    total = stop = 0
    for i in range(n):
        while stop < n and total < max(min_chars, 1):
            total, stop = total + sizes[stop], stop + 1
        if total < max(min_chars, 1):
            break
        ends[i], total = stop, total - sizes[i]
    total, start = 0, n
    for i in range(n - 1, -1, -1):
        while start and total < max(min_chars, 1):
            start -= 1
            total += sizes[start]
        if total < max(min_chars, 1):
            break
        starts[i], total = start, total - sizes[i]

    def key(a: int, b: int, lead: int, tail: int) -> int:
        if (a, b) not in keys:
            keys[a, b] = xxh64_intdigest(names[8 * a : 8 * b])
        return xxh64_intdigest(b"%d %d" % (lead, tail), keys[a, b]) if lead or tail else keys[a, b]

    first = n
    for i in range(n - 1, -1, -1):
        first = i if sizes[i] else first
        if ends[i]:
            yield i, ends[i], key(first, ends[i], first - i, 0)
    last = -1
    for i in range(n):
        last = i if sizes[i] else last
        if starts[i] < n and ends[starts[i]] != i + 1:
            yield starts[i], i + 1, key(starts[i], last + 1, 0, i - last)


def common_lines(own: list, sizes: list[int], other: list, min_chars: int) -> list[int]:
    """Positions of ``own`` in runs of ``min_chars`` characters or more that ``other`` holds too.

    The alignment finds them but for those that are repeated or stand in another order;
    the runs that it leaves are looked up among all of ``other``.
    """
    gone: set[int] = set()
    block: list[int] = []
    last = None
    for pair in [*aligned(own, other), None]:
        if block and (pair is None or pair != (last[0] + 1, last[1] + 1)):
            if sum(sizes[i] for i in block) >= min_chars:
                gone.update(block)
            block = []
        if pair:
            block.append(pair[0])
            last = pair
    known = set(other)
    if all(i in gone or h not in known for i, h in enumerate(own)):
        return sorted(gone)
    size = {h: n for h, n in zip(own, sizes, strict=True) if h in known}
    name = {h: n for n, h in enumerate(size)}

    def shared(lines: list) -> Iterator[tuple[int, int, int]]:
        """Runs made of lines that both sides hold."""
        at = 0
        for stop in [*(i for i, h in enumerate(lines) if h not in name), len(lines)]:
            for a, b, key in runs([name[h] for h in lines[at:stop]], [size[h] for h in lines[at:stop]], min_chars):
                yield at + a, at + b, key
            at = stop + 1

    there = {key for _, _, key in shared(other)}
    for a, b, key in shared(own):
        if key in there:
            gone.update(range(a, b))
    return sorted(gone)


def _key(id_: Column, text: Column) -> Column:
    return F.xxhash64(id_, F.xxhash64(text))


#: Stands for lines that no other document holds.
ALONE = 0


def keyed_runs(hashes: list[int | None], sizes: list[int], common: set[int], min_chars: int) -> set[int]:
    """Keys of the shortest runs in stretches of frequent and blank lines."""
    keys: set[int] = set()
    at = 0
    for stop in [*(i for i, h in enumerate(hashes) if h is not None and h not in common), len(hashes)]:
        if stop > at:
            keys.update(key for _, _, key in runs([h or 0 for h in hashes[at:stop]], sizes[at:stop], min_chars))
        at = stop + 1
    return keys


def outlined(hashes: list[int | None], shared: set[int]) -> list[int | None]:
    """``hashes`` with ``ALONE`` in place of each run of lines that are not shared."""
    out: list[int | None] = []
    for h in hashes:
        if h is None or h in shared:
            out.append(h)
        elif not out or out[-1] != ALONE:
            out.append(ALONE)
    return out


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 50, rare: int = 8) -> DataFrame:
    """``(key, gone)``: of each document that loses lines, their positions from 0."""
    text, id_ = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(x))
    hashes = F.transform(lines, lambda x: F.when(F.length(x) > 0, F.xxhash64(x)))
    rows = df.where(F.col(text_col).isNotNull()).select(_key(id_, text).alias("key"), id_.alias("id"), F.xxhash64(text).alias("th"), hashes.alias("hashes"), F.transform(lines, F.length).alias("sizes"))
    rows = rows.withColumn("class", F.xxhash64("hashes", F.size("hashes"), "sizes"))
    rows = storage.settle(rows.dropDuplicates(["key"]), "lines")
    order = F.struct("id", "th", "key")
    firsts = storage.settle(rows.select("class", order.alias("o")).groupBy("class").agg(F.min("o").alias("o")).select("class", F.col("o.key").alias("first")), "line-classes")
    named = rows.join(firsts.hint("merge"), "class")
    copies = named.where("key <> first").where(F.aggregate("sizes", F.lit(0), lambda a, x: a + x) >= min_chars)
    copies = copies.select("key", F.sequence(F.lit(0), F.size("hashes") - 1).alias("gone"))
    heads = named.where("key = first").drop("class", "first")

    own = F.array_distinct(F.filter("hashes", lambda h: h.isNotNull()))
    held = heads.select("key", "id", "th", F.explode(own).alias("line"))
    counts = storage.settle(held.groupBy("line").agg(F.count("*").alias("n")).where("n > 1"), "line-counts")
    shared = storage.settle(held.join(counts.hint("merge"), "line"), "line-shared")

    # At most ``rare`` holders a line come together here.
    holders = shared.where(F.col("n") <= rare).groupBy("line").agg(F.array_sort(F.collect_list(order)).alias("h"))
    later = F.transform(F.sequence(F.lit(1), F.size("h") - 1), lambda i: F.transform(F.slice("h", 1, i), lambda e: F.struct(F.get("h", i)["key"].alias("key"), e["key"].alias("first"))))
    by_line = holders.select(F.inline(F.flatten(later)))

    def add_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                outlines, found = [], []
                for own, sizes, known in zip(*(part.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                    common = {x["line"] for x in known if x["common"]}
                    outlines.append(outlined(own, {x["line"] for x in known}))
                    found.append(np.array(list(keyed_runs(own, sizes, common, min_chars)) if common else [], "<u8").view("<i8"))
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(outlines, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int64()))], ["key", "id", "th", "hashes", "sizes", "outline", "runs"])

    known = shared.groupBy("key").agg(F.collect_list(F.struct("line", (F.col("n") > rare).alias("common"))).alias("known"))
    met = heads.join(known.hint("merge"), "key").select("key", "id", "th", "hashes", "sizes", "known")
    docs = storage.settle(met.mapInArrow(storage.tidy(add_runs), "key long, id long, th long, hashes array<long>, sizes array<int>, outline array<long>, runs array<long>"), "line-docs")
    held = docs.select("key", "id", "th", F.explode("runs").alias("run"))
    starts = held.groupBy("run").agg(F.count("*").alias("n"), F.min(order).alias("o")).where("n > 1").select("run", F.col("o.key").alias("first"))
    starts = storage.settle(starts, "line-firsts")
    by_run = held.join(starts.hint("merge"), "run").where("key <> first").select("key", "first")
    pairs = storage.settle(by_line.union(by_run).distinct(), "line-pairs")
    earlier = docs.select(F.col("key").alias("first"), F.col("outline").alias("other"))
    pairs = pairs.join(earlier.hint("merge"), "first").join(docs.select("key", "hashes", "sizes").hint("merge"), "key").select("key", "hashes", "sizes", "other")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                keys, gone = [], []
                for key, own, sizes, other in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                    if found := common_lines(own, sizes, other, min_chars):
                        keys.append(key)
                        gone.append(np.array(found, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])

    found = pairs.mapInArrow(storage.tidy(align), "key long, gone array<int>").union(copies)
    return storage.settle(found.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")), "line-removals")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 50, rare: int = 8) -> DataFrame:
    """``df`` with shortened texts, and how many lines each had (``n_lines``) and lost (``n_removed``)."""
    key, gone = storage.unused(df, "key"), storage.unused(df, "gone")
    found = removals(df, id_col, text_col, min_chars, rare).withColumnsRenamed({"key": key, "gone": gone})
    df = df.drop("n_lines", "n_removed")
    text = F.col(text_col).cast("string")
    # A sort-merge join whatever the sizes: a plan that turns with them cannot be judged on small inputs.
    joined = df.withColumn(key, _key(F.col(id_col).cast("long"), text)).join(found.hint("merge"), key, "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    cut = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    counted = joined.withColumns({"n_lines": F.coalesce(F.size(lines).cast("long"), F.lit(0)), "n_removed": F.coalesce(F.size(gone).cast("long"), F.lit(0)), text_col: cut})
    counted = counted.withColumn("n_lines", F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines")))
    return counted.select(*df.columns, "n_lines", "n_removed")

"""Connected components of an edge table, without gathering any part of it.

Randomised contraction: in each round every node picks, among itself and its neighbours, the
node of the least priority (a hash of the node), and all edges move to what their ends
picked. Whatever the order of the ids, this takes away a constant share of the nodes that
still have edges (a star needs two rounds), so rounds are logarithmic and all rounds together
cost about as much as the first. Once at most ``AT_ONCE`` edges (1 MB) are left, one task joins their nodes.
Picks are then followed back from the last round to the first. Each round's tables are
written to the shared folder, so a lost executor costs at most one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage


AT_ONCE = 1 << 16


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, pick)`` of all edges in one task; ``pick`` is the least node of a component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.array([root(x) for x in nodes], np.int64))], ["node", "pick"])


def components(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """``(node, label)`` for each node of ``edges (a, b)`` that has another neighbour than itself: label is the least node reachable.

    Repeated edges and loops count for nothing; an empty table gives no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    both = storage.settle(both, "edges")
    picks: list[DataFrame] = []
    priority = lambda name: F.xxhash64(F.col(name), F.lit(1))
    while both.count() > at_once:
        least = both.groupBy("a").agg(F.min_by("b", priority("b")).alias("b"))
        picked = F.when(priority("b") < priority("a"), F.col("b")).otherwise(F.col("a"))
        picks.append(storage.settle(least.select(F.col("a").alias("node"), picked.alias("pick")), "picks"))
        first, second = (picks[-1].withColumnsRenamed({"node": end, "pick": f"p{end}"}).hint("merge") for end in "ab")
        moved = both.join(first, "a").join(second, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        both = storage.settle(moved, "edges")
    names = storage.settle(both.coalesce(1).mapInArrow(storage.tidy(_joined), "node long, pick long"), "names")
    while picks:
        further = names.select(F.col("node").alias("pick"), F.col("pick").alias("last"))
        names = picks.pop().join(further.hint("merge"), "pick", "left").select("node", F.coalesce("last", "pick").alias("pick"))
        names = storage.settle(names, "names")
    least = storage.settle(names.groupBy("pick").agg(F.min("node").alias("label")), "least")
    return names.join(least.hint("merge"), "pick").select("node", "label")

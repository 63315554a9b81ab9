"""The order of all suffixes of a table of letters, by a difference cover in exchanges.

The distributed form of ``suffix_array``: positions that are 1 or 2 modulo 3 are sorted by
their triples in a range exchange and named in order; where names repeat, the order comes
from the ranks of the string of names, by recursion. Each other suffix is placed by two more
range exchanges, one with the sampled suffixes of either residue, in which running counts say
how many come before it. Only the number of rows of each partition goes to the driver.

``op3_substring_dedup`` does not go this way: see the README for what it moves. It is here
for tables where that is no matter, and as the measure of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .suffix_array import suffix_array

COUNTED = ("name", "zeros", "others")


def counted(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` in the order of ``by`` (longs), with counters over the whole order.

    ``name`` numbers the different keys from 1; ``zeros`` and ``others`` count the rows
    before this one whose ``kind`` is 0 or is not.
    """
    spark = df.sparkSession
    df = df.select(*by, *(c for c in df.columns if c not in by))
    at = df.columns.index("kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, name, zeros, others = None, 0, 0, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(len(by))])
            zero = batch.column(at).to_numpy() == 0
            fresh = np.ones(batch.num_rows, bool)
            fresh[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
            fresh[0] = last is None or (keys[:, 0] != last).any()
            names, z, o = name + np.cumsum(fresh), zeros + np.cumsum(zero), others + np.cumsum(~zero)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (names, z - zero, o - ~zero)), pa.array(np.full(batch.num_rows, part, np.int64))], [*batch.schema.names, *COUNTED, "part"])
            last, name, zeros, others = keys[:, -1], int(names[-1]), int(z[-1]), int(o[-1])

    schema = ", ".join(f"{c} long" for c in (*df.columns, *COUNTED, "part"))
    rows = df.repartitionByRange(storage.shards(spark), *by).sortWithinPartitions(*by).mapInArrow(storage.tidy(run), schema)
    rows = storage.settle(rows, "suffix-order")
    sums = rows.groupBy("part").agg(F.max("name").alias("name"), F.count_if(F.col("kind") == 0).alias("zeros"), F.count_if(F.col("kind") != 0).alias("others")).collect()
    sums.sort(key=lambda r: r["part"])
    before = np.cumsum([[0, 0, 0], *([r[c] for c in COUNTED] for r in sums)], axis=0)
    offsets = spark.createDataFrame([(r["part"], *map(int, b)) for r, b in zip(sums, before[:-1], strict=True)], "part long, n long, z long, o long")
    moved = rows.join(F.broadcast(offsets), "part")  # a row a partition
    return moved.withColumns({c: F.col(c) + F.col(c[0]) for c in COUNTED}).drop("part", "n", "z", "o")


def suffix_ranks(letters: DataFrame, at_once: int = 1 << 20) -> DataFrame:
    """``(i, place)``: place from 0 of each suffix of ``letters (i, c)``, with i from 0 without gaps and c not negative.

    Strings of at most ``at_once`` letters (8 MB) are ordered in one task. An empty table gives no rows.
    """
    letters = storage.settle(letters.select(F.col("i").cast("long").alias("i"), F.col("c").cast("long").alias("c")), "suffix-letters")
    n = letters.count()
    if n <= at_once:
        def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
            x = np.empty(sum(len(i) for i, _ in parts), np.int64)
            for i, c in parts:
                x[i] = c
            yield pa.RecordBatch.from_arrays([pa.array(suffix_array(x)), pa.array(np.arange(len(x)))], ["i", "place"])

        return letters.coalesce(1).mapInArrow(storage.tidy(order), "i long, place long")
    ahead = lambda k: letters.select((F.col("i") - k).alias("i"), F.col("c").alias(f"c{k}"))
    triples = letters.join(ahead(1).hint("merge"), "i", "left").join(ahead(2).hint("merge"), "i", "left").fillna(-1)
    triples = storage.settle(triples, "suffix-triples")
    sample = triples.where("i % 3 <> 0")
    closed = n % 3 == 1  # an empty suffix stands between the residues in the string of names
    if closed:
        sample = sample.union(letters.sparkSession.sql(f"SELECT {n}L, -1L, -1L, -1L"))
    ones, size = (n + 1) // 3 + closed, (n + 1) // 3 + n // 3 + closed
    named = counted(sample.withColumn("kind", F.lit(0).cast("long")), ["c", "c1", "c2"]).select("i", "name")
    if named.agg(F.max("name")).first()[0] == size:
        ranks = named.select("i", F.col("name").alias("rank"))
    else:
        index = F.when(F.col("i") % 3 == 1, F.floor(F.col("i") / 3)).otherwise(F.lit(ones) + F.floor(F.col("i") / 3)).cast("long")
        named = named.withColumn("j", index)
        below = suffix_ranks(named.select(F.col("j").alias("i"), F.col("name").alias("c")), at_once)
        ranks = named.join(below.withColumnRenamed("i", "j").hint("merge"), "j").select("i", (F.col("place") + 1).alias("rank"))
    ranks = storage.settle(ranks, "suffix-ranks")
    after = lambda k: ranks.select((F.col("i") - k).alias("i"), F.col("rank").alias(f"r{k}"))
    keyed = triples.select("i", "c", "c1").join(after(1).hint("merge"), "i", "left").join(after(2).hint("merge"), "i", "left").fillna(0).withColumn("kind", F.col("i") % 3)
    keyed = storage.settle(keyed, "suffix-keys")
    first = counted(keyed.where("kind <> 2").select("c", "r1", "i", "kind"), ["c", "r1"])
    second = counted(keyed.where("kind <> 1").select("c", "c1", "r2", "i", "kind"), ["c", "c1", "r2"])
    rest = first.where("kind = 0").select("i", (F.col("zeros") + F.col("others")).alias("a")).join(second.where("kind = 0").select("i", F.col("others").alias("b")).hint("merge"), "i")
    met = first.where("kind = 1").select("i", "zeros").union(second.where("kind = 2").select("i", "zeros"))
    met = met.join(ranks.hint("merge"), "i").select("i", (F.col("rank") - 1 - int(closed) + F.col("zeros")).alias("place"))
    return rest.select("i", (F.col("a") + F.col("b")).alias("place")).union(met)

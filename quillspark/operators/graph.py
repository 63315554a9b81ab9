"""Links between documents: chains of redirects, resolution of links, in-degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settled


def _followed(jump: DataFrame, most_hops: int) -> DataFrame:
    """Pointers (entry, at, hops, fragment) followed to their ends, twice as far each round.

    Rounds end when nothing moves any more, or all chains of ``most_hops`` must have ended.
    """
    jump = settled(jump)
    for _ in range(most_hops.bit_length()):
        further = jump.select(F.col("entry").alias("__from"), F.col("at").alias("__at"), F.col("hops").alias("__hops"), F.col("fragment").alias("__fragment"))
        joined = jump.join(further, F.col("at") == F.col("__from"), "left")
        moved = settled(joined.select("entry", F.coalesce("__at", "at").alias("at"), (F.col("hops") + F.coalesce("__hops", F.lit(0))).alias("hops"), F.coalesce("fragment", "__fragment").alias("fragment"), F.col("__at").isNotNull().alias("__moved")))
        jump = moved.drop("__moved")
        if moved.where("__moved").isEmpty():
            break
    return jump


def resolve_redirects(redirects: DataFrame, most_hops: int = 49) -> DataFrame:
    """``(entry, target)`` of ``redirects (entry, target)`` at the end of their chains.

    Chains of more than ``most_hops`` hops, and cycles, have no end and are left out. Pointer
    doubling takes log2 of that many joins, whatever the data.
    """
    jump = redirects.select("entry", F.col("target").alias("at"), F.lit(1).cast("bigint").alias("hops"), F.lit(None).cast("string").alias("fragment"))
    ended = _followed(jump, most_hops)
    ends = ended.join(redirects.select(F.col("entry").alias("at")), "at", "left_anti")
    return ends.where(F.col("hops") <= most_hops).select("entry", F.col("at").alias("target"))


def collapse_stubs(stubs: DataFrame, most_hops: int = 8) -> DataFrame:
    """Section redirects ``(stub, target, fragment)`` followed to articles.

    The first fragment along a chain wins; chains that do not end within ``most_hops``, among
    them cycles and stubs of themselves, vanish. The least target stands for a repeated stub.
    """
    once = stubs.groupBy("stub").agg(F.min(F.struct("target", "fragment")).alias("s")).select("stub", "s.target", "s.fragment")
    jump = once.select(F.col("stub").alias("entry"), F.col("target").alias("at"), F.lit(1).cast("bigint").alias("hops"), "fragment")
    ended = _followed(jump, most_hops)
    ends = ended.join(once.select(F.col("stub").alias("at")), "at", "left_anti").where(F.col("hops") <= most_hops)
    return ends.select(F.col("entry").alias("stub"), F.col("at").alias("target"), "fragment")


def path_targets(entries: DataFrame) -> DataFrame:
    """``(path, entry)``: every path of the article namespace and the entry it leads to; those that lead nowhere are left out."""
    ends = resolve_redirects(entries.where("kind = 'redirect'").select("entry", F.col("redirect_target").alias("target")))
    plain = entries.where("kind = 'content'").select("path", "entry")
    moved = entries.where("kind = 'redirect'").select("path", F.col("entry").alias("__e")).join(ends.withColumnRenamed("entry", "__e"), "__e").select("path", F.col("target").alias("entry"))
    return plain.unionByName(moved)


def resolve_links(links: DataFrame, paths: DataFrame, stubs: DataFrame) -> DataFrame:
    """Internal links ``(..., path, fragment)`` get ``target`` and their final ``fragment``; no target: missing.

    A link's own fragment goes before one from a section redirect.
    """
    found = links.join(paths.select("path", F.col("entry").alias("__hit")), "path", "left")
    through = stubs.select(F.col("stub").alias("__hit"), F.col("target").alias("__target"), F.col("fragment").alias("__fragment"))
    joined = found.join(through, "__hit", "left")
    return joined.withColumns({"target": F.coalesce("__target", "__hit"), "fragment": F.coalesce("fragment", "__fragment")}).drop("__hit", "__target", "__fragment")


def inbound_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, inbound)``: distinct other sources that link to each of ``nodes (node)``."""
    counted = edges.where("src <> dst").select("src", "dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("inbound"))
    return nodes.join(counted, "node", "left").select("node", F.coalesce("inbound", F.lit(0)).alias("inbound"))


def link_totals(links: DataFrame) -> DataFrame:
    """One row: internal links with repeats and without self-links, and links that miss."""
    return links.agg(
        F.count_if(F.col("target").isNotNull() & (F.col("target") != F.col("src"))).alias("internal_links"),
        F.count_if(F.col("target").isNull()).alias("missing_links"),
    )

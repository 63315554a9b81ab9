"""Sections and links of documents: subtrees, breadcrumbs, look-ups, numbering, pages.

Tables: ``sections (doc, pos, level, heading, anchor, ...)`` and ``links (doc, pos, ...)``.
What needs all sections of one document takes windows over it that cost one pass a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Fixed value: levels of headings are 1 to 6.
LEVELS = 6


def _before(*by) -> Window:
    """All rows of a document before this one, in an order: frames that grow with it cost one pass."""
    return Window.partitionBy("doc").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)


def with_subtrees(sections: DataFrame, *summed: str) -> DataFrame:
    """``sections`` with ``stop``, the position of the next section of the same or a higher rank (null at the end).

    For each column in ``summed`` there is also its sum over a section and all below it, as
    ``<column>_below``. Windows over the document, a running one for each level.
    """
    own = Window.partitionBy("doc")
    upto = own.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = sections.withColumns({f"_{c}_before": F.sum(c).over(upto) - F.col(c) for c in summed} | {f"_{c}_all": F.sum(c).over(own) for c in summed})
    here = F.struct("pos", *[f"_{c}_before" for c in summed])
    later = _before(F.desc("pos"))
    nexts = F.array(*[F.last(F.when(F.col("level") <= level, here), ignorenulls=True).over(later) for level in range(1, LEVELS + 1)])
    marked = marked.withColumn("_next", F.get(nexts, F.col("level").cast("int") - 1)).withColumn("stop", F.col("_next.pos"))
    below = {f"{c}_below": F.coalesce(F.col(f"_next._{c}_before"), F.col(f"_{c}_all")) - F.col(f"_{c}_before") for c in summed}
    return marked.withColumns(below).drop("_next", *[f"_{c}_{x}" for c in summed for x in ("before", "all")])


def subtree_ends(sections: DataFrame) -> DataFrame:
    """``(doc, pos, stop)``: position of the next section of the same or a higher rank, null at the end."""
    return with_subtrees(sections).select("doc", "pos", "stop")


def breadcrumbs(sections: DataFrame) -> DataFrame:
    """``(doc, pos, path)``: headings of the sections above, outermost first, the lead left out.

    The last heading of a level before a section stands above it if the level is higher than
    the section's and no heading of a still higher level (but the lead's) came after it.
    """
    levels = range(2, LEVELS + 1)
    last = {f"_{n}": F.last(F.when(F.col("level") == n, F.struct("pos", "heading")), ignorenulls=True).over(_before("pos")) for n in levels}
    stands = lambda n: (F.col("level") > n) & (F.col(f"_{n}.pos") > F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(f"_{m}.pos", F.lit(-1)) for m in range(2, n)]))
    path = F.array_compact(F.array(*[F.when(stands(n), F.col(f"_{n}.heading")) for n in levels]))
    return sections.select("doc", "pos", "level", "heading").withColumns(last).select("doc", "pos", F.array_join(path, " > ").alias("path"))


def prune_empty(sections: DataFrame) -> DataFrame:
    """``sections`` with ``blocks`` (a count): the lead, those with blocks, those with a section below that has some."""
    first = F.min("pos").over(Window.partitionBy("doc"))
    marked = with_subtrees(sections.select("doc", "pos", "level", "heading", "blocks"), "blocks").withColumn("_first", first)
    return marked.where((F.col("pos") == F.col("_first")) | (F.col("blocks_below") > 0)).select("doc", "pos", "level", "heading", "blocks")


def subtree_sizes(sections: DataFrame) -> DataFrame:
    """``(doc, pos, own, whole)``: characters of a section, and with all that is below it, its own heading not counted."""
    head = F.char_length("heading") + 1
    return with_subtrees(sections, "size").select("doc", "pos", (F.col("size") - head).alias("own"), (F.col("size_below") - head).alias("whole"))


def outline(sections: DataFrame) -> DataFrame:
    """``(doc, pos, line)``: headings below the lead, two blanks for each level from the third on."""
    below = sections.where("level > 1")
    return below.select("doc", "pos", F.concat(F.repeat(F.lit("  "), F.col("level") - 2), F.col("heading")).alias("line"))


def outline_matches(sections: DataFrame, norm: str, words: list[str]) -> DataFrame:
    """Sections whose normal heading holds all words; ``chosen`` marks each document's first with a word that begins with the first."""
    hits = sections
    for w in words:
        hits = hits.where(F.contains(F.col(norm), F.lit(w)))
    starts = F.exists(F.split(norm, " "), lambda x: x.startswith(words[0])) if words else F.lit(False)
    first = F.min(F.when(starts, F.col("pos"))).over(Window.partitionBy("doc"))
    return hits.withColumn("chosen", F.coalesce(F.col("pos") == first, F.lit(False)))


def containing_section(marks: DataFrame, points: DataFrame) -> DataFrame:
    """As-of look-up: for ``points (key, at, ...)`` the last of ``marks (key, line, section)`` with line <= at.

    One union sorted by key and place instead of a range join.
    """
    columns = [c for c in points.columns if c not in ("key", "at")]
    left = marks.select("key", F.col("line").alias("at"), F.lit(0).alias("__kind"), F.struct("line", "section").alias("__mark"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in columns])
    right = points.select("key", "at", F.lit(1).alias("__kind"), F.lit(None).cast(left.schema["__mark"].dataType).alias("__mark"), *columns)
    order = Window.partitionBy("key").orderBy("at", "__kind", F.col("__mark.section")).rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn("__last", F.last("__mark", ignorenulls=True).over(order)).where("__kind = 1").select("key", "at", *columns, F.col("__last.section").alias("section"))


def fragment_section(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """First section whose anchor is the fragment of ``wanted (doc, fragment)``, or whose heading reads like it."""
    like = F.lower("heading") == F.lower(F.replace(F.col("fragment"), F.lit("_"), F.lit(" ")))
    hit = sections.join(wanted, "doc").where((F.col("anchor") == F.col("fragment")) | like)
    return hit.groupBy("doc", "fragment").agg(F.min("pos").alias("pos"))


def first_seen(links: DataFrame) -> DataFrame:
    """Each target once a document, at its first place: ``(doc, target, pos, rank)``."""
    first = links.groupBy("doc", "target").agg(F.min("pos").alias("pos"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy("pos", "target")))


def link_counts(links: DataFrame) -> DataFrame:
    """``(doc, linked, missing, external)``: distinct targets of each kind."""
    of = lambda kind, what: F.countDistinct(F.when(F.col("kind") == kind, F.col(what)))
    return links.groupBy("doc").agg(of("article", "target").alias("linked"), of("missing", "path").alias("missing"), of("external", "url").alias("external"))


def runs(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Gaps and islands: stretches of equal neighbours, ``(key, island, value, first, n)``."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("__new", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    numbered = marked.withColumn("island", F.sum("__new").over(w))
    return numbered.groupBy(key, "island", value).agg(F.min(order[0]).alias("first"), F.count("*").alias("n"))


def ordinals(items: DataFrame) -> DataFrame:
    """Numbers of the outermost items of each list: ``items (list, pos, depth)`` with ``ordinal``."""
    w = Window.partitionBy("list").orderBy("pos")
    return items.withColumn("ordinal", F.when(F.col("depth") == 0, F.sum((F.col("depth") == 0).cast("int")).over(w)))


def lead_order(blocks: DataFrame) -> DataFrame:
    """Lead blocks ``(doc, pos, type)`` as a page shows them: first paragraph, then facts, then the rest."""
    first = F.min(F.when(F.col("type") == "paragraph", F.col("pos"))).over(Window.partitionBy("doc"))
    rank = F.when(F.col("pos") == first, 0).when(F.col("type") == "facts", 1).otherwise(2)
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(rank, "pos")))


def text_page(text: Column, offset: int, size: int = 6000) -> Column:
    """``struct<page, total, next>``: a page of a text by characters, and where the next one begins."""
    total = F.char_length(text)
    stop = F.least(F.lit(offset + size), total)
    return F.struct(F.substring(text, offset + 1, size).alias("page"), total.alias("total"), F.when(stop < total, stop).alias("next"))


def percentiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Nearest-rank p50, p90, p99 and the maximum of each key."""
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    return rows.groupBy(key).agg(at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.max(value).alias("most"))


def mixed_seed(seed: int) -> int:
    """The 64-bit number a seed is turned into (SplitMix64)."""
    z = (seed + 0x9E3779B97F4A7C15) % (1 << 64)
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
    z = (z ^ z >> 27) * 0x94D049BB133111EB % (1 << 64)
    return z ^ z >> 31


#: Fixed value: a pass over the entries settles so many bits of the one that is looked for.
PICK_BITS = 10


def random_article(articles: DataFrame, seed: int) -> DataFrame:
    """The article that a seed picks from the list in order of entry; no row if there is none.

    Entries are whole numbers, nulls come last. Each pass counts the entries by their upper bits and
    goes on in the range that holds the wanted one: what is collected has 2 ** PICK_BITS + 1 rows at
    most, and nothing depends on how Spark deals out the rows.
    """
    entries = articles.select("entry")
    value = F.col("entry").cast("long")
    rows, known, low, high = entries.agg(F.count("*"), F.count(value), F.min(value), F.max(value)).first()
    if not rows:
        return entries
    place = mixed_seed(seed) % rows
    if place >= known:
        return entries.where("entry IS NULL").limit(1)
    shift = 0
    while (high >> shift) - (low >> shift) > 1 << PICK_BITS:
        shift += PICK_BITS
    while True:
        counts = entries.where(value.between(low, high)).groupBy(F.shiftright(value, shift).alias("upper")).agg(F.count("*").alias("n")).collect()
        for upper, n in sorted(counts):
            if place < n:
                break
            place -= n
        low, high = upper << shift, (upper + 1 << shift) - 1
        if not shift:
            return entries.where(value == low).limit(1)
        shift -= PICK_BITS

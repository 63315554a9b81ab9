"""Ranked titles: build, suggest, exact hits, fall-back to shorter prefixes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def title_rows(*parts: DataFrame) -> DataFrame:
    """Articles, redirects and section redirects ``(title, entry, target)`` as one table."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def build_titles(rows: DataFrame, inbound: DataFrame, norm: Column | None = None) -> DataFrame:
    """``(norm, norm_bytes, title, entry, target, score)``, one row a (norm, entry), blank keys dropped.

    ``norm`` may be given where the normal form is known; else the Arrow function makes it.
    """
    keyed = rows.withColumn("norm", text.normalize("title") if norm is None else norm).where("norm <> ''")
    once = keyed.groupBy("norm", "entry").agg(F.min(F.struct("target", "title")).alias("f")).select("norm", "entry", "f.target", "f.title")
    scored = once.join(inbound.select(F.col("node").alias("target"), F.col("inbound").alias("score")), "target", "left")
    return scored.select("norm", F.octet_length("norm").alias("norm_bytes"), "title", "entry", "target", F.coalesce("score", F.lit(0)).alias("score"))


def write_titles(titles: DataFrame, path: str) -> None:
    """Sorted by key, so that a prefix reads few row groups."""
    titles.repartitionByRange("norm").sortWithinPartitions("norm", "entry").write.mode("overwrite").parquet(path)


def best_per_target(hits: DataFrame, prefix: Column, by: list[str] | None = None) -> DataFrame:
    """The title that stands for each target: exact, then its own, then the shortest, then the first."""
    exact = F.col("norm") == prefix
    order = Window.partitionBy(*(by or []), "target").orderBy(F.desc("__exact"), (F.col("entry") == F.col("target")).desc(), "norm_bytes", "norm", "entry")
    return hits.withColumn("__exact", exact).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n").withColumnRenamed("__exact", "exact")


SHOWN = ("target", "title", "score", "exact")


def ranked() -> tuple:
    return F.desc("exact"), F.desc("score"), "norm_bytes", "target"


def hits(titles: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """``(target, entry, title, score, exact)``: best titles that begin with ``query``; none for a blank query or limit."""
    prefix = text.normalized_prefix(query)
    if not prefix or limit <= 0:
        return titles.limit(0).select("target", "entry", "title", "score", F.lit(False).alias("exact"))
    found = best_per_target(titles.where(F.col("norm").startswith(prefix)), F.lit(prefix))
    return found.orderBy(*ranked()).limit(limit).select("target", "entry", "title", "score", "exact")


def suggest(titles: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """``(target, title, score, exact)`` of ``hits``."""
    return hits(titles, query, limit).select(*SHOWN)


def decorated(found: DataFrame, entry_titles: DataFrame, stubs: DataFrame) -> DataFrame:
    """Suggestions for a reader: ``(article, title, matched, fragment, inbound, exact)``, best first.

    ``found`` are the few rows that ``hits`` has left by its limit; they look up the article's own
    title in ``entry_titles (entry, title)`` and, where the title that matched is another entry's,
    the section if that entry is a section redirect of ``stubs (stub, fragment)``, a row a stub.
    An article that has several titles of its own there comes once with each, in their order.
    """
    own = entry_titles.select(F.col("entry").alias("target"), F.col("title").alias("own"))
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("exact"), F.desc("score"), F.octet_length("title"), "target")))
    ranked = ranked.select("rank", "target", "entry", "title", "score", "exact")
    led = stubs.select(F.col("stub").alias("entry"), "fragment")
    joined = ranked.join(own, "target", "left").join(led, "entry", "left")
    matched = F.when(F.col("entry") != F.col("target"), F.col("title"))
    shown = joined.select("rank", "own", F.col("target").alias("article"), F.coalesce("own", "title").alias("title"), matched.alias("matched"), "fragment", F.col("score").alias("inbound"), "exact")
    return shown.orderBy("rank", "own").drop("rank", "own")


def suggest_many(titles: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """``suggest`` for a table of ``(prefix)``, as one job.

    Titles and prefixes meet on the first ``least`` characters of the key (all shorter prefixes by
    their own length), so nothing is compared with every title.
    """
    lengths = [r["n"] for r in queries.select(F.char_length("prefix").alias("n")).where("n > 0").distinct().limit(201).collect()]
    if len(lengths) > 200:
        raise ValueError("prefixes are at most 200 characters long")
    heads = titles.withColumn("prefix", F.explode(F.array(*[F.left("norm", F.lit(n)) for n in lengths]) if lengths else F.array().cast("array<string>")))
    met = heads.where(F.char_length("prefix").isin(lengths)).distinct().join(queries.select("prefix").distinct(), "prefix")
    best = best_per_target(met, F.col("prefix"), ["prefix"])
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("exact"), F.desc("score"), "norm_bytes", "target"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit).select("prefix", "rank", *SHOWN)


def has_exact(titles: DataFrame, query: str) -> bool:
    """Whether a title has just this key; a query with control characters never has."""
    if any(ord(c) < 32 or 127 <= ord(c) < 160 for c in query):
        return False
    key = text.normalized(query)
    return bool(key) and not titles.where(F.col("norm") == key).limit(1).isEmpty()


def shorter_prefixes(query: str) -> list[str]:
    """The query as typed and the shorter ones to try: five characters less, two thirds, three characters at least."""
    n = len(query)
    least = max(n - 5, math.ceil(2 * n / 3), 3)
    return [query, *(query[:k] for k in range(n - 1, least - 1, -1))]


def fallback_hits(titles: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """``hits`` of the longest of ``shorter_prefixes`` that has any, with that ``prefix`` (null if it is the query); one job."""
    keys = {typed: key for typed in shorter_prefixes(query) if (key := text.normalized_prefix(typed))}
    if not keys or limit <= 0:
        return hits(titles, "", limit).withColumn("prefix", F.lit(None).cast("string"))
    shortest = min(keys.values(), key=len)
    named = F.array(*[F.struct(F.lit(len(typed)).alias("n"), F.lit(key).alias("key"), F.lit(typed).alias("typed")) for typed, key in keys.items()])
    begun = titles.where(F.col("norm").startswith(shortest)).withColumn("try", F.array_max(F.filter(named, lambda t: F.col("norm").startswith(t["key"]))))
    longest = begun.agg(F.max("try.n").alias("most"))
    kept = begun.join(F.broadcast(longest), F.col("try.n") == F.col("most"))  # one row
    best = best_per_target(kept.withColumns({"key": F.col("try.key"), "typed": F.col("try.typed")}).drop("try", "most"), F.col("key"))
    prefix = F.when(F.col("typed") != query, F.col("typed")).alias("prefix")
    return best.orderBy(*ranked()).limit(limit).select("target", "entry", "title", "score", "exact", prefix)


def suggest_with_fallback(titles: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """``(target, title, score, exact, prefix)`` of ``fallback_hits``."""
    return fallback_hits(titles, query, limit).select(*SHOWN, "prefix")


def exact_elsewhere(titles: DataFrame, active: str, key: str, most: int = 3) -> DataFrame:
    """Other collections ``(collection, position)`` that hold a title of just this key, in load order."""
    others = titles.where((F.col("collection") != active) & (F.col("norm") == key))
    return others.groupBy("collection").agg(F.min("position").alias("position")).orderBy("position", "collection").limit(most)


def alternative_titles(aliases: DataFrame) -> DataFrame:
    """``(target, alt_titles)``: titles of redirects ``(target, position, title)``, a line each."""
    lines = F.array_sort(F.collect_list(F.struct("position", "title")))
    return aliases.groupBy("target").agg(lines.alias("l")).select("target", F.array_join(F.col("l.title"), "\n").alias("alt_titles"))

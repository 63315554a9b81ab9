"""Queries over a built index: resolve, suggest, search, read, links."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import document, fulltext, render, sections, titles
from . import build

PAGE, MOST_QUERY = 6000, 200
#: Rows by default and at most, by the surface that shows them.
LIMITS = {"command": (10, 100), "web search": (30, 50), "web suggest": (12, 50), "tool": (8, 20), "reader titles": (12, 12), "reader texts": (30, 30)}


def limit_for(surface: str, asked: int | None = None) -> int:
    """Rows to show: the surface's default, or what was asked for within 1 and its maximum."""
    default, most = LIMITS[surface]
    return default if asked is None else max(1, min(asked, most))


class NoSection(KeyError):
    """A section that a document has not; the message holds its numbered outline."""

    def __str__(self) -> str:
        return self.args[0]


@dataclass
class Resolution:
    """An article (and a section of it), or what comes close."""

    entry: int | None = None
    fragment: str | None = None
    suggestions: list | None = None
    prefix: str | None = None


class Library:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.meta = build.read_meta(spark, path)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @cached_property
    def titles(self) -> DataFrame:
        return self.table("titles")

    @property
    def article_count(self) -> int:
        return self.meta["articles"]

    def _decorated(self, found: DataFrame) -> DataFrame:
        return titles.decorated(found, self.table("entries"), self.table("stubs"))

    def suggest(self, query: str, limit: int = 10) -> DataFrame:
        """``(article, title, matched, fragment, inbound, exact)``, best first."""
        return self._decorated(titles.hits(self.titles, _bounded(query), limit))

    def suggest_with_fallback(self, query: str, limit: int = 10) -> tuple[list, str | None]:
        """Suggestions, and the shorter prefix that they begin with if nothing begins with the query."""
        found = titles.fallback_hits(self.titles, _bounded(query), limit).collect()
        rows = self.spark.createDataFrame([tuple(r)[:5] for r in found], "target long, entry long, title string, score long, exact boolean")
        return self._decorated(rows).collect(), found[0]["prefix"] if found else None

    def has_exact(self, query: str) -> bool:
        return titles.has_exact(self.titles, _bounded(query))

    def find(self, path: str) -> tuple[int, str | None] | None:
        """Entry and fragment that a path leads to, through redirects and section redirects."""
        hit = self.table("paths").where(F.col("path") == path).select("entry")
        row = hit.join(self.table("stubs"), F.col("entry") == F.col("stub"), "left").select(F.coalesce("target", "entry").alias("entry"), "fragment").first()
        return (row["entry"], row["fragment"]) if row else None

    def article(self, entry: int) -> dict | None:
        row = self.table("documents").where(F.col("entry") == entry).first()
        return row.asDict(recursive=True) if row else None

    def is_article(self, entry: int) -> bool:
        return not self.table("documents").where(F.col("entry") == entry).limit(1).isEmpty()

    def resolve_title(self, query: str, limit: int = 5) -> Resolution:
        """A path of this name, else a title of just this key, else suggestions; never the closest guess."""
        found = self.find(_bounded(query).replace(" ", "_"))
        if found and self.is_article(found[0]):
            return Resolution(*found)
        best = self.suggest(query, 1).first()
        if best and best["exact"]:
            return Resolution(best["article"], best["fragment"])
        close, prefix = self.suggest_with_fallback(query, limit)
        return Resolution(suggestions=close, prefix=prefix)

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """``(article, title, summary, score)``; texts are fetched for the rows that are left."""
        hits = fulltext.search(self.table("postings"), self.table("stats"), self.table("inbound"), _bounded(query), limit)
        # The few hits are joined as they are; Spark broadcasts them if they are as small as they should be.
        shown = hits.join(self.table("documents").select("entry", "summary"), "entry")
        own = self.table("entries").select("entry", "title")
        return shown.join(own, "entry").select(F.col("entry").alias("article"), "title", "summary", "score").orderBy(F.desc("score"), "article")

    def blended(self, query: str, limit: int = 8) -> list[dict]:
        """Titles first, then texts that are none of them; texts are not searched once titles fill the limit."""
        if not query.strip():
            raise ValueError("an empty query")
        rows = [{"article": r["article"], "title": r["title"], "matched": r["matched"], "summary": None} for r in self.suggest(query, limit).collect()]
        if len(rows) < limit:
            seen = {r["article"] for r in rows}
            rows += [{"article": r["article"], "title": r["title"], "matched": None, "summary": r["summary"]} for r in self.search(query, limit).collect() if r["article"] not in seen]
        return rows[:limit]

    def titles_and_texts(self, query: str, most_titles: int = 12, most_texts: int = 30) -> DataFrame:
        """Suggestions and then search results ``(kind, article, title)``, an article in both twice."""
        first = self.suggest(query, most_titles).select(F.lit("title").alias("kind"), "article", "title")
        return first.unionByName(self.search(query, most_texts).select(F.lit("text").alias("kind"), "article", "title"))

    def _opened(self, entry: int, section: str | None, fragment: str | None) -> tuple[dict, int | None]:
        """A document and the section asked for: by number, anchor or heading; a fragment only by the last two."""
        doc = self.article(entry)
        if doc is None:
            raise KeyError(entry)
        if section is None:
            return doc, None if fragment is None else section_at(doc, fragment, False)
        at = section_at(doc, section, True)
        if at is None and section.lower() != "outline":
            lines = [f'no section "{text.sanitized(section)}" in "{text.sanitized(doc["title"])}" ({len(doc["sections"])} sections):', *render.outline_lines(doc, True)]
            raise NoSection("\n".join(lines))
        return doc, at

    def links(self, entry: int, section: str | None = None, fragment: str | None = None) -> DataFrame:
        """Linked articles of a document, or of one section and all below it, each at its first place."""
        return sections.first_seen(self._mine(entry, section, fragment).where("kind = 'article'").select(F.col("src").alias("doc"), "target", "pos"))

    def link_counts(self, entry: int, section: str | None = None, fragment: str | None = None) -> DataFrame:
        return sections.link_counts(self._mine(entry, section, fragment).withColumnRenamed("src", "doc"))

    def _mine(self, entry: int, section: str | None, fragment: str | None) -> DataFrame:
        mine = self.table("links").where(F.col("src") == entry)
        if section is None and fragment is None:
            return mine
        doc, at = self._opened(entry, section, fragment)
        if at is None:
            return mine
        within = document.subtree(doc["sections"], at)
        places = [n for n, link in enumerate(doc["links"]) if link["section"] in within]  # ``pos`` counts a document's links
        return mine.where(F.col("pos").between(places[0], places[-1])) if places else mine.limit(0)

    def read(self, entry: int, section: str | None = None, offset: int = 0, fragment: str | None = None) -> str:
        """An overview, a numbered outline, or pages of a section with all below it.

        ``section`` is what a reader asks for and may be a number of the outline; one that the
        document has not is an error. ``fragment`` is where a redirect leads, never a number;
        one that the document has not gives the overview. A heading called Outline comes before
        the outline.
        """
        doc, at = self._opened(entry, section, fragment)
        if at is None:
            return render.overview(doc) if section is None else "\n".join(render.outline_lines(doc, True))
        body = text.sanitized("".join(document.section_text(doc["sections"][i]) for i in document.subtree(doc["sections"], at)))
        page = body[offset : offset + PAGE]
        return page + (f"\n[{offset + PAGE} of {len(body)} characters]" if offset + PAGE < len(body) else "")

    def html(self, entry: int) -> str:
        """The page; links lead to the paths of the entries they were resolved to."""
        doc = self.article(entry)
        own = self.table("links").where((F.col("src") == entry) & (F.col("kind") == "article")).select("path", F.col("target").alias("entry")).distinct()
        found = {r["path"]: r["to"] for r in own.join(self.table("entries").select("entry", F.col("path").alias("to")), "entry").collect()}
        return render.document_html(doc, found.get)

    def random(self, seed: int) -> int | None:
        row = sections.random_article(self.table("documents").select("entry"), seed).first()
        return row["entry"] if row else None


def section_at(doc: dict, wanted: str, numbers: bool) -> int | None:
    """Place of the section with this number (if ``numbers``), anchor or heading."""
    if numbers and wanted.isascii() and wanted.isdigit() and int(wanted) < len(doc["sections"]):
        return int(wanted)
    heading = wanted.replace("_", " ").lower()
    return next((n for n, s in enumerate(doc["sections"]) if s["anchor"] == wanted or s["heading"].lower() == heading), None)


def search_head(shown: int, limit: int, query: str, label: str | None = None, elsewhere: list[str] | None = None) -> str:
    """First line over search results. It never claims a total; without a hit it names the next step."""
    subject = f'"{text.sanitized(query)}"' + (f" in {label}" if label else "")
    if not shown and elsewhere:
        have = "has" if len(elsewhere) == 1 else "have"
        return f'Nothing for {subject}; {", ".join(elsewhere)} {have} a page of just this title: read it with collection="{elsewhere[0]}"'
    if not shown:
        return f"Nothing for {subject}; try other words, or fewer"
    return f"{shown} for {subject}" + ("; there may be more, ask for a higher limit" if shown == limit else "")


def redirect_note(requested: str, title: str) -> bool:
    """Whether a reader should be told that another title was asked for."""
    return text.normalized(requested) != text.normalized(title)


def _bounded(query: str) -> str:
    if len(query) > MOST_QUERY:
        raise ValueError(f"queries have at most {MOST_QUERY} characters")
    return query

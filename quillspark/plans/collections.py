"""Sets of collections: opened by their metadata alone, each index only when it is used."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import SparkSession

from ..functions import text
from ..operators import catalog
from ..operators.document import short
from ..sources.archive import Archive
from . import build
from .library import Library, limit_for, search_head


class Collection:
    """One index folder and, where it is known, the archive it was built from."""

    def __init__(self, spark: SparkSession, index: str, archive: str | None = None):
        self.spark, self.index, self.archive = spark, index, archive
        self.meta = build.read_meta(spark, index)
        self._failed: Exception | None = None

    @property
    def label(self) -> str:
        """As recorded; older indexes ask their archive."""
        if not self.meta.get("label") and self.archive:
            return (Archive(self.archive).metadata("Name") or "").partition("_")[0].lower()
        return self.meta.get("label") or ""

    @cached_property
    def _library(self) -> Library:
        if self.archive:
            file = Archive(self.archive)
            if (file.uuid.hex(), file.size) != (self.meta.get("uuid"), self.meta.get("source_bytes")):
                raise ValueError("the index belongs to another file")
        return Library(self.spark, self.index)

    def library(self) -> Library:
        """The library, opened on first use; a failure is remembered."""
        if self._failed:
            raise self._failed
        try:
            return self._library
        except Exception as e:
            self._failed = e
            raise


def open_collections(spark: SparkSession, given: dict[str, str | None], default: str | None = None, any_producer: bool = True) -> catalog.Catalog:
    """A catalog of index folders (with their archives); what cannot be used is skipped with a reason.

    Unless ``any_producer``, an index that records another program than the known one is skipped.
    """
    out = catalog.Catalog()
    usable: list[tuple[str, Collection]] = []
    for index, archive in given.items():
        try:
            if not build._exists(spark, f"{index}/meta"):
                out.skip(index, "not imported", "no index")
                continue
            one = Collection(spark, index, archive)
            if not any_producer and not (one.meta.get("scraper") or "").lower().startswith(catalog.PRODUCER):
                out.skip(index, "wrong producer", f"made by {one.meta.get('scraper') or 'an unknown program'}")
                continue
            usable.append((index, one))
        except Exception as e:  # noqa: BLE001 - told per collection
            out.skip(index, "unusable", str(e).splitlines()[0])
    for index, one in usable:
        label = one.label
        fits = bool(label) and len(label) <= 24 and label[0].isalpha() and label[-1] != "-" and label.replace("-", "a").isalnum() and label.isascii()
        if not fits and len(usable) > 1:
            out.skip(index, "unusable", f"label {label!r}")
        else:
            out.add(index, label, one, usable=len(usable) > 1)
    if not out.loaded:
        raise ValueError("no collection can be used: " + "; ".join(" ".join(s) for s in out.skipped))
    if default is not None:
        if default not in out.loaded:
            raise KeyError(f"no collection {default!r}; loaded: {', '.join(out.loaded)}")
        out.default = default
    return out


def elsewhere(found: catalog.Catalog, active: str, query: str, most: int = 3) -> list[str]:
    """Labels of other collections that have a title of just this key, in load order."""
    hits = []
    for label, one in found.loaded.items():
        if label != active and len(hits) < most and one.library().has_exact(query):
            hits.append(label)
    return hits


def summary(found: catalog.Catalog) -> str:
    lines = [f"{label}: {c.meta.get('title') or c.meta['name']} ({c.meta['articles']:,} articles)" for label, c in found.loaded.items()]
    return "\n".join(lines + [f"skipped {path}: {kind}: {why}" for path, kind, why in found.skipped])


#: Around text of articles, which must not be able to close it.
FENCE = ("<article-text>", "</article-text>")


def fenced(line: str) -> str:
    return FENCE[0] + text.defused(text.sanitized_line(line), *FENCE) + FENCE[1]


def search_text(found: catalog.Catalog, query: str, limit: int | None = None, label: str | None = None) -> str:
    """Search results of a collection as lines of text; text of articles is fenced."""
    limit = limit_for("tool", limit)
    rows = found.select(label).library().blended(query, limit)
    active = label or found.default
    others = [] if rows else elsewhere(found, active, query)
    lines = [search_head(len(rows), limit, query, active if len(found.loaded) > 1 else None, others)]
    for r in rows:
        more = f" via {fenced(r['matched'])}" if r["matched"] else f": {fenced(short(r['summary'], 160))}" if r["summary"] else ""
        lines.append(fenced(r["title"]) + more)
    return "\n".join(lines)

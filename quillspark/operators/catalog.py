"""Collections: which files count, under which label, and why others do not."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# First path segments that pages of the reader itself use.
RESERVED = ("api", "random", "search", "static", "wiki")
PRODUCER = "mwoffliner"


def right_producer(scraper: Column) -> Column:
    return F.coalesce(F.lower(scraper).startswith(PRODUCER), F.lit(False))


def judge_labels(names: DataFrame) -> DataFrame:
    """``names (position, name)`` with ``label`` and ``reason``: null where the collection can be used.

    Unusable labels count as reasons only where several collections need telling apart.
    """
    label = text.label_of(F.col("name"))
    marked = names.withColumn("label", label).withColumn("__ok", F.coalesce(text.is_label(label), F.lit(False)))
    first = F.row_number().over(Window.partitionBy("label").orderBy("position"))
    alone = F.lit(names.count() == 1)
    reason = F.when(alone, F.lit(None)).when(~F.col("__ok"), "unusable").when(F.col("label").isin(*RESERVED), "reserved").when(first > 1, "duplicate")
    return marked.withColumn("reason", reason).drop("__ok")


def same_files(given: DataFrame) -> DataFrame:
    """One of the names ``(position, canonical, imported)`` of each file: an imported one, else the first."""
    first = F.row_number().over(Window.partitionBy("canonical").orderBy(F.desc("imported"), "position"))
    return given.withColumn("__n", first).where("__n = 1").drop("__n")


@dataclass
class Catalog:
    """Loaded collections by label, in load order, and what was skipped."""

    loaded: dict[str, object] = field(default_factory=dict)
    skipped: list[tuple[str, str, str]] = field(default_factory=list)
    default: str | None = None

    def add(self, path: str, label: str, library: object, usable: bool = True) -> None:
        if label in self.loaded:
            self.skip(path, "duplicate", f"label {label} is taken")
            return
        if usable and label in RESERVED:
            self.skip(path, "unusable", f"label {label} is reserved")
            return
        self.loaded[label] = library
        self.default = self.default or label

    def skip(self, path: str, kind: str, why: str) -> None:
        self.skipped.append((text.sanitized_line(path.rsplit("/", 1)[-1]), kind, text.sanitized_line(why)))

    def select(self, label: str | None = None) -> object:
        """An explicit label, else the default; an unknown one names what is loaded."""
        chosen = label or self.default
        if chosen not in self.loaded:
            raise KeyError(f"no collection {chosen!r}; loaded: {', '.join(self.loaded) or 'none'}")
        return self.loaded[chosen]

    def split(self, identifier: str) -> tuple[str | None, str]:
        """``label/Title`` if the label is loaded; a title may hold slashes itself."""
        head, slash, rest = identifier.partition("/")
        return (head, rest) if slash and head in self.loaded else (None, identifier)

"""Building a collection's index: from an archive's entries, or a table of pages, to Parquet tables.

    entries -> paths -> section redirects -> documents -> links -> in-links -> titles, postings

Tables are written to a folder beside the final one, which takes its place when all are
there; ``meta`` comes last, so a half-built index is never opened.
"""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, document, fulltext, graph, titles
from ..operators.lineage import settled

FORMAT = 1
TABLES = ("entries", "paths", "documents", "links", "inbound", "stubs", "titles", "postings", "stats")
#: What a refresh names: the first ``url=`` after it, up to a quote or the end of the tag.
REFRESH = r"""(?is)http-equiv=(?:"refresh"|'refresh').*?url=['" ]*([^'">]*)['">]"""


class WrongProducer(ValueError):
    pass


def stub_href(html: Column) -> Column:
    """Where a page of at most 4096 bytes of valid UTF-8 that refreshes to another one leads; null for any other page.

    ``html`` may be bytes or a string. Quotes around the address, of either kind or none, do not belong to it.
    """
    page = F.try_validate_utf8(html.cast("string"))
    href = F.trim(F.regexp_extract(page, REFRESH, 1))
    return F.when((F.octet_length(page) <= 4096) & (href != ""), href)


def page_entries(pages: DataFrame) -> DataFrame:
    """``pages (page_id, url, html)`` as content entries whose path is that of the URL."""
    path = F.regexp_replace(F.col("url"), "^[^:]*://[^/]*/?", "")
    return pages.select(F.col("page_id").alias("entry"), F.lit("C").alias("namespace"), path.alias("path"), path.alias("title"), F.lit("content").alias("kind"), F.lit("text/html").alias("mime"), F.lit(None).cast("long").alias("redirect_target"), F.col("html").cast("binary").alias("content"))


def parts(entries: DataFrame, front: DataFrame | None = None, stem: bool = False) -> dict[str, DataFrame]:
    """The index tables of ``entries``; ``front (entry)`` names what may be an article."""
    known = entries if front is None else entries.join(front, "entry", "left_semi")
    pages = known.where("kind = 'content' AND mime = 'text/html'").select("entry", "path", "title", F.expr("make_valid_utf8(cast(content AS string))").alias("html"), "content")
    paths = settled(graph.path_targets(entries))
    leads = pages.withColumn("__l", text.classify_href(stub_href(F.col("content")), F.col("path"))).where("__l.kind = 'internal'")
    found = leads.select(F.col("entry").alias("stub"), F.col("__l.path").alias("path"), F.col("__l.fragment").alias("fragment")).join(paths.withColumnRenamed("entry", "target"), "path")
    found = settled(found)
    stubs = settled(graph.collapse_stubs(found.select("stub", "target", "fragment")))
    articles = pages.join(found.select(F.col("stub").alias("entry")), "entry", "left_anti")
    documents = settled(document.parse_documents(articles))
    links = document.link_rows(documents)
    inside = settled(graph.resolve_links(links.where("kind = 'internal'"), paths, stubs))
    resolved = inside.select("src", "pos", F.when(F.col("target").isNull(), "missing").otherwise("article").alias("kind"), "target", "path", "fragment", "url", "text")
    others = links.where("kind <> 'internal'").select("src", "pos", "kind", F.lit(None).cast("long").alias("target"), "path", "fragment", "url", "text")
    resolved = settled(resolved)
    edges = resolved.where("target IS NOT NULL").select("src", F.col("target").alias("dst"))
    ids = documents.select(F.col("entry").alias("node"))
    inbound = settled(graph.inbound_links(edges, entries.select(F.col("entry").alias("node"))))
    redirects = known.where("kind = 'redirect'").select("title", "entry").join(graph.resolve_redirects(entries.where("kind = 'redirect'").select("entry", F.col("redirect_target").alias("target"))), "entry")
    follow = lambda df: df.join(stubs.select(F.col("stub").alias("target"), F.col("target").alias("__t")), "target", "left").withColumn("target", F.coalesce("__t", "target")).drop("__t").join(ids.withColumnRenamed("node", "target"), "target", "left_semi")
    rows = titles.title_rows(articles.select("title", "entry", F.col("entry").alias("target")), follow(redirects).select("title", "entry", "target"), pages.select("title", F.col("entry").alias("stub")).join(stubs, "stub").select("title", F.col("stub").alias("entry"), "target"))
    aliases = titles.alternative_titles(rows.where("entry <> target").select("target", F.col("entry").alias("position"), "title"))
    searched = documents.select("entry", "title", "body").join(aliases.select(F.col("target").alias("entry"), "alt_titles"), "entry", "left")
    posted = settled(fulltext.postings(searched, stem=stem))
    return {"paths": paths, "documents": documents, "links": resolved.unionByName(others), "inbound": inbound, "stubs": stubs, "titles": titles.build_titles(rows, inbound), "postings": posted, "stats": fulltext.field_stats(posted, documents.select("entry")), "entries": entries.drop("content")}


def build_index(spark: SparkSession, entries: DataFrame, out: str, front: DataFrame | None = None, scraper: str | None = None, name: str = "", any_producer: bool = True, stem: bool = False, source: dict | None = None) -> dict:
    """Write the index of ``entries`` to ``out`` and return its counters."""
    if not any_producer and not (scraper or "").lower().startswith(catalog.PRODUCER):
        raise WrongProducer(f"made by {scraper or 'an unknown program'}")
    staging = f"{out.rstrip('/')}.partial"
    _delete(spark, staging)
    made = parts(entries, front, stem)
    for table in TABLES:
        if table == "paths":
            made[table].repartitionByRange("path").sortWithinPartitions("path").write.mode("overwrite").parquet(f"{staging}/{table}")
        elif table in ("documents", "entries"):
            made[table].repartitionByRange("entry").sortWithinPartitions("entry").write.mode("overwrite").parquet(f"{staging}/{table}")
        elif table == "titles":
            titles.write_titles(made[table], f"{staging}/{table}")
        elif table == "postings":
            made[table].repartitionByRange("term").sortWithinPartitions("term", "entry").write.mode("overwrite").parquet(f"{staging}/{table}")
        else:
            made[table].write.mode("overwrite").parquet(f"{staging}/{table}")
    read = lambda t: spark.read.parquet(f"{staging}/{t}")
    links = read("links")
    meta = (source or {}) | {
        "format": FORMAT, "built": int(time.time()), "name": name, "scraper": scraper, "label": re.sub("_.*", "", name).lower() or None,
        "articles": read("documents").count(), "section_redirects": read("stubs").count(), "title_keys": read("titles").count(),
        "redirects": read("titles").where("entry <> target").count() - read("titles").join(read("stubs"), F.col("entry") == F.col("stub"), "left_semi").count(),
        **links.where("kind IN ('article', 'missing')").agg(F.count_if((F.col("kind") == "article") & (F.col("target") != F.col("src"))).alias("internal_links"), F.count_if(F.col("kind") == "missing").alias("missing_links")).first().asDict(),
    }
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{staging}/meta")
    _delete(spark, out)
    _rename(spark, staging, out)
    return meta


def build_archive(spark: SparkSession, path: str, out: str, any_producer: bool = False, stem: bool = False) -> dict:
    """The index of one archive file."""
    from ..sources.archive import Archive, read_archive

    archive = Archive(path)
    scraper, name = archive.metadata("Scraper"), archive.metadata("Name") or ""
    entries = settled(read_archive(spark, path, archive.article_namespace))
    front = spark.read.format("archive").option("table", "front").load(path)
    return build_index(spark, entries.drop("cluster", "blob", "raw_title", "namespace"), out, front, scraper, name, any_producer, stem, {"uuid": archive.uuid.hex(), "source_bytes": archive.size, "title": archive.metadata("Title")})


def build_all(spark: SparkSession, files: list[str], out: str, force: bool = False, any_producer: bool = False) -> dict[str, dict | Exception]:
    """Each file's index in its own folder of ``out``; what is built stays, and one failure does not stop the rest."""
    results: dict[str, dict | Exception] = {}
    for path in files:
        to = f"{out.rstrip('/')}/{path.rsplit('/', 1)[-1].rsplit('.', 1)[0]}"
        try:
            results[path] = read_meta(spark, to) if not force and _exists(spark, f"{to}/meta") else build_archive(spark, path, to, any_producer)
        except Exception as e:  # noqa: BLE001 - told per file
            results[path] = e
    return results


def read_meta(spark: SparkSession, path: str) -> dict:
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    if meta.get("format") != FORMAT:
        raise ValueError(f"index format {meta.get('format')}, not {FORMAT}")
    return meta


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    system, p = _fs(spark, path)
    return system.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    system, p = _fs(spark, path)
    system.delete(p, True)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    system, p = _fs(spark, old)
    if not system.rename(p, _fs(spark, new)[1]):
        raise OSError(f"{old} could not become {new}")


def index_bytes(spark: SparkSession, path: str) -> int:
    system, p = _fs(spark, path)
    return system.getContentSummary(p).getLength()

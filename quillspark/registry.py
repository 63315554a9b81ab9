"""Every query of the library by name, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text
from .operators import catalog, document, fulltext, graph, sections, titles
from .operators.lineage import settled
from .plans import build

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
W = text.SPACE


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders link to the parts in them; a part that has the order's number is a self-link."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))


def part_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("title"))
    inbound = graph.inbound_links(part_edges(spark, sf_dir), parts.select("node"))
    rows = parts.select("title", F.col("node").alias("entry"), F.col("node").alias("target"))
    return titles.build_titles(rows, inbound)


INBOUND = """
SELECT p_partkey AS node, count(DISTINCT l_orderkey) AS inbound
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_orderkey <> l_partkey GROUP BY p_partkey
"""


@query(INBOUND)
def inbound_links(spark, sf_dir):
    return graph.inbound_links(part_edges(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")))


@query("""
SELECT count(*) FILTER (WHERE p_partkey IS NOT NULL AND p_partkey <> l_orderkey) AS internal_links,
       count(*) FILTER (WHERE p_partkey IS NULL) AS missing_links
FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) ON l_partkey = p_partkey
""")
def link_totals(spark, sf_dir):
    known = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("dst"), F.col("p_partkey").alias("target"))
    return graph.link_totals(part_edges(spark, sf_dir).join(known, "dst", "left"))


def _pointers(spark, sf_dir):
    k = F.col("p_partkey")
    step = F.when(k % 3 == 0, F.expr("p_partkey div 3")).when(k % 7 == 1, k + 6).when(k % 11 == 5, k)
    return table(spark, sf_dir, "part").select(k.alias("entry"), step.alias("target")).where("target IS NOT NULL")


POINTERS = """
p AS (SELECT p_partkey AS entry, CASE WHEN p_partkey % 3 = 0 THEN p_partkey // 3 WHEN p_partkey % 7 = 1 THEN p_partkey + 6
        WHEN p_partkey % 11 = 5 THEN p_partkey END AS target FROM part),
q AS (SELECT * FROM p WHERE target IS NOT NULL)
"""


@query(f"""
WITH RECURSIVE {POINTERS}, c AS (
  SELECT entry, target AS place, 1 AS hops FROM q
  UNION ALL SELECT c.entry, q.target, hops + 1 FROM c JOIN q ON q.entry = c.place WHERE hops < 50
)
SELECT entry, place AS target FROM c WHERE hops <= 49 AND place NOT IN (SELECT entry FROM q)
""")
def redirect_chain(spark, sf_dir):
    return graph.resolve_redirects(_pointers(spark, sf_dir))


@query(f"""
WITH RECURSIVE {POINTERS}, f AS (
  SELECT entry, target, CASE WHEN entry % 2 = 0 THEN 'part ' || entry END AS fragment FROM q
), c AS (
  SELECT entry, target AS place, 1 AS hops, fragment FROM f
  UNION ALL SELECT c.entry, f.target, hops + 1, coalesce(c.fragment, f.fragment) FROM c JOIN f ON f.entry = c.place WHERE hops < 9
)
SELECT entry AS stub, place AS target, fragment FROM c WHERE hops <= 8 AND place NOT IN (SELECT entry FROM f)
""")
def stub_fragment_chain(spark, sf_dir):
    name = F.when(F.col("entry") % 2 == 0, F.concat(F.lit("part "), F.col("entry")))
    return graph.collapse_stubs(_pointers(spark, sf_dir).select(F.col("entry").alias("stub"), "target", name.alias("fragment")))


@query(f"""
WITH RECURSIVE {POINTERS}, links AS (
  SELECT l_orderkey AS src, l_partkey AS dst, CASE WHEN l_linenumber = 1 THEN 'line' END AS fragment FROM lineitem
), stubs AS (SELECT entry AS stub, target, 'sec ' || entry AS fragment FROM q WHERE target NOT IN (SELECT entry FROM q)),
paths AS (SELECT p_partkey AS path FROM part WHERE p_size <> 7)
SELECT src, dst, coalesce(s.target, p.path) AS target, coalesce(l.fragment, s.fragment) AS fragment
FROM links l LEFT JOIN paths p ON p.path = l.dst LEFT JOIN stubs s ON s.stub = p.path
""")
def link_resolution(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("path"), F.when(F.col("l_linenumber") == 1, "line").alias("fragment"))
    pointers = _pointers(spark, sf_dir)
    stubs = pointers.join(pointers.select(F.col("entry").alias("target")), "target", "left_anti").select(F.col("entry").alias("stub"), "target", F.concat(F.lit("sec "), "entry").alias("fragment"))
    paths = table(spark, sf_dir, "part").where("p_size <> 7").select(F.col("p_partkey").alias("path"), F.col("p_partkey").alias("entry"))
    return graph.resolve_links(links, paths, stubs).select("src", F.col("path").alias("dst"), "target", "fragment")


TITLES = f"""
t AS (SELECT p_name AS title, trim(regexp_replace(lower(strip_accents(p_name)), '[{W}_]+', ' ', 'g')) AS norm,
             p_partkey AS entry, p_partkey AS target, inbound AS score
      FROM part JOIN ({INBOUND}) ON node = p_partkey)
"""


@query(f"""
WITH {TITLES} SELECT target, title, score, norm = 'red' AS exact FROM t WHERE starts_with(norm, 'red')
ORDER BY exact DESC, score DESC, strlen(norm), target LIMIT 10
""")
def suggest_prefix(spark, sf_dir):
    return titles.suggest(part_titles(spark, sf_dir), "Red", 10)


@query(f"""
WITH {TITLES}, q AS (SELECT DISTINCT left(norm, 3) AS prefix FROM t), h AS (
  SELECT prefix, target, title, score, norm = prefix AS exact,
         row_number() OVER (PARTITION BY prefix ORDER BY norm = prefix DESC, score DESC, strlen(norm), target) AS rank
  FROM t JOIN q ON starts_with(norm, prefix)
)
SELECT prefix, CAST(rank AS INTEGER) AS rank, target, title, score, exact FROM h WHERE rank <= 10
""")
def suggest_batch(spark, sf_dir):
    known = settled(part_titles(spark, sf_dir))
    return titles.suggest_many(known, known.select(F.left("norm", F.lit(3)).alias("prefix")).distinct(), 10)


def _aliases(spark, sf_dir):
    """Parts under their names, and under their brand and type as redirects."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    rows = lambda title, entry: part.select(F.lower(title).alias("title"), entry.alias("entry"), key.alias("target"))
    return titles.title_rows(rows(F.col("p_name"), key), rows(F.concat("p_name", F.lit(" "), "p_brand"), key + 1000000), rows(F.concat("p_brand", F.lit(" "), "p_type"), key + 2000000))


ALIASES = """
a AS (SELECT lower(p_name) AS title, p_partkey AS entry, p_partkey AS target FROM part
      UNION ALL SELECT lower(p_name || ' ' || p_brand), p_partkey + 1000000, p_partkey FROM part
      UNION ALL SELECT lower(p_brand || ' ' || p_type), p_partkey + 2000000, p_partkey FROM part)
"""


@query(f"""
WITH {ALIASES}, r AS (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY title = 'blue' DESC, entry = target DESC, strlen(title), title, entry) AS n
  FROM a WHERE starts_with(title, 'b')
)
SELECT target, entry, title, title = 'blue' AS exact FROM r WHERE n = 1
""")
def suggest_best_per_target(spark, sf_dir):
    rows = _aliases(spark, sf_dir).withColumn("norm", F.col("title")).withColumn("norm_bytes", F.octet_length("title"))
    return titles.best_per_target(rows.where(F.col("norm").startswith("b")), F.lit("blue")).select("target", "entry", "title", "exact")


@query(f"WITH {ALIASES} SELECT count(*) AS title_rows, count(DISTINCT (title, entry)) AS keys, count(DISTINCT title) AS norms FROM a WHERE title <> ''")
def title_union_dedup(spark, sf_dir):
    return _aliases(spark, sf_dir).where("title <> ''").agg(F.count("*").alias("title_rows"), F.countDistinct("title", "entry").alias("keys"), F.countDistinct("title").alias("norms"))


@query(f"""
WITH {TITLES}, tries AS (SELECT unnest(['redx', 'red']) AS prefix),
m AS (SELECT max(length(prefix)) AS n FROM tries JOIN t ON starts_with(norm, prefix))
SELECT target, title, score, norm = prefix AS exact, CASE WHEN prefix <> 'redx' THEN prefix END AS prefix FROM tries, m, t
WHERE length(prefix) = n AND starts_with(norm, prefix) ORDER BY norm = prefix DESC, score DESC, strlen(norm), target LIMIT 10
""")
def prefix_fallback(spark, sf_dir):
    return titles.suggest_with_fallback(part_titles(spark, sf_dir), "redx", 10)


@query(f"""
WITH {ALIASES}, r AS (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY title = 'red' DESC, entry = target DESC, strlen(title), title, entry) AS n
  FROM a WHERE starts_with(title, 'red')
), f AS (SELECT r.*, o.title AS own, coalesce(s.score, 0) AS score FROM r
  JOIN a o ON o.entry = r.target LEFT JOIN (SELECT l_partkey AS target, count(*) AS score FROM lineitem GROUP BY 1) s ON s.target = r.target WHERE n = 1)
SELECT target AS article, own AS title, CASE WHEN entry <> target THEN title END AS matched,
  CASE WHEN entry > 2000000 THEN 'Part ' || (entry % 7) END AS fragment, score AS inbound, title = 'red' AS exact
FROM f ORDER BY title = 'red' DESC, score DESC, strlen(title), target LIMIT 10
""")
def suggest_rows(spark, sf_dir):
    """Suggestions with the article's own title, the alias that matched, and the section it leads to.

    Where keys are a million apart, entries are shared: an article then has several own titles, and
    each makes a row before the limit.
    """
    rows = _aliases(spark, sf_dir)
    score = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("inbound"))
    stubs = rows.where("entry > 2000000").select(F.col("entry").alias("stub"), F.concat(F.lit("Part "), (F.col("entry") % 7).cast("string")).alias("fragment")).distinct()
    return titles.decorated(titles.hits(titles.build_titles(rows, score, norm=F.col("title")), "Red", 10), rows, stubs).limit(10)


#: Addresses that reach every branch: (href, kind, path, fragment, url), seen from the page A/P/Q.
HREFS = (
    ("#Top%20x", "anchor", None, "Top x", None), (" ", None, None, None, None), ("", None, None, None, None), ("//x.org/a", "external", None, None, "//x.org/a"),
    ("HTTPS://x", "external", None, None, "HTTPS://x"), ("mailto:a@b", "external", None, None, "mailto:a@b"), ("a://b", "external", None, None, "a://b"), ("../C/./D?x=1#S%20t", "internal", "A/C/D", "S t", None),
    ("/B/E", "internal", "B/E", None, None), ("a%2Fb#", "internal", "A/P/a/b", None, None), ("../../../x", "internal", "x", None, None), (" R ", "internal", "A/P/R", None, None),
)
#: Pages and where they lead.
STUBS = (
    ('<meta http-equiv="refresh" content="0;url=A#b">', "A#b"), ("<META HTTP-EQUIV='Refresh' CONTENT='0; URL=\"A b\"'>", "A b"), ('<meta http-equiv="refresh" content="0; url=\'A\'">', "A"),
    ('<meta http-equiv="refresh" content=0;url=A>', "A"), ('<meta http-equiv="refresh" content="0">', None), ("<p>url=A</p>", None), ("", None),
)


#: Small pages at the path A/P: (html, title, body, summary, links).
PAGES = (
    ("<h1>Own  title</h1><p>a <b>b</b> <i>c</i></p>", "Own title", "Own title\na b c\n", "a b c", ""),
    ("<p>x<br>y<br><br> z </p>loose <span>text</span>", "T", "T\nx\ny\nz\nloose text\n", "x\ny\nz", ""),
    ("<ul><li>a<ol><li>b</ol><li>c</ul><dl><dt>t<dd>d</dl>", "T", "T\na\nb\nc\nt\nd\n", "", ""),
    ("<blockquote>q</blockquote><pre> code\n x </pre><div class='hatnote'>see</div><p>p</p>", "T", "T\nq\n code\n x\nsee\np\n", "p", ""),
    ("<table class='infobox'><tr><th class='infobox-above'>N<tr><th>Born<td>1867<tr><td>alone</table>", "T", "T\nBorn: 1867\nalone\n", "", ""),
    ("<table><tr><th>1<td>2<tr><td><tr><td>3</table>", "T", "T\n1 | 2 | \n3 | \n", "", ""),
    ("<p>l</p><h2>Gone</h2><h2>Kept</h2><h3 id=d>Deep</h3><p>x</p>", "T", "T\nl\nKept\nDeep\nx\n", "l", ""),
    ("<p>a <a href='B#c%20d'>b</a><a href='#f'> g</a> <a href='https://x.org'>h</a></p>", "T", "T\na b g h\n", "a b g h", "internal A/B c d,anchor  f,external  "),
    ("<p>a<sup class='reference'>1</sup><span style='display: none'>h</span><script>s</script>b</p><div class='navbox'><p>n</p></div>", "T", "T\nab\n", "ab", ""),
    ("<p> </p>", "T", "T\n", "", ""), ("", "T", "T\n", "", ""),
)


def _listed(rows: tuple, *columns: str) -> str:
    said = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) AS v({', '.join(columns)})"


@query(f"SELECT href, kind, path, fragment, url FROM {_listed(HREFS, 'href', 'kind', 'path', 'fragment', 'url')}")
def href_cases(spark, sf_dir):
    """Every kind of address; the twin states the expected rows."""
    rows = spark.createDataFrame([(r[0],) for r in HREFS], "href string")
    link = text.classify_href(F.col("href"), F.lit("A/P/Q"))
    return rows.select("href", *(link[k].alias(k) for k in ("kind", "path", "fragment", "url")))


@query(f"SELECT html, title, body, summary, links FROM {_listed(PAGES, 'html', 'title', 'body', 'summary', 'links')}")
def document_cases(spark, sf_dir):
    """Every kind of block and what is left out; the twin states the expected documents."""
    rows = spark.createDataFrame([(n, "A/P", "T", r[0]) for n, r in enumerate(PAGES)], "entry long, path string, title string, html string")
    links = F.transform("links", lambda x: F.concat_ws(" ", x["kind"], F.coalesce(x["path"], F.lit("")), F.coalesce(x["fragment"], F.lit(""))))
    parsed = document.parse_documents(rows).select("entry", "title", "body", "summary", F.array_join(links, ",").alias("links"))
    return rows.select("entry", "html").join(parsed, "entry").drop("entry")


@query(f"SELECT html, leads FROM {_listed(STUBS, 'html', 'leads')}")
def stub_cases(spark, sf_dir):
    """Every form of a refresh; the twin states the expected rows."""
    return spark.createDataFrame([(r[0],) for r in STUBS], "html string").select("html", build.stub_href(F.col("html")).alias("leads"))


@query(f"""
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(split_part(text, chr(10), 1))), '[{W}_]+', ' ', 'g'), '[\\x00-\\x1f]', '', 'g')) AS norm
FROM documents
""")
def title_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.substring_index("text", "\n", 1)).alias("norm"))


@query("""
WITH f AS (SELECT source AS collection, doc_id AS position, lower(split_part(text, ' ', 1)) AS norm FROM documents),
k AS (SELECT norm FROM f GROUP BY norm ORDER BY count(*) DESC, norm LIMIT 1)
SELECT collection, min(position) AS position FROM f WHERE collection <> 'src0' AND norm IN (SELECT norm FROM k)
GROUP BY collection ORDER BY position, collection LIMIT 3
""")
def exact_elsewhere(spark, sf_dir):
    held = table(spark, sf_dir, "documents").select(F.col("source").alias("collection"), F.col("doc_id").alias("position"), F.lower(F.substring_index("text", " ", 1)).alias("norm"))
    top = held.groupBy("norm").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "norm").first()
    return titles.exact_elsewhere(held, "src0", top["norm"] if top else "")


@query("""
SELECT n_regionkey AS target, string_agg(n_name, chr(10) ORDER BY n_nationkey, n_name) AS alt_titles FROM nation GROUP BY n_regionkey
""")
def alt_titles(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("target"), F.col("n_nationkey").alias("position"), F.col("n_name").alias("title"))
    return titles.alternative_titles(rows)


def _text_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry"), F.substring_index("text", "\n", 1).alias("title"), F.lit("").alias("alt_titles"), F.col("text").alias("body"))


def _bm25(spark, sf_dir, asked):
    docs = _text_docs(spark, sf_dir)
    posted = fulltext.postings(docs, only=fulltext.query_terms(spark, asked))
    inbound = table(spark, sf_dir, "lineitem").where("l_orderkey <> l_partkey").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    linked = graph.inbound_links(inbound, docs.select(F.col("entry").alias("node")))
    return fulltext.search(posted, fulltext.lengths(docs), linked, asked, 10).select("entry", F.round("score", 6).alias("score"))


def _bm25_sql(words: list[str], everything: bool) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""
WITH d AS (SELECT doc_id AS entry, split_part(text, chr(10), 1) AS title, text AS body FROM documents),
f AS (SELECT entry, 'title' AS field, 4.0::DOUBLE AS weight, list_filter(string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) BETWEEN 1 AND 40) AS words FROM d
      UNION ALL SELECT entry, 'body', 1.0::DOUBLE, list_filter(string_split_regex(lower(body), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) BETWEEN 1 AND 40) FROM d),
s AS (SELECT field, sum(len(words)) / (SELECT count(*) FROM d) AS avg_len, (SELECT count(*) FROM d) AS n FROM f GROUP BY field),
t AS (SELECT entry, field, weight, len(words) AS len, unnest(words) AS term FROM f),
p AS (SELECT entry, field, weight, len, term, count(*) AS tf FROM t WHERE term IN ({listed}) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
x AS (SELECT entry, count(DISTINCT term) AS matched,
      sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) * weight) AS score
      FROM p JOIN df USING (field, term) JOIN s USING (field) GROUP BY entry),
i AS (SELECT l_partkey AS entry, count(DISTINCT l_orderkey) AS inbound FROM lineitem WHERE l_orderkey <> l_partkey GROUP BY 1)
SELECT entry, round(score * (1 + 0.15 * ln(1 + coalesce(inbound, 0))), 6) AS score FROM x LEFT JOIN i USING (entry)
WHERE {f"matched = {len(words)}" if everything else "true"} ORDER BY 2 DESC, 1 LIMIT 10
"""


@query(_bm25_sql(["the", "that", "was"], True))
def bm25_and(spark, sf_dir):
    return _bm25(spark, sf_dir, "The AND that, was!")


@query(_bm25_sql(["the", "zzzqqq"], False))
def bm25_or(spark, sf_dir):
    return _bm25(spark, sf_dir, "the zzzqqq")


@query(f"""
WITH s AS (SELECT doc_id, trim(regexp_replace(text, '[{W}]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 280 THEN t
  ELSE regexp_replace(CASE WHEN regexp_matches(left(t, 280), '[{W}]') THEN regexp_extract(left(t, 280), '(?s)^(.*)[{W}]', 1) ELSE left(t, 280) END, '[,;: ]+$', '') || '…' END AS summary
FROM s
""")
def summary_truncate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.summary(F.col("text"), 280).alias("summary"))


@query(f"""
SELECT conv_id, turn, role, md5(c) AS clean, md5(trim(regexp_replace(c, '[{W}]+', ' ', 'g'))) AS line FROM (
  SELECT *, regexp_replace(regexp_replace(text, '[\\x{{00}}-\\x{{09}}\\x{{0b}}-\\x{{1f}}\\x{{7f}}-\\x{{9f}}]', '', 'g'), '[\\x{{202a}}-\\x{{202e}}\\x{{2066}}-\\x{{2069}}]', '', 'g') AS c FROM conversations)
""")
def sanitize_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    clean = text.sanitize(F.col("text"))
    return rows.select("conv_id", "turn", "role", F.md5(clean.cast("binary")).alias("clean"), F.md5(text.collapse_whitespace(clean).cast("binary")).alias("line"))


def _hrefs(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", "url", F.posexplode(found).alias("pos", "href"))


@query("""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS pos FROM pages)
SELECT page_id, CAST(pos AS INTEGER) AS pos,
  CASE WHEN trim(href) = '' THEN NULL WHEN starts_with(trim(href), '#') THEN 'anchor'
       WHEN starts_with(trim(href), '//') OR contains(href, '://') OR regexp_matches(trim(href), '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'external' ELSE 'internal' END AS kind,
  CASE WHEN trim(href) <> '' AND NOT starts_with(trim(href), '#') AND NOT starts_with(trim(href), '//') AND NOT contains(href, '://') AND NOT regexp_matches(trim(href), '^[A-Za-z][A-Za-z0-9+.-]*:')
       THEN ltrim(url_decode(regexp_extract(trim(href), '^[^#?]*')), '/') END AS path
FROM h
""")
def href_classify(spark, sf_dir):
    kind = text.classify_href(F.col("href"), F.lit("index"))
    return _hrefs(spark, sf_dir).select("page_id", "pos", kind["kind"].alias("kind"), kind["path"].alias("path"))


@query("SELECT page_id, regexp_extract(regexp_replace(url, '^.*?://', ''), '^[^/?#]*') AS domain, regexp_matches(lower(url), '^(https?|mailto):') AS allowed FROM pages")
def domain_of(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.domain_of(F.col("url")).alias("domain"), text.allowed_scheme(F.col("url")).alias("allowed"))


@query(f"""
SELECT doc_id, md5(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '[\\x{{00}}-\\x{{09}}\\x{{0b}}-\\x{{1f}}\\x{{7f}}-\\x{{9f}}]', '', 'g'), '[\\x{{202a}}-\\x{{202e}}\\x{{2066}}-\\x{{2069}}]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS html,
  regexp_replace(trim(regexp_replace(text, '[{W}]+', ' ', 'g')), ' ', '_', 'g') AS slug,
  CASE WHEN length(text) > 6000 THEN 6000 END AS next, length(substring(text, 1, 6000)) AS page_chars
FROM documents
""")
def escape_slug_page(spark, sf_dir):
    page = text_page = sections.text_page(F.col("text"), 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.escape_html(F.col("text")).cast("binary")).alias("html"), text.slugify(F.col("text")).alias("slug"), page["next"].cast("int").alias("next"), F.char_length(text_page["page"]).cast("long").alias("page_chars"))


def _sections(spark, sf_dir):
    """Turns of a conversation as sections of a document, with levels made up from their numbers."""
    rows = table(spark, sf_dir, "conversations")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    level = F.when(F.col("pos") == 0, 1).otherwise(2 + (F.col("pos") * 7 + F.col("conv_id")) % 4).cast("int")
    numbered = rows.withColumn("pos", n).select(F.col("conv_id").alias("doc"), "pos", level.alias("level"), F.concat(F.lit("Part "), "pos", F.lit(" "), "role").alias("heading"), (F.char_length("text") % 3).alias("blocks"), F.char_length("text").cast("long").alias("size"))
    return numbered


SECTIONS = """
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos FROM conversations),
s AS (SELECT conv_id AS doc, pos, CASE WHEN pos = 0 THEN 1 ELSE 2 + (pos * 7 + conv_id) % 4 END AS level,
             'Part ' || pos || ' ' || role AS heading, length(text) % 3 AS blocks, length(text) AS size FROM n),
e AS (SELECT a.*, (SELECT min(b.pos) FROM s b WHERE b.doc = a.doc AND b.pos > a.pos AND b.level <= a.level) AS stop FROM s a)
"""


@query(f"WITH {SECTIONS} SELECT doc, CAST(pos AS INTEGER) AS pos, CAST(stop AS INTEGER) AS stop FROM e")
def section_subtree(spark, sf_dir):
    return sections.subtree_ends(_sections(spark, sf_dir))


@query(f"""
WITH {SECTIONS}, u AS (
  SELECT a.doc, a.pos, string_agg(b.heading, ' > ' ORDER BY b.pos) AS path
  FROM e a JOIN e b ON b.doc = a.doc AND b.pos < a.pos AND b.level > 1 AND b.level < a.level AND (b.stop IS NULL OR b.stop > a.pos)
  GROUP BY a.doc, a.pos
)
SELECT s.doc, CAST(s.pos AS INTEGER) AS pos, coalesce(path, '') AS path FROM s LEFT JOIN u ON u.doc = s.doc AND u.pos = s.pos
""")
def section_breadcrumbs(spark, sf_dir):
    return sections.breadcrumbs(_sections(spark, sf_dir))


@query(f"""
WITH {SECTIONS} SELECT doc, CAST(pos AS INTEGER) AS pos, CAST(level AS INTEGER) AS level, heading, CAST(blocks AS INTEGER) AS blocks FROM e
WHERE pos = 0 OR blocks > 0 OR EXISTS (SELECT 1 FROM s b WHERE b.doc = e.doc AND b.pos > e.pos AND (e.stop IS NULL OR b.pos < e.stop) AND b.blocks > 0)
""")
def prune_sections(spark, sf_dir):
    return sections.prune_empty(_sections(spark, sf_dir))


@query(f"""
WITH {SECTIONS} SELECT doc, CAST(pos AS INTEGER) AS pos, size - length(heading) - 1 AS own,
  CAST((SELECT sum(b.size) FROM s b WHERE b.doc = e.doc AND b.pos >= e.pos AND (e.stop IS NULL OR b.pos < e.stop)) AS BIGINT) - length(heading) - 1 AS whole FROM e
""")
def section_sizes(spark, sf_dir):
    return sections.subtree_sizes(_sections(spark, sf_dir))


@query(f"WITH {SECTIONS} SELECT doc, CAST(pos AS INTEGER) AS pos, repeat('  ', CAST(level - 2 AS INTEGER)) || heading AS line FROM s WHERE level > 1")
def heading_outline(spark, sf_dir):
    return sections.outline(_sections(spark, sf_dir))


@query(f"""
WITH {SECTIONS}, h AS (SELECT doc, pos, lower(heading) AS norm FROM s WHERE contains(lower(heading), 'us') AND contains(lower(heading), 'part'))
SELECT doc, CAST(pos AS INTEGER) AS pos, coalesce(pos = min(CASE WHEN list_bool_or(list_transform(string_split(norm, ' '), lambda w: starts_with(w, 'us'))) THEN pos END) OVER (PARTITION BY doc), false) AS chosen FROM h
""")
def outline_filter(spark, sf_dir):
    rows = _sections(spark, sf_dir).withColumn("norm", F.lower("heading"))
    return sections.outline_matches(rows, "norm", ["us", "part"]).select("doc", "pos", "chosen")


@query("""
WITH m AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view' OR event_id % 5 = 0),
p AS (SELECT user_id, ts, event_id FROM events WHERE event_id % 5 <> 0)
SELECT p.user_id AS key, p.event_id, arg_max(m.event_id, (m.ts, m.event_id)) AS section
FROM p LEFT JOIN m ON m.user_id = p.user_id AND m.ts <= p.ts GROUP BY ALL
""")
def section_asof(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    marks = events.where("event_type = 'view' OR event_id % 5 = 0").select(F.col("user_id").alias("key"), F.col("ts").alias("line"), F.col("event_id").alias("section"))
    points = events.where("event_id % 5 <> 0").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), "event_id")
    return sections.containing_section(marks, points).select("key", "event_id", "section")


@query(f"""
WITH {SECTIONS}, w AS (SELECT DISTINCT doc, 'part_' || pos || '_USER' AS fragment FROM s)
SELECT s.doc, fragment, CAST(min(pos) AS INTEGER) AS pos FROM s JOIN w ON w.doc = s.doc AND lower(heading) = lower(replace(fragment, '_', ' ')) GROUP BY ALL
""")
def fragment_section(spark, sf_dir):
    rows = _sections(spark, sf_dir).withColumn("anchor", F.lit(None).cast("string"))
    return sections.fragment_section(rows, rows.select("doc", F.concat(F.lit("part_"), "pos", F.lit("_USER")).alias("fragment")).distinct())


@query("""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS pos FROM pages),
f AS (SELECT page_id AS doc, href AS target, min(pos) AS pos FROM h GROUP BY ALL)
SELECT doc, target, CAST(pos AS INTEGER) AS pos, CAST(row_number() OVER (PARTITION BY doc ORDER BY pos, target) AS INTEGER) AS rank FROM f
""")
def link_dedup_first_seen(spark, sf_dir):
    return sections.first_seen(_hrefs(spark, sf_dir).select(F.col("page_id").alias("doc"), F.col("href").alias("target"), "pos"))


@query("""
SELECT l_orderkey AS doc, count(DISTINCT CASE WHEN l_partkey % 3 = 0 THEN l_partkey END) AS linked,
  count(DISTINCT CASE WHEN l_partkey % 3 = 1 THEN l_shipdate END) AS missing, count(DISTINCT CASE WHEN l_partkey % 3 = 2 THEN l_suppkey END) AS external
FROM lineitem GROUP BY 1
""")
def link_kind_counts(spark, sf_dir):
    k = F.col("l_partkey") % 3
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.when(k == 0, "article").when(k == 1, "missing").otherwise("external").alias("kind"), F.col("l_partkey").alias("target"), F.col("l_shipdate").alias("path"), F.col("l_suppkey").alias("url"))
    return sections.link_counts(rows)


@query("""
WITH m AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM m)
SELECT user_id, CAST(island AS BIGINT) AS island, event_type, min(ts) AS first, count(*) AS n FROM i GROUP BY ALL
""")
def link_islands(spark, sf_dir):
    return sections.runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""
SELECT l_orderkey AS list, l_linenumber AS pos, CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS depth,
  CASE WHEN l_partkey % 3 <> 0 THEN CAST(sum(CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) END AS ordinal FROM lineitem
""")
def list_ordinals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("list"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_partkey") % 3 == 0, 1).otherwise(0).alias("depth"))
    return sections.ordinals(rows)


@query("""
WITH b AS (SELECT user_id AS doc, event_id AS pos, CASE event_id % 5 WHEN 0 THEN 'facts' WHEN 3 THEN 'paragraph' WHEN 4 THEN 'paragraph' ELSE 'list' END AS type FROM events),
f AS (SELECT *, min(CASE WHEN type = 'paragraph' THEN pos END) OVER (PARTITION BY doc) AS one FROM b)
SELECT doc, pos, type, CAST(row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN pos = one THEN 0 WHEN type = 'facts' THEN 1 ELSE 2 END, pos) AS INTEGER) AS place FROM f
""")
def lead_order(spark, sf_dir):
    k = F.col("event_id") % 5
    kind = F.when(k == 0, "facts").when(k >= 3, "paragraph").otherwise("list")
    return sections.lead_order(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), kind.alias("type")))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99, max(value) AS most FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return sections.percentiles(table(spark, sf_dir, "events"), "event_type", "value")


@query(f"""
WITH {TITLES}, a AS (
  SELECT target AS entry, row_number() OVER (ORDER BY norm = 'red' DESC, score DESC, strlen(norm), target) AS position FROM t WHERE starts_with(norm, 'red') LIMIT 5
), b AS (SELECT p_partkey AS entry, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS position FROM part LIMIT 40),
u AS (SELECT entry, position, 0 AS source FROM a UNION ALL SELECT entry, position, 1 FROM b WHERE entry NOT IN (SELECT entry FROM a))
SELECT entry, CAST(position AS INTEGER) AS position, CAST(source AS INTEGER) AS source FROM u ORDER BY source, position LIMIT 20
""")
def blended_search(spark, sf_dir):
    top = titles.suggest(part_titles(spark, sf_dir), "red", 5)
    hits = top.select(F.col("target").alias("entry"), F.row_number().over(Window.orderBy(F.desc("exact"), F.desc("score"), F.octet_length("title"), "target")).alias("position"))
    dear = table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(40)
    more = dear.select(F.col("p_partkey").alias("entry"), F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("position"))
    return fulltext.blended(hits, more, 20)


@query("""
WITH n AS (SELECT doc_id AS position, source || '_' || lang AS name, lower(source) AS label FROM documents UNION ALL SELECT -1, 'Wiki_en', 'wiki' UNION ALL SELECT -2, '9x_a', '9x'),
j AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY position) AS r FROM n)
SELECT position, name, label, CASE WHEN NOT regexp_matches(label, '^[a-z][a-z0-9-]{0,23}$') OR label LIKE '%-' THEN 'unusable'
  WHEN label IN ('api', 'random', 'search', 'static', 'wiki') THEN 'reserved' WHEN r > 1 THEN 'duplicate' END AS reason FROM j
""")
def label_first_wins(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), F.concat_ws("_", "source", "lang").alias("name"))
    extra = spark.createDataFrame([(-1, "Wiki_en"), (-2, "9x_a")], "position long, name string")
    return catalog.judge_labels(names.unionByName(extra))


@query("""
WITH g AS (SELECT o_orderkey AS position, o_custkey AS canonical, o_orderstatus = 'F' AS imported FROM orders)
SELECT position, canonical, imported FROM g QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY imported DESC, position) = 1
""")
def same_file_dedup(spark, sf_dir):
    given = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("canonical"), (F.col("o_orderstatus") == "F").alias("imported"))
    return catalog.same_files(given)


def _pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").alias("entry"), F.regexp_replace("url", "^[^:]*://[^/]*/?", "").alias("path"), F.col("url").alias("title"), "html")


@query()
def html_documents(spark, sf_dir):
    """Every page parsed: what it holds, in numbers."""
    docs = document.parse_documents(_pages(spark, sf_dir))
    return docs.select("entry", "title", F.size("sections").alias("n_sections"), F.size("links").alias("n_links"), F.char_length("body").alias("n_chars"), F.md5(F.col("body").cast("binary")).alias("body_md5"), "summary")


@query()
def document_json(spark, sf_dir):
    """Documents as JSON, by their digests."""
    docs = document.parse_documents(_pages(spark, sf_dir))
    return docs.select("entry", F.sha2(F.to_json(F.struct("title", "sections")), 256).alias("json_sha256"))


@query()
def page_links(spark, sf_dir):
    """Links of parsed pages, resolved among the pages themselves."""
    pages = _pages(spark, sf_dir)
    links = document.link_rows(document.parse_documents(pages))
    paths = pages.groupBy("path").agg(F.min("entry").alias("entry"))
    none = spark.createDataFrame([], "stub long, target long, fragment string")
    resolved = graph.resolve_links(links.where("kind = 'internal'").select("src", "pos", "path", "fragment"), paths, none)
    return resolved.select("src", "pos", "path", "target", "fragment")


@query()
def stemmed_search(spark, sf_dir):
    """Search over stems: other forms of the words count too."""
    docs = _text_docs(spark, sf_dir)
    posted = settled(fulltext.postings(docs, stem=True, only=fulltext.query_terms(spark, "being others", stem=True)))
    none = spark.createDataFrame([], "node long, inbound long")
    return fulltext.search(posted, fulltext.lengths(docs), none, "being others", 10, stem=True)


@query("SELECT p_partkey AS entry FROM part ORDER BY 1 LIMIT 1 OFFSET (SELECT CAST('16294208416658607535'::UHUGEINT % count(*)::UHUGEINT AS BIGINT) FROM part)")
def random_pick(spark, sf_dir):
    """The part that seed 0 picks."""
    return sections.random_article(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry")), 0)


@query("""
SELECT count(*) AS entries, count(*) FILTER (WHERE octet_length(encode(html)) <= 4096 AND regexp_matches(html, '(?is)<meta[^>]*http-equiv\\s*=\\s*["'']?refresh["'']?[^>]*url\\s*=')) AS stubs,
  count(DISTINCT regexp_replace(url, '^[^:]*://[^/]*/?', '')) AS paths, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes FROM pages
""")
def page_entries(spark, sf_dir):
    """Pages as archive entries, and which of them are mere refreshes."""
    entries = build.page_entries(table(spark, sf_dir, "pages"))
    html = F.col("content").cast("string")
    return entries.agg(F.count("*").alias("entries"), F.count_if(build.stub_href(html).isNotNull()).alias("stubs"), F.countDistinct("path").alias("paths"), F.sum(F.octet_length("content")).alias("bytes"))


@query("""
SELECT doc_id, length(text) > 40 AS cut, CASE WHEN length(t) > 40 THEN left(t, 40) || '…' ELSE t END AS echo FROM (
  SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\\x{00}-\\x{09}\\x{0b}-\\x{1f}\\x{7f}-\\x{9f}]', '', 'g'), '[\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}]', '', 'g'), '[%s]+', ' ', 'g')) AS t FROM documents)
""" % W)
def echo_line(spark, sf_dir):
    """Text as a message repeats it."""
    return table(spark, sf_dir, "documents").select("doc_id", (F.char_length("text") > 40).alias("cut"), text.echo(F.col("text"), 40).alias("echo"))


@query("""
SELECT doc_id, len(w) AS n_terms, array_to_string(w[1:5], ' ') AS first_terms FROM (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) BETWEEN 1 AND 40) AS w FROM documents)
""")
def tokenize(spark, sf_dir):
    found = text.terms(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n_terms"), F.array_join(F.slice(found, 1, 5), " ").alias("first_terms"))


@query("""
WITH f AS (SELECT doc_id AS entry, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) BETWEEN 1 AND 40) AS words FROM documents),
t AS (SELECT entry, len(words) AS len, unnest(words) AS term FROM f), p AS (SELECT term, entry, count(*) AS tf FROM t GROUP BY ALL)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY 1
""")
def posting_statistics(spark, sf_dir):
    """Documents and occurrences of each term."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry"), F.col("text").alias("body"))
    return fulltext.term_statistics(docs)


@query("""
SELECT p_partkey AS entry, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS title, CASE WHEN p_size % 2 = 0 THEN p_name END AS raw_title FROM part
""")
def title_fallback(spark, sf_dir):
    """An empty stored title gives way to the path."""
    raw = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry"), F.coalesce(F.nullif(raw, F.lit("")), "p_brand").alias("title"), F.nullif(raw, F.lit("")).alias("raw_title"))

import pytest
from pyspark.sql import functions as F

from quillspark.plans import build
from quillspark.plans.library import Library, NoSection, limit_for, redirect_note, search_head
from quillspark.sources import archive

PAGE = "<html><body><h1>{0}</h1>{1}</body></html>"


def entries(ns="C"):
    page = lambda path, title, html: {"namespace": ns, "path": path, "title": title, "mime": "text/html", "content": PAGE.format(title, html).encode()}
    stub = '<html><head><meta http-equiv="refresh" content="0;url=Physicist#Work"></head></html>'
    return [
        page("Physicist", "Physicist", '<p>A <a href="Physics">physics</a> person. <a href="Nowhere">gone</a></p><h2 id="Work">Work</h2><p>Measuring. <a href="Physicist">self</a></p>'),
        page("Physics", "Physics", '<p>Done by a <a href="./Physicist">physicist</a> and <a href="Doer">doers</a>.</p><h2>Empty</h2>'),
        page("Curie", "Marie Curie", '<p>A <a href="Work_of_physicists">working</a> <a href="Physicist#Work">physicist</a>, twice <a href="https://x.org/a">out</a>.</p>'),
        page("Café", "Café", '<p>Coffee <a href="Scientist">scientist</a> <a href="style.css">look</a></p>'),
        {"namespace": ns, "path": "Work_of_physicists", "title": "Work of physicists", "mime": "text/html", "content": stub.encode()},
        {"namespace": ns, "path": "Scientist", "title": "Scientist", "redirect": "Physicist"},
        {"namespace": ns, "path": "Doer", "title": "", "redirect": "Scientist"},
        {"namespace": ns, "path": "Loop", "title": "Loop", "redirect": "Loop"},
        {"namespace": ns, "path": "style.css", "title": "", "mime": "text/css", "content": b"p{}"},
        {"namespace": "M", "path": "Scraper", "mime": "text/plain", "content": b"MWoffliner 1.14"},
        {"namespace": "M", "path": "Name", "mime": "text/plain", "content": b"tiny_en_all"},
    ]


@pytest.mark.parametrize("version", [(5, 0), (6, 0), (6, 1)])
@pytest.mark.parametrize("compression", [1, 4, 5])
def test_reader(tmp_path, version, compression):
    ns = "C" if version == (6, 1) else "A"
    archive.write_archive(path := str(tmp_path / "a.zim"), entries(ns), version, compression, main="Curie")
    a = archive.Archive(path)
    assert a.checksum_holds() and a.article_namespace == ns and a.metadata("Name") == "tiny_en_all"
    i = a.find(ns, "Doer")
    assert a.entry(i).title == "Doer" and a.entry(a.resolve(i)).path == "Physicist" and b"physics" in a.content(i)
    assert a.find(ns, "Nobody") is None and a.entry(a.main_entry()).path == "Curie"
    assert [a.entry(x).path for x in a.namespace_range("M")] == ["Name", "Scraper"]
    with pytest.raises(archive.DamagedArchive):
        a.resolve(a.find(ns, "Loop"))
    front = {a.entry(x).path for x in a.front_articles()}
    assert {"Physicist", "Scientist"} <= front and ("style.css" in front) == (version != (6, 1))


def test_damage_never_escapes_as_something_else(tmp_path):
    archive.write_archive(path := str(tmp_path / "a.zim"), entries()[:3], compression=5)
    good = open(path, "rb").read()
    for i in range(0, len(good), 7):
        bad = bytearray(good)
        bad[i] ^= 0xFF
        with open(path, "wb") as f:
            f.write(bad)
        try:
            a = archive.Archive(path)
            assert not a.checksum_holds()
            for x in range(min(a.entry_count, 50)):
                if a.entry(x).kind == "content":
                    a.content(x)
        except archive.DamagedArchive:
            pass


def test_source(spark, tmp_path):
    archive.write_archive(path := str(tmp_path / "a.zim"), entries(), per_cluster=2)
    df = archive.read_archive(spark, path, clustersPerPartition=2, entriesPerPartition=5)
    got = {r.path: r for r in df.collect()}
    assert len(got) == df.count() == 12 and got["Doer"].kind == "redirect" and got["Doer"].content is None
    one = archive.Archive(path)
    assert all(bytes(r.content) == one.content(r.entry) for r in got.values() if r.kind == "content")
    assert archive.read_archive(spark, path, "M").count() == 2
    read = lambda **o: spark.read.format("archive").options(**o).load(path)
    assert "content" not in read().columns and read(entriesPerPartition=5).rdd.getNumPartitions() == 3
    assert sorted(r.entry for r in read(table="front", entriesPerPartition=2).collect()) == sorted(one.front_articles())
    archive.write_archive(old := str(tmp_path / "o.zim"), entries("A"), (5, 0))
    front = spark.read.format("archive").options(table="front", entriesPerPartition=4).load(old)
    assert sorted(r.entry for r in front.collect()) == sorted(archive.Archive(old).front_articles())


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("lib")
    archive.write_archive(path := str(folder / "tiny.zim"), entries())
    out = build.build_all(spark, archive.archive_paths([str(folder), path]), str(folder / "idx"))
    assert list(out) == [path] and isinstance(out[path], dict), out
    again = build.build_all(spark, [path], str(folder / "idx"))
    assert again[path] == out[path]
    return Library(spark, str(folder / "idx/tiny"))


def test_counters(library):
    m = library.meta
    assert (m["articles"], m["redirects"], m["section_redirects"], m["missing_links"], m["label"]) == (4, 2, 1, 1, "tiny")
    inbound = {r.entry: r.inbound for r in library.table("inbound").withColumnRenamed("node", "entry").collect()}
    by_path = {r.path: r.entry for r in library.table("entries").collect()}
    assert inbound[by_path["Physicist"]] == 3 and inbound[by_path["style.css"]] == 1 and inbound[by_path["Curie"]] == 0


def test_queries(library):
    paths = {r.path: r.entry for r in library.table("entries").collect()}
    top = library.suggest("phys").collect()
    assert [(r.title, r.matched, r.fragment, r.inbound, r.exact) for r in top] == [("Physicist", None, None, 3, False), ("Physics", None, None, 1, False)]
    alias = library.suggest("scientist").first()
    assert (alias.article, alias.title, alias.matched, alias.fragment, alias.exact) == (paths["Physicist"], "Physicist", "Scientist", None, True)
    section = library.suggest("work of").first()
    assert (section.title, section.matched, section.fragment) == ("Physicist", "Work of physicists", "Work")
    assert library.has_exact("CAFE") and not library.has_exact("caf") and not library.has_exact("caf\x00e")
    close, prefix = library.suggest_with_fallback("Physicx")
    assert prefix == "Physic" and [r.title for r in close] == ["Physicist", "Physics"]
    assert library.suggest_with_fallback("physic")[1] is None and library.suggest_with_fallback("Zzzzzz") == ([], None)
    assert library.suggest("").count() == library.suggest("p", 0).count() == 0
    assert library.find("Work_of_physicists") == (paths["Physicist"], "Work") and library.find("Loop") is None
    assert library.resolve_title("marie curie").entry == paths["Curie"]
    assert library.resolve_title("work of physicists").fragment == "Work"
    assert library.resolve_title("physicz").suggestions and library.resolve_title("style.css").entry is None
    assert library.search("measuring").first().title == "Physicist"
    assert {r.title for r in library.search("coffee measuring").collect()} == {"Café", "Physicist"}
    assert library.search("doer").first().title == "Physicist"
    both = library.blended("physics", 3)
    assert both[0] == {"article": paths["Physics"], "title": "Physics", "matched": None, "summary": None} and both[1]["summary"]
    assert len({r["article"] for r in both}) == len(both) and library.blended("scientist", 1)[0]["matched"] == "Scientist"
    kinds = [(r.kind, r.title) for r in library.titles_and_texts("physics").collect()]
    assert kinds.count(("title", "Physics")) == kinds.count(("text", "Physics")) == 1
    assert "Measuring." in library.read(paths["Physicist"], "Work") and "- Work" in library.read(paths["Physicist"])
    physicist = paths["Physicist"]
    assert library.read(physicist, "1") == library.read(physicist, "work") == library.read(physicist, fragment="Work")
    assert library.read(physicist, fragment="1") == library.read(physicist, fragment="Gone") == library.read(physicist)
    assert library.read(physicist, "Outline") == "1. Work"
    with pytest.raises(NoSection, match='no section "Life" in "Physicist" \\(2 sections\\):\n1. Work'):
        library.read(physicist, "Life")
    assert [r.target for r in library.links(physicist, "Work").collect()] == [physicist]
    assert tuple(library.link_counts(physicist, "Work").first())[1:] == (1, 0, 0) and library.links(physicist, fragment="Gone").count() == 2
    with pytest.raises(NoSection):
        library.links(physicist, "Life")
    assert [r.target for r in library.links(paths["Curie"]).collect()] == [paths["Physicist"]]
    assert tuple(library.link_counts(paths["Physicist"]).first())[1:] == (2, 1, 0)
    html = library.html(paths["Physicist"])
    assert '<a class="article" href="Physics">' in html and '<span class="missing">' in html and '<h2 id="Work">' in html
    assert '<a class="article" href="Physicist">' in library.html(paths["Café"]) and "Scientist" not in library.html(paths["Café"])
    assert library.random(7) in paths.values()
    assert redirect_note("scientist", "Physicist") and not redirect_note("café", "Cafe")
    with pytest.raises(ValueError):
        library.suggest("x" * 201)


def test_wrong_producer(spark, tmp_path):
    archive.write_archive(path := str(tmp_path / "b.zim"), [e for e in entries() if e["path"] != "Scraper"])
    out = build.build_all(spark, [path, str(tmp_path / "none.zim")], str(tmp_path / "idx"))
    assert isinstance(out[path], build.WrongProducer) and all(isinstance(x, Exception) for x in out.values())


def test_collections(spark, library, tmp_path):
    from quillspark.plans import collections

    zim = library.path.replace("/idx/tiny", "/tiny.zim")
    found = collections.open_collections(spark, {library.path: zim, str(tmp_path / "none"): None})
    assert found.default == "tiny" and found.skipped[0][1] == "not imported"
    assert found.select().library().article_count == 4
    assert "tiny" in collections.summary(found) and collections.elsewhere(found, "other", "café") == ["tiny"]
    archive.write_archive(other := str(tmp_path / "other.zim"), entries()[:2] + entries()[-2:])
    wrong = collections.open_collections(spark, {library.path: other}).select()
    for _ in range(2):
        with pytest.raises(ValueError, match="another file"):
            wrong.library()
    with pytest.raises(ValueError):
        collections.open_collections(spark, {str(tmp_path / "none"): None})
    lines = collections.search_text(found, "measuring", 3).split("\n")
    assert lines == ['1 for "measuring"', "<article-text>Physicist</article-text>: <article-text>A physics person. gone</article-text>"]
    assert collections.search_text(found, "scientist", 1).split("\n")[1] == "<article-text>Physicist</article-text> via <article-text>Scientist</article-text>"
    assert collections.search_text(found, "zzzz") == 'Nothing for "zzzz"; try other words, or fewer'
    with pytest.raises(ValueError):
        collections.search_text(found, " ")
    assert search_head(0, 8, "x\x07", "a", ["b"]) == 'Nothing for "x" in a; b has a page of just this title: read it with collection="b"'
    assert search_head(8, 8, "x").endswith("higher limit") and [limit_for("tool"), limit_for("tool", 99), limit_for("web search", 0)] == [8, 20, 1]
    assert "<article-text>‹/article-text>" in collections.fenced("</article-text>")
    skipped = collections.open_collections(spark, {library.path: zim, str(tmp_path / "x\x1b"): None}, any_producer=False).skipped
    assert skipped == [("x", "not imported", "no index")]


def test_stub_pages(spark):
    """Each form of the address, and pages that are none."""
    head = "<head><meta http-equiv=\"refresh\" content="
    given = {
        head + "\"0;url=A#b\">": "A#b", head + "'0; url=\"A b\"'>": "A b", head + "\"0; URL='A'\">": "A", head + "0;url=A>": "A", head.replace('"refresh"', "'REFRESH'") + "\"0;url=A\">": "A",
        head + "\"0\">": None, head + "\"0;url=\">": None, "url=A <p>": None, head + "\"0;url=A\">" + "x" * 4096: None, "": None,
    }
    rows = [(h.encode(), w) for h, w in given.items()] + [(b"\xff" + head.encode() + b"\"0;url=A\">", None), (None, None)]
    got = spark.createDataFrame(rows, "html binary, want string").select("want", build.stub_href(F.col("html")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_documents_in_order(library):
    found = [r.entry for r in library.table("documents").collect()]
    assert found == sorted(found)

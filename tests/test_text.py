import pytest
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators.fulltext import stemmed
from quillspark.operators.sections import mixed_seed
from quillspark.operators.titles import shorter_prefixes


@pytest.mark.parametrize("given, want", [
    ("Éclair_au  Chocolat ", "eclair au chocolat"), ("ΣΑΣ", "σασ"), ("ﬁne\x07 print", "fine print"), ("", ""), ("__", ""), ("A B　C", "a b c"), ("İstanbul", "istanbul"),
])
def test_normalized(given, want):
    assert text.normalized(given) == want


def test_prefixes():
    assert text.normalized_prefix("New ") == "new " and text.normalized_prefix("New_") == "new " and text.normalized_prefix(" ") == ""
    assert shorter_prefixes("redx") == ["redx", "red"]
    assert shorter_prefixes("abcdefgh") == ["abcdefgh", "abcdefg", "abcdef"]
    assert shorter_prefixes("Éa b_cd") == ["Éa b_cd", "Éa b_c", "Éa b_"] and shorter_prefixes("") == [""]


def rows(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(2)
    return [tuple(r)[1:] for r in sorted(df.select("i", *columns).collect())]


def test_column_functions(spark):
    v = F.col("v")
    got = rows(spark, ["a  b　\n c", None, "x\x00\x1b[31m‮y\nz"], text.collapse_whitespace(v), text.sanitize(v), text.sanitize_line(v))
    assert got == [("a b c", "a  b　\n c", "a b c"), (None, None, None), ("x\x00\x1b[31m‮y z", "x[31my\nz", "x[31my z")]
    assert rows(spark, ["one two, three", "short", "unbrokenunbroken"], text.truncate_words(v, 9)) == [("one two…",), ("short",), ("unbrokenu…",)]
    assert rows(spark, ["cats AND dogs!", "-AND- x", "title:^4 'n' well-known", "— …"], text.clean_query(v)) == [("cats dogs",), ("AND x",), ("title 4 n well-known",), ("",)]
    assert rows(spark, ["100%", "a%20b+c", "%C3%A9%ff"], text.percent_decode(v), text.percent_encode_path(v)) == [("100%", "100%25"), ("a b+c", "a%2520b%2Bc"), ("é�", "%25C3%25A9%25ff")]
    assert rows(spark, ["https://u@h.org:80/p?q", "mailto:a@b@c.de?x", "http://h#f"], text.domain_of(v)) == [("u@h.org:80",), ("c.de",), ("h",)]
    assert rows(spark, ["Wiki_en_all", "simple-", "9x", "ab"], text.label_of(v), text.is_label(text.label_of(v))) == [("wiki", True), ("simple-", False), ("9x", False), ("ab", True)]
    assert rows(spark, ["日本", "éx"], text.display_width(v)) == [(4,), (2,)]
    assert rows(spark, ["<a & \"b\"'>"], text.escape_html(v)) == [("&lt;a &amp; &quot;b&quot;&#39;&gt;",)]
    assert rows(spark, ["a\x07\u202e<\n"], text.escape_html(v)) == [("a&lt;\n",)] and text.escaped("a\x07\u202e<\n'") == "a&lt;\n&#39;"
    assert rows(spark, ["x <t> </t>"], text.defuse(v, "<t>", "</t>")) == [("x ‹t> ‹/t>",)] and text.defused("<t></t>", "<t>", "</t>") == "‹t>‹/t>"
    assert rows(spark, ["\x01\xff"], text.uuid_hex(F.encode(v, "iso-8859-1"))) == [("01ff",)]
    assert text.sanitized_line(" a\x00 \n b\u2066 ") == "a b"
    assert rows(spark, ["12345"], text.with_thousands(v.cast("int"))) == [("12,345",)]


def test_hrefs(spark):
    given = ["#Top", " ", "//x.org/a", "HTTPS://x", "mailto:a@b", "../C/./D?x=1#S%20t", "/B/E", "", "a%2Fb#", None]
    got = rows(spark, given, text.classify_href(F.col("v"), F.lit("A/P/Q")).alias("h"))
    got = [None if h is None else tuple(h) for (h,) in got]
    assert got == [("anchor", None, "Top", None), None, ("external", None, None, "//x.org/a"), ("external", None, None, "HTTPS://x"), ("external", None, None, "mailto:a@b"), ("internal", "A/C/D", "S t", None), ("internal", "B/E", None, None), None, ("internal", "A/P/a/b", None, None), None]


@pytest.mark.parametrize("word, stem", [
    ("running", "run"), ("generously", "generous"), ("cries", "cri"), ("ties", "tie"), ("hopping", "hop"), ("hoping", "hope"), ("nationally", "nation"), ("skies", "sky"),
    ("conditional", "condit"), ("agreed", "agre"), ("feed", "feed"), ("happy", "happi"), ("sensibility", "sensibl"), ("a", "a"), ("argument", "argument"), ("adjustable", "adjust"),
])
def test_stems(word, stem):
    assert stemmed(word) == stem


def test_seed_mixing():
    assert mixed_seed(0) == 0xE220A8397B1DCDAF


def test_clip():
    assert text.clipped("日本語", 5) == "日本…" and text.clipped("abc", 3) == "abc" and text.clipped("abcd", 3) == "ab…"

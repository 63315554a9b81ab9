"""Text functions. All but the ones marked as Arrow functions stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The White_Space characters of Unicode as a regular-expression class body.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CONTROL_BUT_NEWLINE = r"[\x{00}-\x{09}\x{0b}-\x{1f}\x{7f}-\x{9f}]"
DIRECTION_MARKS = r"[\x{202a}-\x{202e}\x{2066}-\x{2069}]"
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")


def collapse_whitespace(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def sanitize(c: Column) -> Column:
    """Without control characters (newlines stay) and text-direction marks."""
    return F.regexp_replace(F.regexp_replace(c, CONTROL_BUT_NEWLINE, ""), DIRECTION_MARKS, "")


def sanitize_line(c: Column) -> Column:
    return collapse_whitespace(sanitize(c))


#: White space and ``_`` become a space, other control characters go.
_ASCII = {i: None for i in [*range(32), 127]} | dict.fromkeys([9, 10, 11, 12, 13, ord("_")], " ")


def normalized(text: str) -> str:
    """Compatibility decomposition without marks, lower case letter by letter, ``_`` and white space as one space."""
    if text.isascii():
        return re.sub(" +", " ", text.lower().translate(_ASCII)).strip(" ")
    out: list[str] = []
    for c in unicodedata.normalize("NFKD", text):
        if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Mc", "Me"):
            continue
        if c == "_" or SPACES.match(c):
            out.append(" ")
        elif unicodedata.category(c) != "Cc":
            out.append("".join(x.lower() for x in c))
    return re.sub(" +", " ", "".join(out)).strip(" ")


_CONTROL = {i: None for i in [*range(0x20), *range(0x7F, 0xA0), *range(0x202A, 0x202F), *range(0x2066, 0x206A)] if i != 10}


def sanitized(text: str) -> str:
    """``sanitize`` for a single string."""
    return text.translate(_CONTROL)


def sanitized_line(text: str) -> str:
    return SPACES.sub(" ", sanitized(text)).strip(" ")


_NAMED = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"} | {chr(i): None for i in _CONTROL})


def escaped(text: str) -> str:
    """``escape_html`` for a single string, in one pass."""
    return text.translate(_NAMED)


def defused(text: str, opening: str, closing: str) -> str:
    """``defuse`` for a single string."""
    return text.replace(opening, opening.replace("<", "‹")).replace(closing, closing.replace("<", "‹"))


@F.pandas_udf(T.StringType())
def normalize(texts: pd.Series) -> pd.Series:
    """Arrow function: the form in which titles are compared."""
    return texts.map(normalized, na_action="ignore")


def normalized_prefix(query: str) -> str:
    """``normalized``, with one space kept at the end if the query ends with a space or ``_``."""
    out = normalized(query)
    return out + " " if out and query[-1:] in (" ", "_") else out


def truncate_words(c: Column, most: int) -> Column:
    """At most ``most`` characters, cut at the last white space and marked with an ellipsis."""
    cut = F.left(c, F.lit(most))
    whole = F.regexp_extract(cut, f"(?s)^(.*)[{SPACE}]", 1)
    at = F.when(cut.rlike(f"[{SPACE}]"), whole).otherwise(cut)
    return F.when(F.char_length(c) <= most, c).otherwise(F.concat(F.regexp_replace(at, "[,;: ]+$", ""), F.lit("…")))


def summary(c: Column, most: int) -> Column:
    """``truncate_words`` of the collapsed text, without collapsing more of it than shows."""
    head = F.regexp_extract(c, f"(?s)^[{SPACE}]*+((?:[^{SPACE}]|[{SPACE}]++(?=[^{SPACE}])){{0,{most + 2}}}+)", 1)
    return truncate_words(collapse_whitespace(head), most)


def echo(c: Column, most: int) -> Column:
    """A query or title repeated in a message: one clean line of bounded length."""
    line = sanitize_line(c)
    return F.when(F.char_length(line) > most, F.concat(F.left(line, F.lit(most)), F.lit("…"))).otherwise(line)


def defuse(c: Column, opening: str, closing: str) -> Column:
    """Text that cannot open or close the fence it is put into."""
    return F.replace(F.replace(c, F.lit(opening), F.lit(opening.replace("<", "‹"))), F.lit(closing), F.lit(closing.replace("<", "‹")))


def has_scheme(c: Column) -> Column:
    return c.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")


def allowed_scheme(c: Column) -> Column:
    return F.lower(c).rlike("^(https?|mailto):")


def domain_of(c: Column) -> Column:
    """Authority of a URL as it stands, or what follows the last ``@`` of a mail address."""
    rest = F.when(F.lower(c).startswith("mailto:"), F.regexp_replace(c, "^.*@", "")).otherwise(F.regexp_replace(c, "^.*?://", ""))
    return F.regexp_extract(rest, "^[^/?#]*", 0)


def slugify(c: Column) -> Column:
    return F.regexp_replace(collapse_whitespace(c), " ", "_")


def escape_html(c: Column) -> Column:
    """Clean text for a page: control characters and direction marks go, the five signs of mark-up are named."""
    c = sanitize(c)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def relative_path(base_path: Column, href: Column) -> Column:
    """``href`` seen from the folder of ``base_path``: ``.``, ``..`` and empty segments resolved."""
    parts = F.split(base_path, "/")
    folder = F.when(href.startswith("/"), F.array().cast("array<string>")).otherwise(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))

    def step(path: Column, segment: Column) -> Column:
        up = F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))
        return F.when(segment.isin("", "."), path).when(segment == "..", up).otherwise(F.concat(path, F.array(segment)))

    return F.array_join(F.aggregate(F.split(href, "/"), folder, step), "/")


@F.pandas_udf(T.StringType())
def percent_decode(texts: pd.Series) -> pd.Series:
    """Arrow function: ``%xx`` decoded as UTF-8 with replacement; ``+`` and stray ``%`` stay."""
    return texts.map(lambda s: unquote(s, errors="replace"), na_action="ignore")


@F.pandas_udf(T.StringType())
def percent_encode_path(texts: pd.Series) -> pd.Series:
    """Arrow function: all but letters, digits and ``-_.~/`` encoded."""
    return texts.map(lambda s: quote(s, safe="-_.~/"), na_action="ignore")


def classify_href(href: Column, base_path: Column) -> Column:
    """``struct<kind, path, fragment, url>``: an anchor, an external or an internal link; null if blank."""
    h = F.regexp_replace(F.regexp_replace(href, f"^[{SPACE}]+", ""), f"[{SPACE}]+$", "")
    nothing = F.lit(None).cast("string")
    link = lambda kind, path=nothing, fragment=nothing, url=nothing: F.struct(F.lit(kind).alias("kind"), path.alias("path"), fragment.alias("fragment"), url.alias("url"))
    before, after = F.substring_index(h, "#", 1), F.regexp_extract(h, "(?s)^[^#]*#(.*)$", 1)
    path = relative_path(base_path, percent_decode(F.substring_index(before, "?", 1)))
    return (
        F.when(h.isNull() | (h == ""), F.lit(None))
        .when(h.startswith("#"), link("anchor", fragment=percent_decode(F.substr(h, F.lit(2)))))
        .when(h.startswith("//") | h.contains("://") | has_scheme(h), link("external", url=h))
        .otherwise(link("internal", path=path, fragment=percent_decode(F.nullif(after, F.lit("")))))
    )


def clean_query(c: Column) -> Column:
    """Words of a full-text query without operators and signs."""
    words = F.split(F.regexp_replace(c, r"[^\p{L}\p{N}'-]+", " "), " ")
    kept = F.filter(words, lambda w: ~w.isin("AND", "OR", "NOT") & w.rlike(r"[\p{L}\p{N}]"))
    return F.array_join(F.transform(kept, lambda w: F.regexp_replace(w, "^['-]+|['-]+$", "")), " ")


def terms(c: Column) -> Column:
    """Lower-case runs of letters and digits, at most 40 characters each."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 0) & (F.length(w) <= 40))


def boosted(score: Column, inbound: Column) -> Column:
    return score * (F.lit(1.0) + F.lit(0.15) * F.log1p(inbound))


def label_of(name: Column) -> Column:
    """Collection label of an archive name: what stands before the first ``_``, in lower case."""
    return F.lower(F.substring_index(name, "_", 1))


def is_label(c: Column) -> Column:
    return c.rlike("^[a-z][a-z0-9-]{0,23}$") & ~c.endswith("-")


def uuid_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def with_thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def width_of(text: str) -> int:
    """Terminal columns: wide and full-width characters take two, marks and controls none."""
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Cc", "Cf", "Mn", "Me") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


@F.pandas_udf(T.IntegerType())
def display_width(texts: pd.Series) -> pd.Series:
    """Arrow function: ``width_of``."""
    return texts.map(width_of, na_action="ignore").astype("Int32")


def clipped(text: str, width: int) -> str:
    """At most ``width`` columns, the last one an ellipsis if something was cut."""
    if width_of(text) <= width:
        return text
    out, used = "", 0
    for c in text:
        if used + width_of(c) > width - 1:
            break
        out, used = out + c, used + width_of(c)
    return out + "…" if width > 0 else ""

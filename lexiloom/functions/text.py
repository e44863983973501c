"""Column expressions on text: white space, escaping, scripts, marks, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts outside Java's \\s have it, for use inside a character class.
BLANK = r"\s\x0b   -     　﻿"

# The character ranges that make a search term, a dictionary term and a
# display name count as ideographic; each place has its own.
SEARCH_RANGE = r"[　-鿿豈-﫿]"
DICTIONARY_RANGE = r"[一-鿿㐀-䶿豈-﫿]"
NAME_RANGE = r"[一-鿿]"


def text_or_empty(c) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any script on either side."""
    return F.regexp_replace(c, f"^[{BLANK}]+|[{BLANK}]+$", "")


def normalize_text(c: Column) -> Column:
    """No carriage returns, no blanks round line breaks, runs of blanks as one, stripped."""
    c = F.regexp_replace(c, "\r", "")
    c = F.regexp_replace(c, "[ \t]*\n[ \t]*", "\n")
    return strip(F.regexp_replace(c, "[ \t]{2,}", " "))


def escape_html(c: Column) -> Column:
    """The five markup characters as entities; null is empty."""
    c = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def quoted(term: str) -> str:
    """A term as a literal inside a regular expression."""
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def is_ideographic(term: str) -> bool:
    return any("　" <= ch <= "鿿" or "豈" <= ch <= "﫿" for ch in term)


def highlight(c: Column, term: str) -> Column:
    """Every occurrence, whatever its case, between mark tags; the empty term marks nothing."""
    return F.regexp_replace(c, "(?i)" + quoted(term), "<mark>$0</mark>") if term else c


def marked_term(c: Column) -> Column:
    """What the first mark tags enclose, else empty."""
    return F.coalesce(F.regexp_extract(c, r"(?s)<mark>(.*?)</mark>", 1), F.lit(""))


def marks_only(c: Column) -> Column:
    """Angle brackets escaped, but for mark tags."""
    a, b = "\u0001", "\u0002"
    c = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("<mark>"), F.lit(a)), F.lit("</mark>"), F.lit(b))
    c = F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(c, F.lit(a), F.lit("<mark>")), F.lit(b), F.lit("</mark>"))


def leading_int(c: Column) -> Column:
    """The integer a text begins with, null without one."""
    return F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int")


def shortened(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def encoded(c: Column) -> Column:
    """Percent-encoding of a URL component: blanks as %20; ! ' ( ) * stay."""
    c = F.url_encode(c)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def decoded(c: Column, plus: bool = False) -> Column:
    """Percent-decoding; a text with a bad escape stays as it is. ``plus``: + stands for a blank."""
    whole = c if plus else F.replace(c, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(whole), c)


def safe_color(c: Column) -> Column:
    """A hash colour of three to eight digits, else null."""
    return F.when(c.rlike("^#[0-9A-Fa-f]{3,8}$"), c)


def life_dates(floruit: Column, death: Column, short: bool = False) -> Column:
    """f–d, ``fl.`` f, or ``d.`` d; zero is no year. ``short`` writes f-d and no ``fl.``."""
    f, d = F.coalesce(floruit, F.lit(0)), F.coalesce(death, F.lit(0))
    both = F.concat(f.cast("string"), F.lit("-" if short else "–"), d.cast("string"))
    return (
        F.when((f != 0) & (d != 0), both)
        .when((f != 0) & F.lit(not short), F.concat(F.lit("fl. "), f.cast("string")))
        .when(d != 0, F.concat(F.lit("d. "), d.cast("string")))
        .otherwise(F.lit(""))
    )


def iso_day(c: Column) -> Column:
    """``MMM d, yyyy`` of an ISO time, empty if it is none."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "MMM d, yyyy"), F.lit(""))


def stars(importance: Column) -> Column:
    """Importance held within 0 to 5, as stars."""
    return F.repeat(F.lit("★"), F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(importance, F.lit(0)))))


def line_range(start: Column, end: Column) -> Column:
    """start – end, or start alone if there is no other end; empty without start."""
    s, e = F.coalesce(start, F.lit("")), F.coalesce(end, F.lit(""))
    return F.when(s == "", F.lit("")).when((e != "") & (e != s), F.concat(s, F.lit(" – "), e)).otherwise(s)


def citation(style: str, title: Column, work: Column, url: Column, on: str, site: str, catalogue: str) -> Column:
    """Citation of a work in one of five styles; any other style is empty. ``on`` is the day of access, as written."""
    lit = F.lit
    if style == "Chicago":
        return F.concat(lit("“"), title, lit(f".” {catalogue} "), work, lit(f". {site}. "), url, lit("."))
    if style == "APA":
        return F.concat(title, lit(" ("), work, lit(f"). {site}. Retrieved from "), url)
    if style == "MLA":
        return F.concat(lit("“"), title, lit(f".” {site}, "), url, lit(f". Accessed {on}."))
    if style == "BibTeX":
        key = site.lower().replace(" ", "")
        return F.concat(lit("@misc{" + key + ":"), work, lit(",\n  title        = {"), title, lit("},\n  howpublished = {"), url, lit("},\n  note         = {" + catalogue + " "), work, lit("}\n}"))
    if style == catalogue:
        return work
    return lit("")


def passage_name(summary: Column, zh: Column, passage_id: Column) -> Column:
    """The name of a passage in an address: the first 50 characters of its summary or text, else its id."""
    text = F.coalesce(F.nullif(summary, F.lit("")), F.nullif(zh, F.lit("")))
    return F.coalesce(strip(F.substring(text, 1, 50)), passage_id, F.lit(""))


def collection_name(name: Column, collection_id: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), collection_id, F.lit(""))


def described_mode(side: Column, translator: Column) -> Column:
    """What a reader sees: the source, or whose translation."""
    by = F.coalesce(translator, F.lit(""))
    return F.when(side != "en", F.lit("Chinese source preview")).when(by != "", F.concat(F.lit("Translation by "), by)).otherwise(F.lit("Community translation"))


def described_source(source: Column) -> Column:
    """Label of a compared source: one's own copy, the authoritative one, or that of a user; a dash for none."""
    s = F.coalesce(source, F.lit(""))
    low = F.lower(s)
    return (
        F.when(s == "", F.lit("—")).when(low == "me", F.lit("My copy (local only)"))
        .when(low.isin("community", "authoritative", "auth"), F.lit("Authoritative")).otherwise(F.concat(F.lit("Community · "), s)))

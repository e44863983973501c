"""Route strings of a reader application to columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.ids import CANONICAL, PUBLISHED, corpus_of_id
from lexiloom.functions.text import decoded

# Line markers of the two corpora, and words for the translated side.
MARK = r"[0-9]{4}[abc][0-9]{2}"
OPEN_MARK = r"[A-Za-z][A-Za-z0-9]*(?:\.[A-Za-z0-9]+)+"
SIDES = ("en", "tran", "translated", "translation")
LINE = f"^(?:{MARK}(?:-{MARK})?|{OPEN_MARK}(?:-{OPEN_MARK})?)$"

_PLAIN = ("dict", "term", "master", "masters", "lineage", "scholar", "tags", "search", "compare")


def query_value(query: Column, *names: str) -> Column:
    """Value of the first of these names that has one, decoded with + as a blank; empty without."""
    found = [F.when(v != "", v) for v in (decoded(F.regexp_extract(query, rf"(?:^|&){n}=([^&]*)(?!.*&{n}=)", 1), plus=True) for n in names)]
    return F.coalesce(*found, F.lit(""))


def parsed_route(raw: Column) -> Column:
    """struct(kind, work, corpus, start_line, end_line, side, user, item, q): the parts of a route.

    ``item`` is what the kind is about besides the user: the term, the person, the
    collection and passage, the tag, the compared sources. Null for the empty route,
    kind ``unknown`` for what fits no form. Legacy ``passage/`` prefixes are dropped, and the
    older collection forms are understood.
    """
    raw = F.regexp_replace(raw, "^/", "")
    path = F.regexp_extract(raw, r"^([^?]*)", 1)
    query = F.regexp_extract(raw, r"\?(.*)$", 1)
    every = F.filter(F.split(path, "/"), lambda x: x != "")
    every = F.when((F.lower(F.get(every, F.lit(0))) == "passage") & (F.size(every) > 1), F.slice(every, 2, F.greatest(F.size(every) - 1, F.lit(0)))).otherwise(every)
    kept = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    part = lambda i: F.coalesce(F.get(every, F.lit(i)), F.lit(""))
    text = lambda i: decoded(part(i))
    seg = lambda i: decoded(F.coalesce(F.get(kept, F.lit(i)), F.lit("")))
    word = F.lower(part(0))
    e = F.lit("")

    is_work = part(0).rlike(PUBLISHED) | part(0).rlike(CANONICAL)
    rest = F.slice(every, 2, F.greatest(F.size(every) - 1, F.lit(0)))
    lines = F.filter(rest, lambda x: x.rlike(LINE))
    line = F.coalesce(F.try_element_at(lines, F.lit(-1)), e)
    ends = F.split(line, "-")
    side = F.when(F.exists(rest, lambda x: F.lower(x).isin(*SIDES) & ~x.rlike(LINE)), F.lit("en")).otherwise(F.lit("zh"))
    last = F.coalesce(F.try_element_at(rest, F.lit(-1)), e)
    reader = F.when((last != "") & ~last.rlike(LINE) & ~F.lower(last).isin(*SIDES), decoded(last)).otherwise(e)

    owner = query_value(query, "user")
    legacy = (seg(1) != "") & (
        (F.size(kept) > 2) & (F.coalesce(F.get(kept, F.lit(2)), F.lit("x")) == "") & (seg(3) != "")
        | seg(1).rlike("(?i)^[0-9a-f]{24,}$")
        | (owner != "") & (seg(2) == ""))
    graph_at = F.when(legacy, seg(2)).otherwise(seg(3))
    graph = F.lower(graph_at) == "graph"
    collection = F.when(legacy, seg(1)).otherwise(seg(2))
    within = F.when(graph, e).otherwise(graph_at)
    keeper = F.when(legacy, F.when(seg(3) != "", seg(3)).otherwise(owner)).otherwise(seg(1))

    kind = (
        F.when(word == "scholar", F.when(graph, F.lit("scholar-graph")).otherwise(F.lit("scholar")))
        .when(word == "dict", F.lit("dictionary")).when(word == "term", F.lit("termbase"))
        .when(word.isin(*_PLAIN), word)
        .when(is_work, F.lit("passage")).otherwise(F.lit("unknown")))
    about_work = F.when(word.isin("tags", "compare"), part(1)).when(kind == "passage", part(0)).otherwise(e)
    user = (
        F.when(word == "scholar", keeper)
        .when(word.isin("term", "master"), text(2))
        .when(word == "tags", F.when(part(2) != "", text(2)).otherwise(owner))
        .when(kind == "passage", reader).otherwise(e))
    item = (
        F.when(word == "scholar", F.concat_ws("/", collection, F.when(within != "", within)))
        .when(word.isin("dict", "term"), text(1))
        .when(word == "master", F.replace(text(1), F.lit("_"), F.lit(" ")))
        .when(word == "masters", query_value(query, "school"))
        .when(word == "lineage", F.replace(query_value(query, "focus"), F.lit("_"), F.lit(" ")))
        .when(word == "tags", F.when(part(3) != "", text(3)).otherwise(query_value(query, "tagId", "tag")))
        .when(word == "search", query_value(query, "master"))
        .when((word == "compare") & (F.size(every) >= 5), F.concat_ws("/", F.lower(part(2)), text(3), text(4))).otherwise(e))
    start = F.when(kind == "passage", F.coalesce(F.get(ends, F.lit(0)), e)).when(word == "compare", query_value(query, "from")).otherwise(e)
    end = F.when(kind == "passage", F.coalesce(F.try_element_at(ends, F.lit(-1)), e)).when(word == "compare", query_value(query, "to")).otherwise(e)
    return F.when(F.size(every) > 0, F.struct(
        kind.alias("kind"), about_work.alias("work"), F.when(about_work != "", corpus_of_id(about_work)).otherwise(e).alias("corpus"),
        start.alias("start_line"), end.alias("end_line"), F.when(kind == "passage", side).otherwise(e).alias("side"),
        user.alias("user"), item.alias("item"), query_value(query, "q").alias("q")))


def described_route(route: Column) -> Column:
    """A short label of a parsed route."""
    g = route.getField
    dot = lambda head, c: F.concat(F.lit(head + " · "), c)
    span = F.concat(g("start_line"), F.when((g("end_line") != "") & (g("end_line") != g("start_line")), F.concat(F.lit("-"), g("end_line"))).otherwise(F.lit("")))
    return (
        F.when(g("kind") == "passage", F.when(g("start_line") != "", F.concat(g("work"), F.lit(" · "), span)).otherwise(g("work")))
        .when(g("kind") == "dictionary", dot("Dictionary", g("item"))).when(g("kind") == "termbase", dot("Termbase", g("item")))
        .when(g("kind") == "master", dot("Master", g("item"))).when(g("kind") == "masters", F.lit("Masters"))
        .when(g("kind") == "lineage", F.when(g("item") != "", dot("Lineage", g("item"))).otherwise(F.lit("Lineage")))
        .when(g("kind") == "scholar", dot("Scholar", F.split(g("item"), "/")[0])).when(g("kind") == "scholar-graph", F.lit("Scholar graph"))
        .when(g("kind") == "tags", dot("Tags", g("work"))).when(g("kind") == "search", dot("Search", g("q"))).when(g("kind") == "compare", dot("Compare", g("work")))
        .otherwise(F.lit("")))


def app_uri(raw: Column, scheme: str = "app") -> Column:
    return F.concat(F.lit(scheme + "://"), F.regexp_replace(raw, "^/+", ""))


def share_url(raw: Column, base: str) -> Column:
    """base with the route as its hash; the base alone for the empty route."""
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(base)).otherwise(F.concat(F.lit(base + "#/"), F.regexp_replace(raw, "^/+", "")))

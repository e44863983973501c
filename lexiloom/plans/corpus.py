"""Registered queries over lines, titles, persons and apparatus."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions import html, ids, routes, text
from lexiloom.operators import align, dictionary, kwic, lines, search
from lexiloom.plans import pages
from lexiloom.plans.index import family_records, index_records, postings, search_documents
from lexiloom.session import materialise, own_dir, table
from lexiloom.sources import files, markup

CJK_TERM, LATIN_TERM, PERSON_TERM, TITLE_TERM = "香", "the", "ost", "the"

_CLEAN = """cl AS (SELECT file_id, line_no, min(line_id) AS line_id, min(coalesce(text, '')) AS text, bool_or(coalesce(is_synthetic, false)) AS syn
  FROM text_lines WHERE file_id IS NOT NULL AND line_no IS NOT NULL GROUP BY file_id, line_no),
rl AS (SELECT file_id, line_no, line_id, text, row_number() OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS o FROM cl WHERE NOT syn)"""

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "text_lines")


@query(f"WITH {_CLEAN} SELECT file_id, line_no, line_id, text, o AS ordinal FROM rl")
def line_ordinals(s: SparkSession, d: str) -> DataFrame:
    return lines.with_ordinal(lines.real_lines(_lines(s, d)))


_RANGE = """r AS (SELECT *, coalesce(lag(line_id, 2) OVER w, lag(line_id, 1) OVER w, line_id) AS start_id,
  coalesce(lead(line_id, 2) OVER w, lead(line_id, 1) OVER w, line_id) AS end_id FROM rl WINDOW w AS (PARTITION BY file_id ORDER BY o))"""


@query(f"WITH {_CLEAN}, {_RANGE} SELECT file_id, line_no, line_id, start_id, end_id FROM r")
def kwic_line_range(s: SparkSession, d: str) -> DataFrame:
    return lines.cited_range(_lines(s, d))


def _kwic_sql(term: str, cjk: bool) -> str:
    k, sep = len(term), "" if cjk else " "
    if cjk:
        at = f"[i FOR i IN range(0, greatest(length(text) - {k} + 1, 0)) IF substr(text, i + 1, {k}) = '{term}']"
    else:
        at = f"[(list_sum([length(x) FOR x IN string_split(lower(text), '{term}')[1:i]]) + (i - 1) * {k})::INT FOR i IN range(1, len(string_split(lower(text), '{term}')))]"
    base = "SELECT * FROM rl WHERE text <> ''" if cjk else "SELECT * FROM rl"
    cut_l = "l" if cjk else "CASE WHEN length(l) = 40 AND strpos(l, ' ') > 1 AND strpos(l, ' ') < 40 THEN substr(l, strpos(l, ' ') + 1) ELSE l END"
    cut_r = "rr" if cjk else "CASE WHEN length(rr) = 40 AND strpos(rr, ' ') > 0 AND 40 - strpos(reverse(rr), ' ') > 0 THEN substr(rr, 1, 40 - strpos(reverse(rr), ' ')) ELSE rr END"
    return f"""WITH {_CLEAN}, {_RANGE}, b AS ({base}),
c AS (SELECT file_id, line_no, line_id, text, {at} AS places,
  string_agg(text, '{sep}') OVER (PARTITION BY file_id ORDER BY o ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) AS before,
  string_agg(text, '{sep}') OVER (PARTITION BY file_id ORDER BY o ROWS BETWEEN 1 FOLLOWING AND 40 FOLLOWING) AS after FROM b),
h AS (SELECT *, unnest(places) AS pos FROM c WHERE len(places) > 0),
x AS (SELECT *, right(coalesce(before || '{sep}', '') || substr(text, 1, pos), 40) AS l, left(substr(text, pos + {k} + 1) || coalesce('{sep}' || after, ''), 40) AS rr FROM h)
SELECT x.file_id, x.line_no, x.line_id, pos::INT AS pos, {cut_l} AS "left", substr(x.text, pos + 1, {k}) AS "match", {cut_r} AS "right", start_id, end_id
FROM x JOIN r USING (file_id, line_no)"""


@query(_kwic_sql(LATIN_TERM, False))
def kwic_latin(s: SparkSession, d: str) -> DataFrame:
    return kwic.kwic(_lines(s, d), LATIN_TERM)


@query(_kwic_sql(CJK_TERM, True))
def kwic_cjk(s: SparkSession, d: str) -> DataFrame:
    return kwic.kwic(_lines(s, d), CJK_TERM)


@query(_kwic_sql(LATIN_TERM, False) + " WHERE x.file_id IN (SELECT fileId FROM titles WHERE contains(lower(coalesce(en, '')), 'of'))")
def kwic_of_files(s: SparkSession, d: str) -> DataFrame:
    """Hits in the texts of the titles found alone."""
    only = table(s, d, "titles").filter(F.contains(F.lower("en"), F.lit("of"))).select(F.col("fileId").alias("file_id"))
    return kwic.kwic(_lines(s, d), LATIN_TERM, only=only)


@query(f"WITH {_CLEAN} SELECT file_id, line_no, line_id, text FROM rl WHERE o < 5")
def first_lines(s: SparkSession, d: str) -> DataFrame:
    return lines.first_lines(_lines(s, d), 5)


@query(f"""WITH {_CLEAN}, n AS (SELECT file_id, count(*) AS n FROM rl GROUP BY file_id)
SELECT file_id, line_no, line_id, text, o AS ordinal, CASE WHEN n <= 200 THEN 1 ELSE o // 50 + 1 END::INT AS page, CASE WHEN n <= 200 THEN 1 ELSE ceil(n / 50) END::INT AS pages FROM rl JOIN n USING (file_id)""")
def paginate(s: SparkSession, d: str) -> DataFrame:
    return lines.pages(lines.with_ordinal(lines.real_lines(_lines(s, d))), 50, whole_up_to=200)


@query(f"WITH {_CLEAN} SELECT file_id, coalesce(min(CASE WHEN contains(lower(text), 'the') THEN o END) // 50, 0)::INT + 1 AS page FROM rl GROUP BY file_id")
def first_page_of_term(s: SparkSession, d: str) -> DataFrame:
    rows = lines.with_ordinal(lines.real_lines(_lines(s, d)))
    return lines.page_of(rows, F.contains(F.lower("text"), F.lit("the")), 50)


def _ranges(s: SparkSession, d: str) -> DataFrame:
    """A range of each text: from its third line id by order to the eighth, and broken ones of some texts."""
    rows = lines.with_ordinal(lines.real_lines(_lines(s, d))).filter("ordinal in (2, 7)")
    g = rows.groupBy("file_id").agg(F.min(F.when(F.col("ordinal") == 2, F.col("line_id"))).alias("a"), F.min(F.when(F.col("ordinal") == 7, F.col("line_id"))).alias("b"))
    turned = F.length("file_id") % 2 == 1
    return g.filter("a is not null and b is not null").select(F.col("file_id").alias("range_id"), "file_id", F.when(turned, F.col("b")).otherwise(F.col("a")).alias("from_id"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("to_id"))


_RANGES = """g AS (SELECT file_id, min(CASE WHEN o = 2 THEN line_id END) AS a, min(CASE WHEN o = 7 THEN line_id END) AS b FROM rl WHERE o IN (2, 7) GROUP BY file_id),
q AS (SELECT file_id AS range_id, file_id, CASE WHEN length(file_id) % 2 = 1 THEN b ELSE a END AS from_id, CASE WHEN length(file_id) % 2 = 1 THEN a ELSE b END AS to_id FROM g WHERE a IS NOT NULL AND b IS NOT NULL)"""


@query(f"""WITH {_CLEAN}, {_RANGES}, n AS (SELECT q.*, a.line_no AS x, b.line_no AS y FROM q LEFT JOIN rl a ON a.file_id = q.file_id AND a.line_id = from_id LEFT JOIN rl b ON b.file_id = q.file_id AND b.line_id = to_id),
m AS (SELECT *, coalesce(y >= x, false) AS good FROM n)
SELECT range_id, m.file_id, line_no, line_id, text, NOT good AS fallback FROM m JOIN rl ON rl.file_id = m.file_id AND (NOT good OR line_no BETWEEN x AND y)""")
def slice_lines(s: SparkSession, d: str) -> DataFrame:
    return lines.slice_between(_lines(s, d), _ranges(s, d))


@query(f"""WITH {_CLEAN}, {_RANGES}, al AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS p FROM cl),
n AS (SELECT q.*, a.p AS x, CASE WHEN b.p >= a.p THEN b.p ELSE a.p END AS y FROM q LEFT JOIN al a ON a.file_id = q.file_id AND a.line_id = from_id LEFT JOIN al b ON b.file_id = q.file_id AND b.line_id = to_id),
t AS (SELECT range_id, p, text, coalesce(sum(length(text)) OVER (PARTITION BY range_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n JOIN al ON al.file_id = n.file_id AND p BETWEEN x AND y WHERE text <> ''),
j AS (SELECT range_id, string_agg(text, ' ' ORDER BY p) AS s FROM t WHERE before < 160 GROUP BY range_id)
SELECT n.range_id, CASE WHEN x IS NULL THEN '[line not found]' WHEN length(s) > 80 THEN substr(s, 1, 80) || '…' WHEN coalesce(s, '') = '' THEN '[empty]' ELSE s END AS snippet FROM n LEFT JOIN j USING (range_id)""")
def range_snippet(s: SparkSession, d: str) -> DataFrame:
    return lines.snippets(_lines(s, d), _ranges(s, d))


@query(f"""WITH {_CLEAN}, a AS (SELECT file_id, line_id, min(lem) AS t FROM apparatus WHERE lem IS NOT NULL GROUP BY file_id, line_id)
SELECT rl.file_id, rl.line_no, rl.line_id, rl.text, coalesce(a.t, '') AS translation FROM rl LEFT JOIN a ON a.file_id = rl.file_id AND a.line_id = rl.line_id""")
def bilingual_align(s: SparkSession, d: str) -> DataFrame:
    other = table(s, d, "apparatus").filter("lem is not null").select("file_id", "line_id", F.col("lem").alias("text"))
    return align.aligned(lines.real_lines(_lines(s, d)), other, ["file_id", "line_id"]).select("file_id", "line_no", "line_id", "text", "translation")


@query(f"""WITH {_CLEAN}, a AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY seq) - 1 AS o, lem FROM (SELECT file_id, seq, min(coalesce(lem, '')) AS lem FROM apparatus GROUP BY file_id, seq))
SELECT rl.file_id, rl.o AS ordinal, rl.text AS line, a.lem FROM rl JOIN a ON a.file_id = rl.file_id AND a.o = rl.o""")
def positional_zip(s: SparkSession, d: str) -> DataFrame:
    app = table(s, d, "apparatus").groupBy("file_id", "seq").agg(F.min(F.coalesce("lem", F.lit(""))).alias("lem"))
    return align.zipped({"line": lines.real_lines(_lines(s, d)).withColumnRenamed("line_no", "seq"), "lem": app.withColumnRenamed("lem", "text")}, "file_id", "seq", "text")


@query("""WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL)
SELECT doc_id, line_no::INT AS line_no, text FROM t""")
def lines_split(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))


# Titles and persons

_BLOB = "lower(coalesce(zh, '') || ' ' || coalesce(en, '') || ' ' || coalesce(enShort, '') || ' ' || coalesce(path, ''))"


@query(f"SELECT row_no, path, fileId, zh, en, enShort, zhHash, corpus FROM titles WHERE contains({_BLOB}, '{TITLE_TERM}') ORDER BY row_no LIMIT 50")
def title_search(s: SparkSession, d: str) -> DataFrame:
    return search.titles(table(s, d, "titles"), TITLE_TERM)


_LINED = "SELECT file_id FROM text_lines"


@query(f"SELECT row_no, path, fileId, zh, en, enShort, zhHash, corpus FROM titles WHERE fileId IN ({_LINED}) AND fileId NOT IN (SELECT file_id FROM apparatus WHERE file_id IS NOT NULL) ORDER BY row_no LIMIT 50")
def title_browse(s: SparkSession, d: str) -> DataFrame:
    ids_of = lambda t: table(s, d, t).filter("file_id is not null").select(F.col("file_id").alias("fileId"))
    return search.browse(table(s, d, "titles"), only=ids_of("text_lines"), without=ids_of("apparatus"))


@query("SELECT row_no, path, fileId FROM titles WHERE starts_with(path, 'T/') ORDER BY row_no LIMIT 50 OFFSET 0")
def title_folder(s: SparkSession, d: str) -> DataFrame:
    return search.browse(table(s, d, "titles"), folder="T").select("row_no", "path", "fileId")


@query("SELECT key, max(row_no) AS row_no FROM (SELECT row_no, unnest([path, fileId, regexp_replace(regexp_replace(path, '^([a-z]+)/([^/]+)/.*$', '\\1.\\2'), '^.*/([^/]+)\\.xml$', '\\1')]) AS key FROM titles WHERE path <> '') WHERE key <> '' GROUP BY key")
def titles_by_key(s: SparkSession, d: str) -> DataFrame:
    return files.over_keyed(table(s, d, "titles"))


@query("SELECT row_no, path, zh, en, corpus FROM titles QUALIFY row_number() OVER (PARTITION BY path ORDER BY row_no) = 1")
def titles_distinct(s: SparkSession, d: str) -> DataFrame:
    return align.first_of(table(s, d, "titles"), ["path"], [F.col("row_no")]).select("row_no", "path", "zh", "en", "corpus")


@query(f"SELECT row_no, names[1] AS name, school FROM masters WHERE len(list_filter(names, lambda n: contains(lower(n), '{PERSON_TERM}'))) > 0 ORDER BY row_no LIMIT 5")
def person_top5(s: SparkSession, d: str) -> DataFrame:
    return search.people(table(s, d, "masters"), PERSON_TERM).select("row_no", F.get("names", F.lit(0)).alias("name"), "school")


_P = """w AS (SELECT row_no, names FROM masters WHERE contains(lower(array_to_string(names, ' ')), 'tash') ORDER BY NOT starts_with(lower(array_to_string(names, ' ')), 'tash'), row_no LIMIT 3),
b AS (SELECT *, lower(coalesce(zh, '') || ' ' || coalesce(en, '') || ' ' || coalesce(path, '')) AS blob FROM titles WHERE fileId IS NOT NULL),
h AS (SELECT fileId, zh, row_no, 0 AS f, NULL AS pn, NULL AS an FROM b WHERE contains(blob, 'tash') QUALIFY row_number() OVER (PARTITION BY fileId ORDER BY row_no) = 1),
a AS (SELECT row_no AS pn, unnest(names) AS alias, generate_subscripts(names, 1) AS an FROM w),
m AS (SELECT fileId, zh, row_no, 1 AS f, pn, an FROM b JOIN a ON length(alias) >= 2 AND contains(blob, lower(alias)) WHERE fileId NOT IN (SELECT fileId FROM h) QUALIFY row_number() OVER (PARTITION BY fileId ORDER BY pn, an, row_no) = 1),
t AS (SELECT * FROM (SELECT * FROM h UNION ALL SELECT * FROM m) ORDER BY f, pn NULLS FIRST, an NULLS FIRST, row_no LIMIT 5)"""


@query(f"""WITH {_P} SELECT 'people' AS section, row_number() OVER (ORDER BY NOT starts_with(lower(array_to_string(names, ' ')), 'tash'), row_no)::INT AS rank, names[1] AS key, names[1] AS label FROM w
UNION ALL SELECT 'texts', row_number() OVER (ORDER BY f, pn NULLS FIRST, an NULLS FIRST, row_no)::INT, fileId, coalesce(zh, '') FROM t
UNION ALL SELECT 'fulltext', 1, 'tash', 'Search full text for “tash”'""")
def typeahead(s: SparkSession, d: str) -> DataFrame:
    return search.typeahead(table(s, d, "masters"), table(s, d, "titles"), "tash")


_ALIAS = "al AS (SELECT row_no AS pn, names[1] AS person, unnest(names) AS alias, generate_subscripts(names, 1) - 1 AS an FROM masters)"


@query(f"""WITH p AS (SELECT row_no, list_transform(names, lambda n: list_reverse(string_split(n, ' '))[1]) AS names FROM masters), al AS (SELECT row_no AS pn, unnest(names) AS alias, generate_subscripts(names, 1) - 1 AS an FROM p),
tb AS (SELECT *, lower(coalesce(zh, '') || ' ' || coalesce(en, '') || ' ' || coalesce(path, '')) AS blob FROM titles)
SELECT row_no, path, pn AS person_no, an::INT AS alias_no FROM tb JOIN al ON length(alias) >= 2 AND contains(blob, lower(alias)) QUALIFY row_number() OVER (PARTITION BY path ORDER BY pn, an, row_no) = 1""")
def alias_expansion(s: SparkSession, d: str) -> DataFrame:
    """Titles that hold the last word of a person's name, as aliases go."""
    people = table(s, d, "masters").withColumn("names", F.transform("names", lambda n: F.element_at(F.split(n, " "), -1)))
    return search.titles_of_people(people, table(s, d, "titles")).select("row_no", "path", "person_no", "alias_no")


@query(f"""WITH {_ALIAS}, pat AS (SELECT person, alias FROM al WHERE length(alias) >= 2 UNION SELECT person, w FROM (SELECT person, unnest(string_split(alias, ' ')) AS w FROM al) WHERE length(w) >= 7)
SELECT person, doc_id, sum((length(text) - length(replace(text, alias, ''))) // length(alias))::BIGINT AS n FROM documents JOIN pat ON contains(text, alias) GROUP BY person, doc_id""")
def person_mentions(s: SparkSession, d: str) -> DataFrame:
    return search.mentions(table(s, d, "documents"), table(s, d, "masters"), 7)


PHRASES = ("月", "鐘", "of the", "ed so", "བ")


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{q}' AS q, doc_id, file_id, ((length(text) - length(replace(lower(text), '{q}', ''))) // {len(q)})::INT AS hits FROM documents WHERE contains(lower(text), '{q}') ORDER BY hits DESC, doc_id LIMIT 300)" for q in PHRASES))
def phrase_search(s: SparkSession, d: str) -> DataFrame:
    """Phrases and parts of words of several scripts, found in the postings and then in the texts."""
    docs = table(s, d, "documents")
    index = materialise(postings(docs), "postings")
    found = [search.fulltext(docs, q, index=index).select(F.lit(q).alias("q"), "doc_id", "file_id", "hits") for q in PHRASES]
    return reduce(DataFrame.unionByName, found)


@query("""SELECT doc_id, file_id, ((length(text) - length(replace(lower(text), 'the', ''))) // 3)::INT AS hits FROM documents
WHERE contains(lower(text), 'the') AND source = 'canon' AND file_id IN (SELECT file_id FROM text_lines) ORDER BY hits DESC, doc_id LIMIT 300""")
def faceted_search(s: SparkSession, d: str) -> DataFrame:
    """Full text of one source, in the texts that have lines."""
    only = _lines(s, d).select(F.col("file_id").alias("fileId"))
    return search.fulltext(table(s, d, "documents"), "the", only=only, facets={"source": "canon"})


@query("""SELECT file_id, min(doc_id) AS first_doc, sum(greatest(hits, 1))::BIGINT AS hits FROM (SELECT doc_id, file_id, ((length(text) - length(replace(lower(text), 'cart', ''))) // 4)::INT AS hits FROM documents WHERE contains(lower(text), 'cart') ORDER BY hits DESC, doc_id LIMIT 300)
WHERE file_id <> '' GROUP BY file_id ORDER BY first_doc LIMIT 20""")
def hits_grouped(s: SparkSession, d: str) -> DataFrame:
    return search.grouped_hits(search.fulltext(table(s, d, "documents"), "cart"))


_FEDERATED = {}
for _name, _title, _text in (("all", "true", "true"), ("only", "fileId IN (SELECT fileId FROM kept)", "file_id IN (SELECT fileId FROM kept)")):
    _FEDERATED[_name] = f"""WITH kept AS (SELECT DISTINCT file_id AS fileId FROM text_lines WHERE file_id IS NOT NULL), w AS (SELECT row_no, names FROM masters WHERE len(list_filter(names, lambda n: contains(lower(n), 'kash'))) > 0 ORDER BY row_no LIMIT 5),
o AS (SELECT path, fileId, row_no FROM titles WHERE contains({_BLOB}, 'kash') AND {_title} ORDER BY row_no LIMIT 50),
a AS (SELECT row_no AS pn, unnest(names) AS alias, generate_subscripts(names, 1) AS an FROM w),
m AS (SELECT path, fileId, t.row_no, pn, an FROM titles t JOIN a ON length(alias) >= 2 AND contains(lower(coalesce(zh, '') || ' ' || coalesce(en, '') || ' ' || coalesce(path, '')), lower(alias)) WHERE path NOT IN (SELECT path FROM o) QUALIFY row_number() OVER (PARTITION BY path ORDER BY pn, an, t.row_no) = 1),
t AS (SELECT fileId FROM (SELECT path, fileId, row_no, 0 AS f, NULL AS pn, NULL AS an FROM o UNION ALL SELECT path, fileId, row_no, 1, pn, an FROM m WHERE {_title}) ORDER BY f, pn NULLS FIRST, an NULLS FIRST, row_no LIMIT 50),
x AS (SELECT doc_id FROM documents WHERE contains(lower(text), 'kash') AND {_text} ORDER BY ((length(text) - length(replace(lower(text), 'kash', ''))) // 4)::INT DESC, doc_id LIMIT 300)
SELECT 'people' AS section, row_no::VARCHAR AS key FROM w UNION ALL SELECT 'titles', coalesce(fileId, '') FROM t UNION ALL SELECT 'fulltext', doc_id::VARCHAR FROM x"""


def _federated(s: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    got = search.federated(table(s, d, "masters"), table(s, d, "titles"), table(s, d, "documents"), "kash", only=only)
    part = lambda name, key: got[name].select(F.lit(name).alias("section"), key.cast("string").alias("key"))
    return part("people", F.col("row_no")).unionByName(part("titles", F.coalesce("fileId", F.lit("")))).unionByName(part("fulltext", F.col("doc_id")))


@query(_FEDERATED["all"])
def federated_search(s: SparkSession, d: str) -> DataFrame:
    return _federated(s, d)


@query(_FEDERATED["only"])
def federated_within(s: SparkSession, d: str) -> DataFrame:
    """The same within the texts that have lines."""
    return _federated(s, d, _lines(s, d).select(F.col("file_id").alias("fileId")))


@query("""WITH n AS (SELECT teacher AS name FROM masters WHERE teacher IS NOT NULL UNION SELECT unnest(students) FROM masters), al AS (SELECT row_no, lower(unnest(names)) AS k FROM masters)
SELECT name, min(row_no) AS row_no FROM (SELECT DISTINCT name FROM n) JOIN al ON lower(replace(name, '_', ' ')) = k GROUP BY name""")
def person_by_name(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "masters")
    return search.person_named(m, m.filter("teacher is not null").select(F.col("teacher").alias("name")).unionByName(m.select(F.explode("students").alias("name"))))


@query("SELECT coalesce(school, '') AS school, count(*) AS n FROM masters WHERE contains(lower(array_to_string(names, ' ')), 'a') GROUP BY 1")
def person_browse(s: SparkSession, d: str) -> DataFrame:
    return search.people_of_school(table(s, d, "masters"), q="a").groupBy(text.text_or_empty("school").alias("school")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT school FROM masters WHERE school <> '' ORDER BY school")
def schools(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "masters").filter("school <> ''").select("school").distinct().orderBy("school")


@query(f"WITH {_CLEAN} SELECT file_id, line_no, regexp_replace(text, '(the)', '<mark>\\1</mark>', 'gi') AS marked, CASE WHEN contains(lower(text), 'the') THEN regexp_extract(text, '(?i)the') ELSE '' END AS term FROM rl")
def highlighted(s: SparkSession, d: str) -> DataFrame:
    m = text.highlight(F.col("text"), "the")
    return lines.real_lines(_lines(s, d)).select("file_id", "line_no", m.alias("marked"), text.marked_term(m).alias("term"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM documents")
def escaped_html(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.escape_html(F.col("text")).alias("escaped"))


_JSWS = "\\s\\x{000B}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"


@query(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13), ''), '[ \\t]*\\n[ \\t]*', chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), '^[{_JSWS}]+|[{_JSWS}]+$', '', 'g') AS normal FROM documents")
def normalized_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


_CORPUS = "CASE WHEN regexp_matches({0}, '^(ws|pd|ce|mit)\\.[A-Za-z0-9][A-Za-z0-9-]*$', 'i') THEN 'published' WHEN regexp_matches({0}, '^[A-Za-z]{{1,3}}[0-9]{{1,4}}n[A-Za-z]?[0-9]{{1,5}}[A-Za-z]?$') THEN 'canonical' ELSE 'unknown' END"


@query(f"""SELECT DISTINCT file_id, {_CORPUS.format('file_id')} AS corpus, CASE WHEN contains(file_id, '.') THEN split_part(file_id, '.', 1) || '/' || split_part(file_id, '.', 2) || '/' || split_part(file_id, '.', 2) || '.xml'
ELSE regexp_extract(file_id, '^[A-Za-z]+') || '/' || split_part(file_id, 'n', 1) || '/' || file_id || '.xml' END AS path FROM text_lines WHERE file_id IS NOT NULL""")
def id_infer(s: SparkSession, d: str) -> DataFrame:
    f = F.col("file_id")
    return _lines(s, d).filter("file_id is not null").select("file_id").distinct().select("file_id", ids.corpus_of_id(f).alias("corpus"), ids.path_of_id(f).alias("path"))


@query("""SELECT row_no, CASE WHEN split_part(path, '/', 1) IN ('ws', 'pd', 'ce', 'mit') THEN split_part(path, '/', 1) || '.' || split_part(path, '/', 2) ELSE regexp_replace(path, '^.*/([^/]+)\\.xml$', '\\1') END AS id,
CASE WHEN split_part(path, '/', 1) IN ('ws', 'pd', 'ce', 'mit') THEN 'published' ELSE 'canonical' END AS corpus, regexp_replace(path, '^.*/([^/]+)\\.xml$', '\\1') AS stem FROM titles WHERE path LIKE '%.xml'""")
def path_infer(s: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return table(s, d, "titles").filter("path like '%.xml'").select("row_no", ids.id_of_path(p).alias("id"), ids.corpus_of_path(p).alias("corpus"), ids.stem_of_path(p).alias("stem"))


@query("""SELECT DISTINCT names[1] AS name, replace(names[1], ' ', '_') AS plain, lower(replace(names[1], ' ', '_')) AS shard, regexp_replace(names[1], '\\s+', '_', 'g') AS page, lower(trim(translate(names[1], '_-', '  '))) AS folded FROM masters WHERE names[1] IS NOT NULL""")
def name_slugs(s: SparkSession, d: str) -> DataFrame:
    from lexiloom.operators.hierarchy import plain_name

    n = F.col("name")
    rows = table(s, d, "masters").select(F.get("names", F.lit(0)).alias("name")).filter("name is not null").distinct()
    return rows.select("name", ids.slug(n).alias("plain"), ids.slug(n, "shard").alias("shard"), ids.slug(n, "page").alias("page"), plain_name(n).alias("folded"))


@query("""WITH m AS (SELECT row_no, coalesce(floruit, 0) AS f, coalesce(death, 0) AS d FROM masters)
SELECT row_no, CASE WHEN f <> 0 AND d <> 0 THEN f || '–' || d WHEN f <> 0 THEN 'fl. ' || f WHEN d <> 0 THEN 'd. ' || d ELSE '' END AS dates, CASE WHEN f <> 0 AND d <> 0 THEN f || '-' || d WHEN d <> 0 THEN 'd. ' || d ELSE '' END AS short FROM m""")
def life_dates(s: SparkSession, d: str) -> DataFrame:
    f, e = F.col("floruit"), F.col("death")
    return table(s, d, "masters").select("row_no", text.life_dates(f, e).alias("dates"), text.life_dates(f, e, True).alias("short"))


def _cite_sql() -> str:
    parts = {
        "Chicago": "'“' || t || '.” Catalogue ' || w || '. Library. ' || u || '.'", "APA": "t || ' (' || w || '). Library. Retrieved from ' || u",
        "MLA": "'“' || t || '.” Library, ' || u || '. Accessed May 1, 2026.'",
        "BibTeX": "'@misc{library:' || w || ',' || chr(10) || '  title        = {' || t || '},' || chr(10) || '  howpublished = {' || u || '},' || chr(10) || '  note         = {Catalogue ' || w || '}' || chr(10) || '}'",
        "Catalogue": "w", "Other": "''"}
    rows = " UNION ALL ".join(f"SELECT row_no, '{k}' AS style, {v} AS citation FROM x" for k, v in parts.items())
    return f"WITH x AS (SELECT row_no, coalesce(en, zh, '') AS t, coalesce(fileId, '') AS w, 'https://library.example/#/' || coalesce(fileId, '') AS u FROM titles) {rows}"


@query(_cite_sql())
def citations(s: SparkSession, d: str) -> DataFrame:
    t, w = F.coalesce("en", "zh", F.lit("")), text.text_or_empty("fileId")
    u = F.concat(F.lit("https://library.example/#/"), w)
    styles = [F.struct(F.lit(k).alias("style"), text.citation(k, t, w, u, "May 1, 2026", "Library", "Catalogue").alias("citation")) for k in ("Chicago", "APA", "MLA", "BibTeX", "Catalogue", "Other")]
    return table(s, d, "titles").select("row_no", F.explode(F.array(*styles)).alias("c")).select("row_no", "c.*")


_MARK = "CASE WHEN regexp_matches(line_id, '^[0-9]{4}[abc][0-9]{2}$') THEN line_id ELSE '' END"


@query(f"""SELECT DISTINCT 'passage' AS kind, file_id AS work, {_CORPUS.format('file_id')} AS corpus, {_MARK} AS start_line, {_MARK} AS end_line, 'en' AS side, 'A b' AS "user", 'x y' AS q FROM text_lines
WHERE file_id IS NOT NULL AND line_id IS NOT NULL""")
def route_parse(s: SparkSession, d: str) -> DataFrame:
    """Routes to every line; ids that are no mark of a line say nothing."""
    raw = F.concat(F.col("file_id"), F.lit("/"), F.col("line_id"), F.lit("/en/A%20b?q=x+y"))
    rows = _lines(s, d).filter("file_id is not null and line_id is not null").select(routes.parsed_route(raw).alias("r"))
    return rows.select("r.kind", "r.work", "r.corpus", "r.start_line", "r.end_line", "r.side", "r.user", "r.q").distinct()


#: Routes of every kind for a title (n: its number, w: its text), and what they mean.
_ROUTES = (
    ("'dict/A%20b' || n", dict(kind="dictionary", item="'A b' || n", label="'Dictionary · A b' || n")),
    ("'/term/w' || n || '/U%20v'", dict(kind="termbase", user="U v", item="'w' || n", label="'Termbase · w' || n")),
    ("'master/A_b' || n || '/U'", dict(kind="master", user="U", item="'A b' || n", label="'Master · A b' || n")),
    ("'masters?school=S+' || n", dict(kind="masters", item="'S ' || n", label="'Masters'")),
    ("'lineage?focus=A_b' || n", dict(kind="lineage", item="'A b' || n", label="'Lineage · A b' || n")),
    ("'scholar/U/c' || n || '/p1'", dict(kind="scholar", user="U", item="'c' || n || '/p1'", label="'Scholar · c' || n")),
    ("'scholar/U/c' || n || '/graph'", dict(kind="scholar-graph", user="U", item="'c' || n", label="'Scholar graph'")),
    ("'tags/' || w || '/U/t' || n", dict(kind="tags", work="w", user="U", item="'t' || n", label="'Tags · ' || w")),
    ("'search?q=a+b' || n || '&master=M'", dict(kind="search", item="'M'", q="'a b' || n", label="'Search · a b' || n")),
    ("'compare/' || w || '/GH/a/b' || n || '?from=x&to=y'", dict(kind="compare", work="w", start_line="x", end_line="y", item="'gh/a/b' || n", label="'Compare · ' || w")),
    ("'nowhere/' || n", dict(kind="unknown", label="''")),
)
_ROUTE_SQL = " UNION ALL ".join(
    f"SELECT {raw} AS raw, '{m['kind']}' AS kind, {m.get('work', chr(39) * 2)} AS work, {_CORPUS.format('w') if 'work' in m else chr(39) * 2} AS corpus, '{m.get('start_line', '')}' AS start_line, '{m.get('end_line', '')}' AS end_line, '' AS side, "
    f"""'{m.get('user', '')}' AS "user", {m.get('item', chr(39) * 2)} AS item, {m.get('q', chr(39) * 2)} AS q, {m['label']} AS label FROM t""" for raw, m in _ROUTES)


@query(f"""WITH t AS (SELECT DISTINCT row_no AS n, fileId AS w FROM titles WHERE fileId <> '') SELECT *, 'https://x.example/#/' || regexp_replace(raw, '^/', '') AS url FROM ({_ROUTE_SQL})""")
def route_kinds(s: SparkSession, d: str) -> DataFrame:
    """Routes of every kind, with their parts, label and address to share."""
    t = table(s, d, "titles").filter("fileId <> ''").select(F.col("row_no").alias("n"), F.col("fileId").alias("w")).distinct()
    raw = t.select(F.explode(F.array(*[F.expr(r) for r, _ in _ROUTES])).alias("raw")).withColumn("r", routes.parsed_route(F.col("raw")))
    return raw.select("raw", "r.*", routes.described_route(F.col("r")).alias("label"), routes.share_url(F.col("raw"), "https://x.example/").alias("url"))


@query(f"""WITH {_CLEAN}, n AS (SELECT file_id, greatest(1, ceil(count(*) / 10))::INT AS total FROM rl GROUP BY file_id), p AS (SELECT file_id, total, unnest([1, (total + 1) // 2, total]) AS page FROM n)
SELECT DISTINCT file_id, page::INT AS page, array_to_string(list_sort(list_distinct(list_filter([1, total, page - 1, page, page + 1], lambda x: x >= 1 AND x <= total))), ' ') AS buttons FROM p""")
def page_numbers(s: SparkSession, d: str) -> DataFrame:
    """Buttons of the first, middle and last page of every text."""
    n = lines.pages(lines.with_ordinal(lines.real_lines(_lines(s, d))), 10).groupBy("file_id").agg(F.max("pages").alias("total"))
    rows = n.select("file_id", "total", F.explode(F.array_distinct(F.array(F.lit(1), F.floor((F.col("total") + 1) / 2).cast("int"), F.col("total")))).alias("page"))
    return rows.select("file_id", "page", F.array_join(lines.page_buttons(F.col("page"), F.col("total")), " ").alias("buttons"))


@query("""WITH g AS (SELECT left(zh, 1) AS c, count(*) AS n FROM titles WHERE zh <> '' GROUP BY 1), t AS (SELECT DISTINCT lem AS term FROM apparatus WHERE lem IS NOT NULL UNION SELECT left(zh, 1) FROM titles WHERE zh <> '')
SELECT term, CASE WHEN length(term) = 1 AND n IS NOT NULL THEN 'begins ' || n ELSE '' END AS functions FROM t LEFT JOIN g ON c = term""")
def dict_grammar(s: SparkSession, d: str) -> DataFrame:
    """Terms with the functions of their character: here, how many titles begin with it."""
    t = table(s, d, "titles").filter("zh <> ''").select(F.substring("zh", 1, 1).alias("char"))
    grammar = t.groupBy("char").agg(F.array(F.concat(F.lit("begins "), F.count(F.lit(1)))).alias("functions"))
    terms = table(s, d, "apparatus").filter("lem is not null").select(F.col("lem").alias("term")).unionByName(t.select(F.col("char").alias("term"))).distinct()
    return dictionary.with_grammar(terms, grammar).select("term", F.coalesce(F.array_join("functions", "|"), F.lit("")).alias("functions"))


# Markup of rows and cards, names and addresses

def _esc_sql(c: str) -> str:
    return f"replace(replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')"


@query(f"""SELECT file_id, line_no, CASE WHEN coalesce(is_synthetic, false) THEN '<div class="line-row spacer-row"></div>'
ELSE '<div class="line-row" data-line-id="' || {_esc_sql('line_id')} || '"><span class="line-id">' || {_esc_sql('line_id')} || '</span><span class="line-text">' || {_esc_sql('text')} || '</span></div>' END AS html FROM text_lines WHERE line_id IS NOT NULL""")
def line_rows(s: SparkSession, d: str) -> DataFrame:
    """Lines as the reader shows them; breaks as spacers."""
    shown = F.when(F.coalesce("is_synthetic", F.lit(False)), F.concat(F.lit("__pb_break_"), F.col("line_no"))).otherwise(F.col("line_id"))
    return _lines(s, d).filter("line_id is not null").select("file_id", "line_no", html.line_row(shown, F.col("text")).alias("html"))


@query(f"""SELECT row_no, '<a class="kwic-row" href="#/' || fileId || '/a' || CASE WHEN row_no % 2 = 0 THEN '-b' ELSE '' END || '?q=' || replace(url_encode(coalesce(zh, '')), '%20', '%20') || '"><span class="kwic-left">' || {_esc_sql('en')} || '</span><span class="kwic-match">' || {_esc_sql('zh')} || '</span><span class="kwic-right">' || {_esc_sql('enShort')} || '</span><span class="kwic-lb">a</span></a>' AS html FROM titles WHERE fileId <> ''""")
def kwic_rows(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "titles").filter("fileId <> ''")
    end = F.when(F.col("row_no") % 2 == 0, F.lit("b")).otherwise(F.lit("a"))
    return t.select("row_no", html.kwic_row(F.col("fileId"), F.lit("a"), end, F.lit("a"), F.col("en"), F.col("zh"), F.col("enShort"), F.coalesce("zh", F.lit(""))).alias("html"))


@query(f"""SELECT row_no, CASE WHEN zh IS NULL THEN '<article class="panel lookup-card lookup-card--empty"><header class="lookup-head"><h2 class="lookup-title">Not found</h2></header><p class="lookup-empty-detail">' || {_esc_sql('path')} || '</p></article>' ELSE
'<article class="panel lookup-card"><header class="lookup-head"><h2 class="lookup-title">' || {_esc_sql('zh')} || '</h2>' || CASE WHEN coalesce(en, '') <> '' THEN '<p class="lookup-subtitle">' || {_esc_sql('en')} || '</p>' ELSE '' END || '</header><div class="lookup-sections">'
|| '<div class="lookup-section"><p class="lookup-section-heading">Forms</p><div class="lookup-section-body"><ul class="lookup-list"><li>' || {_esc_sql('zh')} || '</li><li>' || {_esc_sql('corpus')} || '</li></ul></div></div>'
|| CASE WHEN enShort IS NOT NULL THEN '<div class="lookup-section"><p class="lookup-section-heading">Short</p><div class="lookup-section-body"><p class="lookup-paragraph">' || {_esc_sql('enShort')} || '</p></div></div>' ELSE '' END || '</div></article>' END AS html FROM titles""")
def lookup_cards(s: SparkSession, d: str) -> DataFrame:
    sections = [("Forms", html.card_list(F.array("zh", "corpus"))), ("Short", html.card_paragraph(F.col("enShort")))]
    card = F.when(F.col("zh").isNull(), html.empty_card(F.lit(""), F.col("path"))).otherwise(html.lookup_card(F.col("zh"), sections, F.col("en")))
    return table(s, d, "titles").select("row_no", card.alias("html"))


@query(f"""SELECT DISTINCT fileId AS file_id, CASE {_CORPUS.format('fileId')} WHEN 'published' THEN 'https://b.example/' || split_part(fileId, '.', 1) || '/' || p || '/' || p || '.xml' WHEN 'canonical' THEN 'https://a.example/' || regexp_replace(split_part(fileId, 'n', 1), '[0-9]', '', 'g') || '/' || split_part(fileId, 'n', 1) || '/' || fileId || '.xml' END AS source,
CASE {_CORPUS.format('fileId')} WHEN 'published' THEN 'https://d.example/x/A%20b!/' || split_part(fileId, '.', 1) || '/' || p || '/' || p || '.xml' WHEN 'canonical' THEN 'https://c.example/A%20b!/' || regexp_replace(split_part(fileId, 'n', 1), '[0-9]', '', 'g') || '/' || split_part(fileId, 'n', 1) || '/' || fileId || '.xml' END AS community
FROM (SELECT fileId, regexp_replace(fileId, '^[^.]+\\.', '') AS p FROM titles WHERE fileId IS NOT NULL)""")
def work_urls(s: SparkSession, d: str) -> DataFrame:
    w = F.col("fileId")
    one = dict(zip(ids.KINDS, ("https://a.example/", "https://b.example")))
    two = dict(zip(ids.KINDS, ("https://c.example/", "https://d.example/x")))
    return table(s, d, "titles").filter("fileId is not null").select(w.alias("file_id"), ids.work_url(w, one).alias("source"), ids.work_url(w, two, F.lit("A b!")).alias("community")).distinct()


@query(f"""WITH p AS (SELECT DISTINCT p.id AS id, p.summary AS summary, p.zhText AS zh FROM (SELECT unnest(passages) AS p FROM collections) WHERE p IS NOT NULL)
SELECT id, coalesce(regexp_replace(left(coalesce(nullif(summary, ''), nullif(zh, '')), 50), '^[{_JSWS}]+|[{_JSWS}]+$', '', 'g'), id, '') AS name, CASE WHEN coalesce(id, '') = '' THEN '—' WHEN id = 'p0' THEN 'Community · p0' ELSE 'Community · ' || id END AS source,
CASE WHEN coalesce(id, '') = '' THEN 'Community translation' ELSE 'Translation by ' || id END AS mode FROM p""")
def passage_names(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "collections").select(F.explode("passages").alias("p")).filter("p is not null").select("p.id", "p.summary", "p.zhText").distinct()
    i = F.col("id")
    return p.select("id", text.passage_name(F.col("summary"), F.col("zhText"), i).alias("name"), text.described_source(i).alias("source"), text.described_mode(F.lit("en"), i).alias("mode"))


@query(f"""WITH {_CLEAN}, p AS (SELECT rl.file_id, coalesce(min(CASE WHEN contains(lower(text), 'the') THEN o END) // 20, 0)::INT + 1 AS a, coalesce(min(CASE WHEN contains(lower(coalesce(t, '')), 'an') THEN o END) // 20, 0)::INT + 1 AS b, count(*) AS n FROM rl
LEFT JOIN (SELECT file_id, line_id, min(lem) AS t FROM apparatus WHERE lem IS NOT NULL GROUP BY file_id, line_id) x USING (file_id, line_id) GROUP BY rl.file_id)
SELECT file_id, CASE WHEN a = 1 THEN b WHEN b = 1 THEN a ELSE least(a, b) END AS page, least(ceil(n / 20)::INT, 7) AS asked FROM p""")
def bilingual_page(s: SparkSession, d: str) -> DataFrame:
    """Where a text and its translation open for a term, and page 7 held within the pages there are."""
    other = table(s, d, "apparatus").filter("lem is not null").select("file_id", "line_id", F.col("lem").alias("text"))
    rows = lines.with_ordinal(lines.real_lines(_lines(s, d)))
    both = align.aligned(rows, other, ["file_id", "line_id"])
    a = lines.page_of(both, F.contains(F.lower("text"), F.lit("the")), 20).withColumnRenamed("page", "a")
    b = lines.page_of(both, F.contains(F.lower("translation"), F.lit("an")), 20).withColumnRenamed("page", "b")
    n = lines.pages(rows, 20).groupBy("file_id").agg(F.max("pages").alias("n"))
    return a.join(b, "file_id").join(n, "file_id").select("file_id", lines.start_page(F.col("a"), F.col("b")).alias("page"), lines.clamped(F.lit(7), F.col("n")).alias("asked"))


_FAMILY = f"""f AS (SELECT file_id, text, 'source' AS family, NULL AS translator FROM documents WHERE file_id IS NOT NULL AND lang = 'zh' UNION ALL SELECT file_id, text, 'translation', NULL FROM documents WHERE file_id IS NOT NULL AND lang = 'en'
UNION ALL SELECT file_id, text, 'community', source FROM documents WHERE file_id IS NOT NULL AND coalesce(lang, '') NOT IN ('zh', 'en') AND source IS NOT NULL),
t AS (SELECT fileId AS file_id, nullif(zh, '') AS zh, nullif(en, '') AS en, path FROM titles WHERE fileId IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fileId ORDER BY row_no) = 1),
c AS (SELECT *, {_CORPUS.format('f.file_id')} <> 'published' AS canonical, f.file_id IN (SELECT file_id FROM f WHERE family = 'translation' AND text <> '') AS has, f.file_id IN (SELECT file_id FROM text_lines WHERE file_id IS NOT NULL) AS pick FROM f LEFT JOIN t USING (file_id) WHERE text <> '')"""


@query(f"""WITH {_FAMILY} SELECT '/' || file_id || CASE family WHEN 'source' THEN '' WHEN 'community' THEN '?side=community&translator=' || translator ELSE '?side=en' END AS url, length(text)::INT AS size, CASE WHEN family = 'source' THEN 'zh' ELSE 'en' END AS language,
CASE WHEN family = 'source' THEN coalesce(zh, file_id) ELSE coalesce(en, zh, file_id) END AS title, coalesce(CASE WHEN family = 'source' THEN en ELSE zh END, '') AS title_other, file_id, CASE WHEN canonical OR family = 'community' THEN 'canonical' ELSE 'published' END AS corpus,
CASE WHEN family = 'source' THEN has ELSE true END AS translated, CASE WHEN family <> 'source' THEN family END AS side, CASE WHEN family <> 'community' THEN pick AND canonical END AS chosen,
CASE WHEN family = 'source' THEN CASE WHEN NOT canonical THEN 'published' ELSE coalesce(nullif(split_part(path, '/', 1), ''), 'T') END END AS collection, CASE WHEN family = 'community' THEN translator END AS translator FROM c""")
def index_five(s: SparkSession, d: str) -> DataFrame:
    """The records of all five families: Chinese documents as sources, English ones as translations, others as those of users."""
    docs = table(s, d, "documents").filter("file_id is not null")
    family = F.when(F.col("lang") == "zh", "source").when(F.col("lang") == "en", "translation").when(F.col("source").isNotNull(), "community")
    texts = docs.select("file_id", "text", family.alias("family"), F.when(family == "community", F.col("source")).alias("translator")).filter("family is not null")
    rows = family_records(texts, table(s, d, "titles"), _lines(s, d).filter("file_id is not null"))
    return rows.select("url", F.length("content").alias("size"), *[c for c in rows.columns if c not in ("url", "content")])


# Files: the nations written as files, one each, and read back

def _nation_files(s: SparkSession, d: str, kind: str) -> str:
    path = f"{own_dir(s)}/nations-{uuid.uuid4().hex}"
    rows = table(s, d, "nation").select("n_regionkey", F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))
    rows = rows.repartition("n_regionkey")
    if kind == "xml":
        rows = rows.select("n_regionkey", F.concat(F.lit("<x>"), "name", F.lit("</x>")).alias("value"))
        rows.write.option("maxRecordsPerFile", 1).partitionBy("n_regionkey").text(path)
    else:
        rows.write.option("maxRecordsPerFile", 1).partitionBy("n_regionkey").json(path)
    return path


@query("SELECT '<x>' || n_name || '</x>' AS xml, 'n_regionkey=' || n_regionkey AS folder FROM nation")
def files_whole(s: SparkSession, d: str) -> DataFrame:
    """Whole files of a folder, at any depth."""
    return files.read_documents(s, _nation_files(s, d, "xml"), "*.txt").select(F.trim(F.regexp_replace("xml", "\n", "")).alias("xml"), F.element_at(F.split("path", "/"), -2).alias("folder"))


@query("SELECT n_name AS name, n_nationkey::INT AS key FROM nation")
def files_json(s: SparkSession, d: str) -> DataFrame:
    """A JSON document a file."""
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("key", T.IntegerType())])
    return files.read_json(s, _nation_files(s, d, "json"), schema).select("name", "key")


@query("SELECT 'n_regionkey=' || n_regionkey AS owner, count(*) AS files FROM nation WHERE length(n_name) + 8 > 14 GROUP BY 1")
def files_owned(s: SparkSession, d: str) -> DataFrame:
    """Files that hold something, listed without reading them, by the folder they are in."""
    rows = files.nonempty(files.listed(s, _nation_files(s, d, "xml"), "*.txt"), 14)
    return files.owners(rows).join(rows.select(F.element_at(F.split("path", "/"), -2).alias("owner")), "owner").groupBy("owner").agg(F.count(F.lit(1)).alias("files"))


# Apparatus

_APP = "ap AS (SELECT file_id, seq, any_value(line_id) AS line_id, any_value(readings) AS readings FROM apparatus GROUP BY file_id, seq)"


@query(f"""WITH {_APP}, r AS (SELECT file_id, unnest(readings) AS r FROM ap), w AS (SELECT file_id, r.text, unnest(string_split_regex(r.wit, '\\s+')) AS g FROM r)
SELECT a.file_id, a.entries, coalesce(b.witnesses, 0) AS witnesses FROM (SELECT file_id, count(*) AS entries FROM ap GROUP BY file_id) a
LEFT JOIN (SELECT file_id, count(DISTINCT regexp_replace(g, '^#', '')) AS witnesses FROM w WHERE regexp_replace(g, '^#', '') <> '' GROUP BY file_id) b USING (file_id)""")
def variant_counts(s: SparkSession, d: str) -> DataFrame:
    entries = table(s, d, "apparatus").dropDuplicates(["file_id", "seq"])
    each = align.witnesses(entries.select("file_id", F.explode("readings").alias("r")).select("file_id", "r.wit"))
    n = each.groupBy("file_id").agg(F.count_distinct("siglum").alias("witnesses"))
    return entries.groupBy("file_id").agg(F.count(F.lit(1)).alias("entries")).join(n, "file_id", "left").fillna(0, ["witnesses"])


@query(f"""WITH {_APP}, r AS (SELECT file_id, seq, unnest(readings) AS r, generate_subscripts(readings, 1) AS k FROM ap),
w AS (SELECT file_id, seq, k, unnest(string_split_regex(r.wit, '\\s+')) AS g, generate_subscripts(string_split_regex(r.wit, '\\s+'), 1) AS i FROM r WHERE r.wit IS NOT NULL)
SELECT file_id, seq, (k - 1)::INT AS k, string_agg(CASE regexp_replace(g, '^#', '') WHEN 'wit1' THEN 'First print' WHEN 'wit3' THEN 'Third print' ELSE regexp_replace(g, '^#', '') END, ', ' ORDER BY i) AS witnesses FROM w WHERE regexp_replace(g, '^#', '') <> '' GROUP BY file_id, seq, k""")
def witness_labels(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "apparatus").dropDuplicates(["file_id", "seq"]).select("file_id", "seq", F.posexplode("readings").alias("k", "r")).select("file_id", "seq", "k", "r.wit").filter("wit is not null")
    labels = s.createDataFrame([("wit1", "First print"), ("wit3", "Third print")], "siglum string, label string")
    return align.witness_labels(rows, labels, ["file_id", "seq", "k"])


# Dictionary: entries from the titles, words from the apparatus

# Every third line is written in another form of its last character, every fifth has no brackets; brackets hold slashes.
_LINE = "replace(zh, ' ', '_') || ' ' || CASE WHEN row_no % 3 = 0 THEN left(replace(zh, ' ', '_'), char_length(zh) - 1) || '简' ELSE replace(zh, ' ', '_') END || CASE WHEN row_no % 5 = 4 THEN '' ELSE ' [t' || row_no || '/u]' END || ' (x) /' || coalesce(en, '') || '/' || coalesce(enShort, '') || '/'"
_ENTRY = """e AS (SELECT row_no, replace(zh, ' ', '_') AS trad, CASE WHEN row_no % 3 = 0 THEN left(replace(zh, ' ', '_'), length(zh) - 1) || '简' ELSE replace(zh, ' ', '_') END AS simp, 't' || row_no || '/u' AS pinyin,
list_filter(list_transform(string_split(coalesce(en, '') || '/' || coalesce(enShort, '') || '/', '/'), lambda x: trim(x)), lambda x: x <> '') AS defs FROM titles WHERE zh <> '' AND row_no % 5 <> 4 AND regexp_matches(coalesce(en, '') || coalesce(enShort, ''), '[^/ ]'))"""


def _entries(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "titles").filter("zh <> ''")
    return dictionary.parsed_entries(t.select("row_no", F.expr(_LINE).alias("line")))


@query(f"WITH {_ENTRY} SELECT row_no, trad, simp, pinyin, array_to_string(defs, '|') AS defs FROM e")
def dict_parse(s: SparkSession, d: str) -> DataFrame:
    return _entries(s, d).select("row_no", "trad", "simp", "pinyin", F.array_join("defs", "|").alias("defs"))


@query(f"WITH {_ENTRY} SELECT substr(trad, 1, 1) AS first_char, (unicode(trad) % 201)::INT AS bucket, count(*) AS n FROM e GROUP BY 1, 2")
def dict_group(s: SparkSession, d: str) -> DataFrame:
    return dictionary.character_index(_entries(s, d))


@query(f"""WITH {_ENTRY}, t AS (SELECT DISTINCT lem AS term FROM apparatus WHERE lem <> '' UNION SELECT zh FROM titles WHERE zh <> '' UNION SELECT left(zh, length(zh) - 1) || '简' FROM titles WHERE zh <> '')
SELECT term, row_no, trad, pinyin FROM t JOIN e ON term = trad OR term = simp AND left(term, 1) = left(trad, 1)""")
def dict_lookup(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "titles").filter("zh <> ''")
    terms = table(s, d, "apparatus").select(F.col("lem").alias("term")).unionByName(t.select(F.col("zh").alias("term"))).unionByName(t.selectExpr("left(zh, char_length(zh) - 1) || '简' AS term"))
    return dictionary.looked_up(terms, _entries(s, d)).select("term", "row_no", "trad", "pinyin")


@query(f"""WITH {_ENTRY}, t AS (SELECT DISTINCT zh AS term FROM titles WHERE zh <> ''), f AS (SELECT term, e.* FROM t JOIN e ON term = trad),
d AS (SELECT term, row_no, unnest(defs) AS def, generate_subscripts(defs, 1) AS i FROM f), g AS (SELECT term, def, min((row_no, i)) AS o FROM d GROUP BY term, def),
s AS (SELECT term, string_agg(def, '|' ORDER BY o) AS defs FROM g GROUP BY term)
SELECT term, string_agg(pinyin, '|' ORDER BY row_no) AS pinyin, count(*) AS n, any_value(s.defs) AS defs, count(DISTINCT trad) + count(DISTINCT simp) FILTER (simp <> trad) AS forms FROM f JOIN s USING (term) GROUP BY term""")
def dict_merged(s: SparkSession, d: str) -> DataFrame:
    found = dictionary.looked_up(table(s, d, "titles").select(F.col("zh").alias("term")), _entries(s, d))
    return dictionary.merged_senses(found).select("term", F.array_join("pinyin", "|").alias("pinyin"), F.size("pinyin").cast("long").alias("n"), F.array_join("defs", "|").alias("defs"), F.size("forms").cast("long").alias("forms"))


@query(f"""WITH {_CLEAN}, w AS (SELECT DISTINCT lem FROM apparatus WHERE lem <> ''), p AS (SELECT file_id, line_no, unnest([substr(text, 1, 1), substr(text, 1, 2), substr(text, 1, 3), substr(text, 1, 4)]) AS x FROM rl)
SELECT file_id || '#' || line_no AS key, arg_max(x, length(x)) AS found FROM p WHERE x IN (SELECT lem FROM w) GROUP BY 1""")
def longest_prefix(s: SparkSession, d: str) -> DataFrame:
    words = table(s, d, "apparatus").filter("lem <> ''").select(F.col("lem").alias("trad"), F.col("lem").alias("simp"))
    rows = lines.real_lines(_lines(s, d)).select(F.concat_ws("#", "file_id", "line_no").alias("key"), "text")
    return dictionary.longest_prefix(rows, words)


# Markup: every document's text is written as markup and read back

def _markup(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").filter(~F.col("text").rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f￾￿]"))
    body = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><lb n="1"/><head>'), text.escape_html(F.col("title")), F.lit('</head><lb n="2"/>'), F.replace(F.replace(text.escape_html(F.col("text")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("<pb/>")), F.lit("<note>n</note></body></text></TEI>"))
    return rows.select(F.col("doc_id").cast("string").alias("file_id"), body.alias("xml"))


@query(f"""WITH m AS (SELECT doc_id::VARCHAR AS file_id, text, coalesce(title, '') AS title FROM documents WHERE NOT regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')),
l AS (SELECT file_id, '1' AS line_id, title AS t, false AS is_synthetic FROM m UNION ALL SELECT file_id, '2', replace(replace(text, chr(13), ''), chr(10), ''), false FROM m
UNION ALL SELECT file_id, '__pb_break_' || unnest(range(0, length(text) - length(replace(text, chr(10), '')))), '', true FROM m)
SELECT file_id, line_id, regexp_replace(regexp_replace(replace(t, chr(13), ''), '[ \\t]{{2,}}', ' ', 'g'), '^[{_JSWS}]+|[{_JSWS}]+$', '', 'g') AS text, is_synthetic FROM l""")
def markup_lines(s: SparkSession, d: str) -> DataFrame:
    return markup.lines(markup.parsed(_markup(s, d))).select("file_id", "line_id", "text", "is_synthetic")


@query("SELECT doc_id::VARCHAR AS file_id, '1' AS line_id, title AS text, 1 AS level FROM documents WHERE title <> '' AND NOT regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')")
def markup_headings(s: SparkSession, d: str) -> DataFrame:
    return markup.headings(markup.parsed(_markup(s, d))).select("file_id", "line_id", "text", "level")


@query("""SELECT doc_id::VARCHAR AS file_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(coalesce(title, '') || '  ' || replace(text, chr(10), ' ') || ' n', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;'), chr(13), ''), chr(9), ' '), '[ \\f\\v]+', ' ', 'g')) AS content
FROM documents WHERE NOT regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')""")
def body_text(s: SparkSession, d: str) -> DataFrame:
    return _markup(s, d).select("file_id", markup.index_text(F.col("xml")).alias("content"))


# Markup of texts with apparatus: a document for every entry, with another edition, a division, notes, a contents mark, verse, a glyph, an anchored entry at the end

def _entries_markup(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "apparatus").dropDuplicates(["file_id", "seq"])
    esc = lambda c: text.escape_html(F.coalesce(c, F.lit("")))
    readings = F.array_join(F.transform(F.coalesce("readings", F.array().cast(e.schema["readings"].dataType)), lambda r: F.concat(
        F.lit('<rdg wit="'), esc(r["wit"]), F.when(r["text"].isNull(), F.lit('"/>')).otherwise(F.concat(F.lit('">'), esc(r["text"]), F.lit("<note>no</note></rdg>"))))), "")
    seq = F.col("seq").cast("string")
    parts = [
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0" xmlns:cb="http://x.example"><teiHeader><fileDesc><titleStmt><title xml:lang="zh-Hant">'), esc("lem"), F.lit('</title><title xml:lang="en">E '), seq,
        F.lit('</title></titleStmt></fileDesc><listWit><witness xml:id="w1"> '), esc("line_id"), F.lit(' </witness></listWit></teiHeader><text><body><lb n="1" ed="X"/><lb n="9" ed="R"/><cb:juan n="'), seq,
        F.lit('"/><head>H<note>no<lb n="8"/></note>'), seq, F.lit("</head>xx<app><lem>"), esc("lem"), F.lit("</lem>"), readings, F.lit('</app><caesura/><g ref="#g">字</g>y<anchor xml:id="beg1"/>z<cb:mulu>M</cb:mulu><lg><l>v</l></lg><pb/></body>'),
        F.lit('<back><app from="#beg1"><lem>'), esc("lem"), F.lit('</lem><rdg wit="w9">'), esc("line_id"), F.lit('</rdg></app><app from="#none"><lem>z</lem></app></back></text></TEI>')]
    return e.select(F.concat_ws("#", "file_id", "seq").alias("file_id"), F.concat(*parts).alias("xml"))


_TEI = f"""ap AS (SELECT file_id || '#' || seq AS file_id, seq, any_value(line_id) AS line_id, coalesce(any_value(lem), '') AS lem, any_value(readings) AS readings FROM apparatus GROUP BY file_id, seq),
x AS (SELECT *, 'H' || seq || 'xx' AS before, 'H' || seq || 'xx' || lem || '　字y' AS upto FROM ap)"""


def _normal(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '[ \\t]*\\n[ \\t]*', chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), '^[{_JSWS}]+|[{_JSWS}]+$', '', 'g')"



@query(f"""WITH {_TEI} SELECT file_id, 0 AS line_no, '1' AS line_id, {_normal("upto || 'zv'")} AS text, false AS is_synthetic FROM x
UNION ALL SELECT file_id, i::INT, '__' || k || '_break_' || (i - 1), '', true FROM x, (VALUES (1, 'lg'), (2, 'lg'), (3, 'pb')) AS b(i, k)""")
def tei_lines(s: SparkSession, d: str) -> DataFrame:
    return markup.lines(markup.parsed(_entries_markup(s, d)))


@query(f"WITH {_TEI} SELECT file_id, 0 AS seq, '1' AS line_id, 'H' || seq AS text, 1 AS level, seq::VARCHAR AS juan FROM x")
def tei_headings(s: SparkSession, d: str) -> DataFrame:
    return markup.headings(markup.parsed(_entries_markup(s, d)))


@query(f"""WITH {_TEI} SELECT file_id, 0 AS seq, '1' AS line_id, length(before)::INT AS pos, lem, coalesce(array_to_string(list_transform(readings, lambda r: coalesce(r.wit, '') || '=' || coalesce(r.text, '')), '|'), '') AS readings FROM x WHERE lem <> '' OR len(readings) > 0
UNION ALL SELECT file_id, CASE WHEN lem <> '' OR len(readings) > 0 THEN 1 ELSE 0 END, '1', length(upto)::INT, lem, 'w9=' || line_id FROM x""")
def tei_apparatus(s: SparkSession, d: str) -> DataFrame:
    """Entries in the text, and those at the end at the places they are anchored to."""
    rows = markup.apparatus(markup.parsed(_entries_markup(s, d)))
    return rows.withColumn("readings", F.array_join(F.transform("readings", lambda r: F.concat(r["wit"], F.lit("="), r["text"])), "|"))


@query(f"WITH {_TEI} SELECT file_id, CASE WHEN {_normal('lem')} <> '' THEN {_normal('lem')} ELSE 'E ' || seq END AS title_zh, 'E ' || seq AS title_en, 'w1' AS wit_id, trim(line_id) AS label FROM x")
def tei_header(s: SparkSession, d: str) -> DataFrame:
    """Titles and witnesses."""
    rows = markup.parsed(_entries_markup(s, d))
    return rows.select("file_id", "title_zh", "title_en").join(markup.witnesses(rows), "file_id")


# Index build

@query("""WITH t AS (SELECT fileId, zh, en, path, row_no FROM titles WHERE fileId IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fileId ORDER BY row_no) = 1), l AS (SELECT DISTINCT file_id FROM text_lines)
SELECT doc_id, coalesce(nullif(zh, ''), file_id, '') AS title, coalesce(en, '') AS title_en, coalesce(d.file_id, '') AS file_id, coalesce(source, '') AS side, d.file_id IN (SELECT file_id FROM l WHERE file_id IS NOT NULL) AND d.file_id IS NOT NULL AS translated,
CASE WHEN path IS NULL THEN 'T' ELSE split_part(path, '/', 1) END AS collection, length(d.text)::INT AS size FROM documents d LEFT JOIN t ON d.file_id = t.fileId WHERE d.text <> ''""")
def search_docs(s: SparkSession, d: str) -> DataFrame:
    return search_documents(table(s, d, "documents"), table(s, d, "titles"), _lines(s, d)).select("doc_id", "title", "title_en", "file_id", "side", "translated", "collection", F.length("content").alias("size"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{Latin}\\p{Nd}][\\p{Latin}\\p{M}\\p{Nd}]*')) AS token FROM documents
UNION ALL SELECT doc_id, unnest(CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END) FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\\p{Latin}\\p{M}\\p{Nd}\\p{P}\\p{S}\\p{Z}\\p{C}][^\\p{Latin}\\p{Nd}\\p{P}\\p{S}\\p{Z}\\p{C}]*')) AS r FROM documents)) SELECT token, count(DISTINCT doc_id) AS docs, count(*) AS n FROM t GROUP BY 1""")
def index_postings(s: SparkSession, d: str) -> DataFrame:
    return postings(table(s, d, "documents")).groupBy("token").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))


@query("""SELECT coalesce(source, '') AS side, count(*) AS docs FROM documents WHERE text <> '' GROUP BY 1 UNION ALL SELECT 'title', count(*) FROM titles WHERE coalesce(zh, en) <> ''""")
def index_families(s: SparkSession, d: str) -> DataFrame:
    return index_records(table(s, d, "documents"), table(s, d, "titles"), _lines(s, d)).groupBy("side").agg(F.count(F.lit(1)).alias("docs"))


# Pages

_ESC = "replace(replace(replace(replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')"
_PERSON = """one AS (SELECT *, coalesce(floruit, 0) AS f, coalesce(death, 0) AS e FROM masters WHERE names[1] IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(trim(translate(names[1], '_-', '  '))) ORDER BY row_no) = 1)"""


@query(f"""WITH {_PERSON} SELECT row_no, names[1] AS name, concat_ws(' | ', CASE WHEN school <> '' THEN 'School: ' || {_ESC.format('school')} END, CASE WHEN f <> 0 AND e <> 0 THEN f || '-' || e WHEN e <> 0 THEN 'd. ' || e END,
CASE WHEN teacher <> '' THEN 'Teacher: ' || {_ESC.format('teacher')} END, CASE WHEN array_to_string(students, ', ') <> '' THEN 'Students: ' || {_ESC.format("array_to_string(students, ', ')")} END) AS facts FROM one""")
def person_facts(s: SparkSession, d: str) -> DataFrame:
    return pages.person_facts(table(s, d, "masters")).select("row_no", "name", "facts")


@query(f"""WITH {_PERSON} SELECT row_no, {_ESC.format("concat_ws(' ', names[1], nullif(names[2], ''))")} AS heading, {_ESC.format('school')} AS school, {_ESC.format('teacher')} AS teacher, array_to_string(list_filter(string_split({_ESC.format("array_to_string(students, ', ')")}, ', '), lambda x: x <> ''), ', ') AS students FROM one""")
def person_scrape(s: SparkSession, d: str) -> DataFrame:
    """Pages written and read back."""
    got = pages.scraped(pages.person_facts(table(s, d, "masters")).select("row_no", "html"))
    return got.select("row_no", "heading", "school", "teacher", F.array_join("students", ", ").alias("students"))


@query(f"""WITH {_PERSON}, r AS (SELECT '' AS route UNION ALL SELECT DISTINCT fileId FROM titles WHERE fileId <> '' UNION ALL SELECT 'person/' || regexp_replace(replace(names[1], chr(39), ''), '\\s+', '_', 'g') FROM one)
SELECT route, '<url><loc>https://x.example/' || route || '</loc><lastmod>2026-01-01</lastmod><priority>' || CASE WHEN route = '' THEN '1.0' WHEN starts_with(route, 'person/') THEN '0.6' ELSE '0.8' END || '</priority></url>' AS line FROM r""")
def sitemap(s: SparkSession, d: str) -> DataFrame:
    return pages.sitemap(pages.routes_of(table(s, d, "masters"), table(s, d, "titles")), "https://x.example", "2026-01-01")


@query("""WITH t AS (SELECT *, coalesce(nullif(en, ''), nullif(enShort, ''), '') AS e, coalesce(zh, '') AS z FROM titles WHERE fileId <> '' QUALIFY row_number() OVER (PARTITION BY fileId ORDER BY row_no) = 1)
SELECT fileId AS file_id, CASE WHEN e <> '' THEN e || ' (' || z || ')' ELSE z END || ' - Library' AS title, 'Read ' || CASE WHEN e <> '' THEN e || ' (' || z || ')' ELSE z END || ' on Library.' AS description FROM t""")
def title_pages(s: SparkSession, d: str) -> DataFrame:
    return pages.title_pages(table(s, d, "titles"), "Library")


@query(f"""WITH {_PERSON} SELECT names[1] AS name, coalesce(names[2], '') AS other, coalesce(school, '') AS school, regexp_replace(replace(names[1], chr(39), ''), '\\s+', '_', 'g') AS slug,
CASE WHEN f <> 0 AND e <> 0 THEN f || '-' || e WHEN e <> 0 THEN 'd. ' || e ELSE '' END AS dates FROM one""")
def person_index(s: SparkSession, d: str) -> DataFrame:
    """Persons in the order of Unicode's rules; the order itself is tested apart."""
    return pages.person_index(table(s, d, "masters"))


@query(ORACLE["person_mentions"].replace("SELECT person, doc_id, sum(", "SELECT person, count(DISTINCT doc_id) AS documents, sum(").replace("GROUP BY person, doc_id", "GROUP BY person").replace("::BIGINT AS n", "::BIGINT AS total_mentions"))
def person_shards(s: SparkSession, d: str) -> DataFrame:
    return pages.person_shards(search.mentions(table(s, d, "documents"), table(s, d, "masters"), 7)).select("person", "documents", "total_mentions")


@query("""WITH c AS (SELECT file_id, count(*)::INT AS stars FROM apparatus GROUP BY file_id) SELECT row_no, fileId, coalesce(stars, 0)::INT AS stars FROM titles LEFT JOIN c ON file_id = fileId""")
def star_counts(s: SparkSession, d: str) -> DataFrame:
    counts = table(s, d, "apparatus").groupBy(F.col("file_id").alias("fileId")).agg(F.count(F.lit(1)).cast("int").alias("stars"))
    return pages.starred(table(s, d, "titles").select("row_no", "fileId"), counts, "fileId")


@query("""SELECT fileId, relPath FROM (SELECT DISTINCT fileId FROM titles WHERE fileId <> '') t JOIN (SELECT DISTINCT p.sourceRelPath AS relPath FROM (SELECT unnest(passages) AS p FROM collections) WHERE p.sourceRelPath IS NOT NULL) r
ON lower(relPath) = lower(fileId) || '.xml' OR ends_with(lower(relPath), '/' || lower(fileId) || '.xml') OR (contains(fileId, '.') AND (lower(relPath) = lower(split_part(fileId, '.', 2)) || '.xml' OR ends_with(lower(relPath), '/' || lower(split_part(fileId, '.', 2)) || '.xml')))""")
def path_match(s: SparkSession, d: str) -> DataFrame:
    """Paths that collections quote from, however written, with the works they name: by file name first, then verified."""
    works = table(s, d, "titles").filter("fileId <> ''").select("fileId").distinct()
    names = F.array_distinct(F.array(F.lower("fileId"), F.when(F.contains("fileId", F.lit(".")), F.lower(F.regexp_extract("fileId", r"^[^.]+\.([^.]+)", 1)))))
    works = works.withColumn("name", F.explode(F.filter(names, lambda x: x.isNotNull())))
    paths = table(s, d, "collections").select(F.explode("passages").alias("p")).select(F.col("p.sourceRelPath").alias("relPath")).filter("relPath is not null").distinct()
    paths = paths.withColumn("name", F.lower(ids.stem_of_path(F.col("relPath"))))
    return works.join(paths, "name").filter(ids.same_work(F.col("relPath"), F.col("fileId"))).select("fileId", "relPath").distinct()


@query("""WITH a AS (SELECT DISTINCT file_id FROM text_lines WHERE file_id IS NOT NULL), b AS (SELECT DISTINCT file_id FROM documents WHERE file_id IS NOT NULL)
SELECT file_id, file_id IN (SELECT * FROM a) AS in_lines, file_id IN (SELECT * FROM b) AS in_documents FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def id_sets(s: SparkSession, d: str) -> DataFrame:
    one = lambda t, c: table(s, d, t).filter("file_id is not null").select("file_id", F.lit(c == 0).alias("a"), F.lit(c == 1).alias("b"))
    return one("text_lines", 0).unionByName(one("documents", 1)).groupBy("file_id").agg(F.bool_or("a").alias("in_lines"), F.bool_or("b").alias("in_documents"))


@query()
def random_pick(s: SparkSession, d: str) -> DataFrame:
    """One title, picked by seed."""
    return pages.picked(table(s, d, "titles").select("row_no", "path"), "row_no", 7)

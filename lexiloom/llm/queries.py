"""Registered queries of the operators on training text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm import leaks, mixing, sentences, skeleton, spans, stuffing
from lexiloom.session import materialise, table


def _looks(spark: SparkSession, d: str):
    """Source, rows, key and text of what is compared by look."""
    yield "documents", table(spark, d, "documents"), F.col("doc_id").cast("string"), "text"
    yield "text_lines", table(spark, d, "text_lines").filter("text <> ''"), F.concat_ws("#", "file_id", "line_no"), "text"


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    shapes = skeleton.prototypes(skeleton.public_table(spark))
    tagged = [skeleton.look_alike_pairs(rows, key, text, shapes).select(F.lit(src).alias("src"), "key_a", "key_b") for src, rows, key, text in _looks(spark, d)]
    readings = skeleton.look_alike_readings(table(spark, d, "apparatus"), shapes)
    return tagged[0].unionByName(tagged[1]).unionByName(readings.select(F.lit("apparatus").alias("src"), "key_a", "key_b"))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose text has another form that looks the same, with its class, and the forms and rows of that."""
    shapes = skeleton.prototypes(skeleton.public_table(spark))
    tagged = [skeleton.look_classes(rows, key, text, shapes).select(F.lit(src).alias("src"), "key", "class", "forms", "members") for src, rows, key, text in _looks(spark, d)]
    return tagged[0].unionByName(tagged[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


def p3_docs(spark: SparkSession, d: str) -> DataFrame:
    """Per document, how much of it is shared elsewhere."""
    docs = table(spark, d, "documents")
    return spans.shared_amount(docs, spans.shared_spans(docs))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with score, share held, and whether the answer is there too."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """Of the leaks those where the document has the whole item letter for letter, but for case and white space: none of these may be missed."""
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    plain = lambda c: F.lower(F.regexp_replace(c, "[ \\t\\n\\r\\f]+", " "))
    near = p7_found(spark, d).join(docs.select("doc_id", plain("text").alias("t")), "doc_id").join(items.select("item_id", plain("text").alias("i")), "item_id")
    return near.filter(F.contains("t", F.col("i"))).select("doc_id", "item_id").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents")).select("doc_id", "sent_start", "sent_end")


def p2_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The units of every document in order, with their number."""
    return sentences.sentence_units(table(spark, d, "documents"))


def p2_cover(spark: SparkSession, d: str) -> DataFrame:
    """By document with units: the characters seen in them, and whether none overlaps the one before it or begins or ends with white space."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = p2_sentences(spark, d).join(docs, "doc_id")
    unit = F.substring("text", F.col("sent_start") + 1, F.col("sent_end") - F.col("sent_start"))
    after = F.lag("sent_end").over(Window.partitionBy("doc_id").orderBy("sent_no"))
    each = rows.select("doc_id", F.length(F.translate(unit, sentences.OUTER, "")).alias("seen"), ((F.coalesce(after, F.lit(0)) <= F.col("sent_start")) & (F.length(unit) == F.length(F.trim(unit)))).alias("parted"))
    return each.groupBy("doc_id").agg(F.sum("seen").alias("seen"), F.bool_and("parted").alias("parted"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "documents")).select("doc_id")


def p9_links(spark: SparkSession, d: str) -> DataFrame:
    """Of the flagged pages those of twenty words and more of which over four fifths are tags or addresses: none of these may be missed."""
    words = F.filter(F.split("text", "[ \\t\\n\\r\\f]+"), lambda w: w != "")
    linked = F.filter(words, lambda w: w.rlike("^#|://"))
    rows = table(spark, d, "documents").join(p9_found(spark, d), "doc_id", "left_semi")
    return rows.filter((F.size(words) >= 20) & (F.size(linked) * 5 > F.size(words) * 4)).select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Perplexity and abnormal share of every page."""
    return stuffing.page_scores(table(spark, d, "documents"))


def vocabulary(spark: SparkSession) -> str:
    """Path of the rank file by which tokens are counted, as the session names it in ``spark.lexiloom.vocabulary``."""
    return spark.conf.get("spark.lexiloom.vocabulary", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), vocabulary(spark))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixing.shares(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """By source with records whether the mixture keeps its word: every use once and of a record of the source, no record too often, no place twice, and the share met but for one record."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    mixed = materialise(p8_mix(spark, d), "mixture")
    own = docs.select("doc_id", F.col("source").alias("own"))
    each = mixed.join(own, "doc_id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id", "repeat_no").alias("once"), F.count_distinct("shard", "position").alias("places"), F.count_if(F.col("own") == F.col("source")).alias("known"),
        F.max("repeat_no").alias("most"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # over the targets' few rows
    share = F.sum("target_share").over(Window.partitionBy(F.lit(0)))
    rows = targets.join(docs.select("source").distinct(), "source", "left_semi").join(each, "source", "left")
    slack = F.sum("longest").over(Window.partitionBy(F.lit(0)))
    return rows.select(
        "source", (F.col("n") == F.col("once")).alias("every_use_once"), (F.col("n") == F.col("places")).alias("every_place_once"), (F.col("n") == F.col("known")).alias("from_source"),
        (F.col("most") < F.coalesce("max_repeats", F.lit(1))).alias("within_repeats"), (F.abs(F.col("tokens") - whole * F.col("target_share") / share) <= slack).alias("share_met"))


QUERIES = {
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_kept": p8_kept,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_links": p9_links,
    "p2_found": p2_found,
    "p2_sentences": p2_sentences,
    "p2_cover": p2_cover,
    "p7_found": p7_found, "p7_leaks": p7_leaks, "p7_verbatim": p7_verbatim, "p3_found": p3_found, "p3_docs": p3_docs, "p6_found": p6_found, "p6_classes": p6_classes}

_SPANS = """w AS (SELECT doc_id, unnest(range(0, length(text) - 99)) AS p, text FROM documents WHERE length(text) >= 100),
r AS (SELECT doc_id, p, md5(substr(text, p + 1, 100)) AS h FROM w),
s AS (SELECT doc_id, p FROM r WHERE h IN (SELECT h FROM r GROUP BY h HAVING min(doc_id) < max(doc_id))),
m AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER o + 100 THEN 0 ELSE 1 END AS fresh FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM m),
spans AS (SELECT doc_id, min(p)::INT AS span_start, (max(p) + 100)::INT AS span_end FROM i GROUP BY doc_id, k)"""



def _looks_sql() -> dict[str, str]:
    """Skeletons as a join of characters with the built-in table; canonically equal forms are left to nfc_normalize."""
    shapes = {c: to for c, to in skeleton.prototypes().items() if unicodedata.normalize("NFC", to) != unicodedata.normalize("NFC", c)}
    listed = ", ".join(f"({ord(c)}, '{to.replace(chr(39), chr(39) * 2)}')" for c, to in sorted(shapes.items()))
    ctes = f"""WITH shape(cp, form) AS (VALUES {listed}),
t AS (SELECT 'documents' AS src, doc_id::VARCHAR AS key, text FROM documents WHERE text IS NOT NULL UNION SELECT 'text_lines', file_id || '#' || line_no, text FROM text_lines WHERE text <> ''
  UNION SELECT 'lem', file_id || '#' || seq, lem FROM apparatus WHERE lem IS NOT NULL UNION SELECT 'apparatus', file_id || '#' || seq || '#' || r.wit, r.text FROM (SELECT file_id, seq, unnest(readings) AS r FROM apparatus) WHERE r.text IS NOT NULL AND r.wit IS NOT NULL),
u AS (SELECT DISTINCT text FROM t), c AS (SELECT text, unnest(string_split(nfc_normalize(text), '')) AS ch, unnest(range(length(nfc_normalize(text)))) AS i FROM u),
s AS (SELECT text, nfc_normalize(coalesce(string_agg(coalesce(form, ch), '' ORDER BY i), '')) AS look FROM c LEFT JOIN shape ON cp = unicode(ch) GROUP BY text),
l AS (SELECT src, key, t.text, coalesce(look, '') AS look FROM t LEFT JOIN s USING (text))"""
    return {
        "p6_found": f"""{ctes} SELECT DISTINCT a.src, a.key AS key_a, b.key AS key_b FROM l a JOIN l b ON a.src = b.src AND a.look = b.look AND a.text <> b.text AND a.key < b.key WHERE a.src IN ('documents', 'text_lines')
UNION ALL SELECT DISTINCT 'apparatus', a.key, substr(b.key, length(a.key) + 2) FROM l a JOIN l b ON a.src = 'lem' AND b.src = 'apparatus' AND a.look = b.look AND a.text <> b.text AND starts_with(b.key, a.key || '#')""",
        "p6_classes": f"""{ctes}, k AS (SELECT src, look, min(key) AS class, count(DISTINCT text) AS forms, count(*) AS members FROM l GROUP BY src, look HAVING count(DISTINCT text) > 1)
SELECT src, key, class, forms, members FROM l JOIN k USING (src, look) WHERE src IN ('documents', 'text_lines')""",
    }


_OUTER = " || ".join(f"chr({ord(c)})" for c in sentences.OUTER)

ORACLE: dict[str, str] = _looks_sql() | {
    "p2_cover": f"""SELECT doc_id, sum(length(translate(text, {_OUTER}, '')))::BIGINT AS seen, true AS parted FROM documents WHERE length(translate(text, {_OUTER}, '')) > 0 GROUP BY doc_id""",
    "p9_links": """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id FROM w WHERE len(w) >= 20 AND len(list_filter(w, lambda x: regexp_matches(x, '^#|://'))) * 5 > len(w) * 4""",
    "p7_verbatim": """WITH d AS (SELECT doc_id, lower(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS t FROM documents), i AS (SELECT item_id, lower(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS x FROM eval_items WHERE trim(text) <> '')
SELECT DISTINCT doc_id, item_id FROM d JOIN i ON contains(t, x)""",
    "p8_kept": """SELECT source, true AS every_use_once, true AS every_place_once, true AS from_source, true AS within_repeats, true AS share_met
FROM mix_targets WHERE source IN (SELECT source FROM documents)""",
    "p3_found": f"WITH {_SPANS} SELECT doc_id, span_start, span_end FROM spans",
    "p3_docs": f"""WITH {_SPANS}, t AS (SELECT doc_id, sum(span_end - span_start) AS c, count(*) AS n, max(span_end - span_start) AS l FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(c, 0)::BIGINT AS shared_chars, coalesce(n, 0)::BIGINT AS n_spans, coalesce(l, 0)::BIGINT AS longest_span,
CASE WHEN length(text) > 0 THEN coalesce(c, 0)::DOUBLE / length(text) ELSE 0.0 END AS shared_ratio FROM documents d LEFT JOIN t USING (doc_id)""",
}

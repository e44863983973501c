"""Search over people, titles and full text, and presentation of its results."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import is_ideographic, text_or_empty
from lexiloom.operators.hierarchy import plain_name

#: Patterns, and characters of patterns, that one automaton holds; more are searched in blocks.
AUTOMATON_PATTERNS, AUTOMATON_CHARS = 100_000, 4_000_000


def blob(*columns: str) -> Column:
    """Lower-case text of several columns, a blank between them, null as empty."""
    return F.lower(F.concat_ws(" ", *[text_or_empty(c) for c in columns]))


def distinct_people(persons: DataFrame) -> DataFrame:
    """One row a person: the first of those with the same first name."""
    w = Window.partitionBy(plain_name(F.get("names", F.lit(0)))).orderBy("row_no")
    return persons.filter(F.get("names", F.lit(0)).isNotNull()).withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def people(persons: DataFrame, q: str, top: int = 5) -> DataFrame:
    """The first ``top`` rows, in file order, with a name that contains q; none for the empty q."""
    hit = F.exists("names", lambda n: F.contains(F.lower(n), F.lit(q.lower())))
    return persons.filter(hit & F.lit(bool(q))).orderBy("row_no").limit(top)


def titles(rows: DataFrame, q: str, corpus: str | None = None, only: DataFrame | None = None, without: DataFrame | None = None, top: int = 50) -> DataFrame:
    """The first ``top`` titles whose names or path contain q; all for the empty q.

    ``only`` and ``without`` are tables with a fileId column that keep or exclude texts.
    """
    hit = rows.filter(F.contains(blob("zh", "en", "enShort", "path"), F.lit(q.lower())))
    if corpus:
        hit = hit.filter(F.col("corpus") == corpus)
    if only is not None:
        hit = hit.join(only.select("fileId").distinct(), "fileId", "left_semi")
    if without is not None:
        hit = hit.join(without.select("fileId").distinct(), "fileId", "left_anti")
    return hit.orderBy("row_no").limit(top)


def browse(rows: DataFrame, corpus: str | None = None, folder: str | None = None, only: DataFrame | None = None, without: DataFrame | None = None, page: int = 1, size: int = 50) -> DataFrame:
    """A page of titles by corpus or first path segment, with and without the texts of two id tables."""
    hit = rows
    if corpus:
        hit = hit.filter(F.col("corpus") == corpus)
    if folder:
        hit = hit.filter(F.startswith("path", F.lit(folder + "/")))
    if only is not None:
        hit = hit.join(only.select("fileId").distinct(), "fileId", "left_semi")
    if without is not None:
        hit = hit.join(without.select("fileId").distinct(), "fileId", "left_anti")
    return hit.orderBy("row_no").offset((page - 1) * size).limit(size)


def contained(texts: DataFrame, patterns: DataFrame, text: str = "text", pattern: str = "pattern", block: int = AUTOMATON_PATTERNS) -> DataFrame:
    """Rows of texts with (pattern, n): every pattern that a text contains, and how often.

    Each block of about ``block`` patterns at most, and AUTOMATON_CHARS characters, is one automaton that runs once over every text, so
    that no text is compared with pattern after pattern. Occurrences of one pattern do not overlap.
    Null and empty texts and patterns match nothing.
    """
    spark = texts.sparkSession
    wanted = patterns.select(F.col(pattern).alias("p")).filter("p is not null and p <> ''").distinct()
    n, chars = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("p")), F.lit(0))).first()
    parts = max(1, -(-n // block), -(-chars // AUTOMATON_CHARS))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + ", pattern string, n int"
    found = None
    for part in range(parts):
        own = wanted if parts == 1 else wanted.filter(F.pmod(F.xxhash64("p"), F.lit(parts)) == part)
        listed = spark.sparkContext.broadcast([r[0] for r in own.collect()])  # at most a block

        def run(batches: Iterator[pa.RecordBatch], listed=listed) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for p in listed.value:
                automaton.add_word(p, p)
            if not len(automaton):
                return
            automaton.make_automaton()
            for batch in batches:
                rows, names, counts = [], [], []
                for i, t in enumerate(batch.column(text).to_pylist()):
                    if not t:
                        continue
                    n: dict[str, int] = {}
                    last: dict[str, int] = {}
                    for end, p in automaton.iter(t):
                        if end - len(p) >= last.get(p, -1):
                            n[p], last[p] = n.get(p, 0) + 1, end
                    rows += [i] * len(n)
                    names += n.keys()
                    counts += n.values()
                kept = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(names, pa.string()), pa.array(counts, pa.int32())], names=[*kept.schema.names, "pattern", "n"])

        each = texts.mapInArrow(run, schema)
        found = each if found is None else found.unionByName(each)
    return found


def titles_of_people(found: DataFrame, rows: DataFrame, top: int | None = None) -> DataFrame:
    """Titles that contain an alias, of two characters at least, of the people found; each path once.

    Adds person_no and alias_no of the first alias in file order that the title contains.
    """
    alias = found.select(F.col("row_no").alias("person_no"), F.posexplode("names").alias("alias_no", "alias")).filter(F.length("alias") >= 2).withColumn("pattern", F.lower("alias"))
    near = contained(rows.withColumn("_blob", blob("zh", "en", "path")), alias, "_blob").drop("n", "_blob")
    near = near.join(alias.select("person_no", "alias_no", "pattern"), "pattern").drop("pattern")
    first = Window.partitionBy("path").orderBy("person_no", "alias_no", "row_no")
    near = near.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")
    return near.orderBy("person_no", "alias_no", "row_no").limit(top) if top else near


def federated(persons: DataFrame, title_rows: DataFrame, documents: DataFrame, q: str, corpus: str | None = None, only: DataFrame | None = None, index: DataFrame | None = None, facets: dict[str, object] | None = None) -> dict[str, DataFrame]:
    """people, titles (those found, then those of the people found, 50 in all) and full text of one query.

    ``only`` (a table with a fileId column) restricts titles and full text; ``index`` and ``facets`` are those of ``fulltext``.
    """
    who = people(persons, q)
    own = titles(title_rows, q, corpus, only).withColumn("_from", F.lit(0))
    more = titles_of_people(who, title_rows).join(own.select("path"), "path", "left_anti").withColumn("_from", F.lit(1))
    if only is not None:
        more = more.join(only.select("fileId").distinct(), "fileId", "left_semi")
    both = own.unionByName(more, allowMissingColumns=True).orderBy("_from", "person_no", "alias_no", "row_no").limit(50).drop("person_no", "alias_no", "_from")
    return {"people": who, "titles": both, "fulltext": fulltext(documents, q, index=index, only=only, facets=facets)}


# A word of Latin letters or digits, and a run of other letters.
_WORD = r"[\p{IsLatin}\p{Nd}][\p{IsLatin}\p{M}\p{Nd}]*"
_RUN = r"[^\p{IsLatin}\p{M}\p{Nd}\p{P}\p{S}\p{Z}\p{C}][^\p{IsLatin}\p{Nd}\p{P}\p{S}\p{Z}\p{C}]*"


def tokens(text: Column) -> Column:
    """Tokens of a text in any script: words of Latin letters in lower case, of runs of other letters every two neighbours, or the only one."""
    low = F.lower(text)
    pairs = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2))))
    return F.concat(F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)), F.flatten(F.transform(F.regexp_extract_all(low, F.lit(_RUN), F.lit(0)), pairs)))


def candidates(index: DataFrame, q: str) -> DataFrame:
    """doc_id of the documents that may contain ``q``, from postings (token, doc_id) with the tokens of ``tokens``.

    Words within the query must stand as they are; its first may be the end, its last the
    begin, a single one a part of a word. None is missed; what lies between tokens is not looked at.
    """
    spark = index.sparkSession
    low = F.lower(F.lit(q))
    words, runs, whole = spark.range(1).select(F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)), F.regexp_extract_all(low, F.lit(_RUN), F.lit(0)), low).first()
    while whole and unicodedata.category(whole[0])[0] == "M":  # the rest of a word's letter
        whole = whole[1:]
    asked = []
    for w in dict.fromkeys(words):
        begins, ends = whole.startswith(w), whole.endswith(w)
        t = F.col("token")
        asked.append(F.contains(t, F.lit(w)) if begins and ends else F.endswith(t, F.lit(w)) if begins else F.startswith(t, F.lit(w)) if ends else t == w)
    for r in runs:
        asked += [F.contains("token", F.lit(r))] if len(r) == 1 else [F.col("token") == r[i: i + 2] for i in range(len(r) - 1)]
    if not asked:
        return index.select("doc_id").distinct()
    met = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(asked)]), lambda k: k.isNotNull())
    near = index.select("doc_id", met.alias("met")).filter(F.size("met") > 0).select("doc_id", F.explode("met").alias("k"))
    return near.groupBy("doc_id").agg(F.count_distinct("k").alias("n")).filter(F.col("n") == len(asked)).select("doc_id")


def fulltext(documents: DataFrame, q: str, top: int = 300, index: DataFrame | None = None, only: DataFrame | None = None, facets: dict[str, object] | None = None) -> DataFrame:
    """doc_id, file_id, hits: the ``top`` documents by number of occurrences of q, then id.

    Ideographic queries match as they are, others in any case; the empty query finds nothing.
    ``index``: postings of the documents, which keep all others from being read for the text.
    ``only``: a table with a fileId column. ``facets``: values that columns of the documents must have.
    """
    text, term = (F.col("text"), q) if is_ideographic(q) else (F.lower("text"), q.lower())
    if not q:
        documents, term = documents.filter(F.lit(False)), " "
    for column, value in (facets or {}).items():
        documents = documents.filter(F.col(column) == value)
    if only is not None:
        documents = documents.join(only.select(F.col("fileId").alias("file_id")).distinct(), "file_id", "left_semi")
    if index is not None and q:
        documents = documents.join(candidates(index, q), "doc_id", "left_semi")
    hits = (F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)
    found = documents.filter(F.contains(text, F.lit(term))).select("doc_id", "file_id", hits.cast("int").alias("hits"))
    return found.orderBy(F.col("hits").desc(), "doc_id").limit(top)


def typeahead(persons: DataFrame, title_rows: DataFrame, q: str) -> DataFrame:
    """section, rank, key, label: three people, those that begin with q first; five texts; and the full-text row."""
    low = q.lower()
    own = persons.withColumn("_b", F.lower(F.array_join("names", " "))).filter(F.contains("_b", F.lit(low)))
    who = own.orderBy(~F.startswith("_b", F.lit(low)), "row_no").limit(3).drop("_b")
    rows = title_rows.filter("fileId is not null")
    hit = rows.filter(F.contains(blob("zh", "en", "path"), F.lit(low)))
    first = hit.withColumn("_rank", F.row_number().over(Window.partitionBy("fileId").orderBy("row_no"))).filter("_rank = 1").withColumn("_from", F.lit(0)).drop("_rank")
    more = titles_of_people(who, rows)
    more = more.withColumn("_rank", F.row_number().over(Window.partitionBy("fileId").orderBy("person_no", "alias_no", "row_no"))).filter("_rank = 1").drop("_rank")
    more = more.join(first.select("fileId"), "fileId", "left_anti").withColumn("_from", F.lit(1))
    texts = first.unionByName(more, allowMissingColumns=True).orderBy("_from", "person_no", "alias_no", "row_no").limit(5)
    ranked = lambda d, *by: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by))  # noqa: E731  (over at most five rows)
    a = who.withColumn("_b", F.lower(F.array_join("names", " "))).select(
        F.lit("people").alias("section"), ranked(who, ~F.startswith("_b", F.lit(low)), "row_no").alias("rank"), F.get("names", F.lit(0)).alias("key"), F.get("names", F.lit(0)).alias("label"))
    b = texts.select(F.lit("texts").alias("section"), ranked(texts, "_from", "person_no", "alias_no", "row_no").alias("rank"), F.col("fileId").alias("key"), text_or_empty("zh").alias("label"))
    c = title_rows.sparkSession.range(1).select(F.lit("fulltext").alias("section"), F.lit(1).alias("rank"), F.lit(q).alias("key"), F.lit(f"Search full text for “{q}”").alias("label"))
    return a.unionByName(b).unionByName(c)


def grouped_hits(hits: DataFrame, top: int = 20) -> DataFrame:
    """file_id, first_doc, hits of the ``top`` files, in the order of their first hit; a hit counts once at least."""
    files = hits.filter("file_id <> ''").groupBy("file_id").agg(F.min("doc_id").alias("first_doc"), F.sum(F.greatest("hits", F.lit(1))).cast("long").alias("hits"))
    return files.orderBy("first_doc").limit(top)


def person_named(persons: DataFrame, names: DataFrame) -> DataFrame:
    """The first person, in file order, of each name: name, row_no; underscores are blanks, case does not count."""
    alias = persons.select("row_no", F.explode("names").alias("alias")).select("row_no", F.lower("alias").alias("k"))
    asked = names.select("name", F.lower(F.replace("name", F.lit("_"), F.lit(" "))).alias("k")).distinct()
    return asked.join(alias, "k").groupBy("name").agg(F.min("row_no").alias("row_no"))


def people_of_school(persons: DataFrame, school: str | None = None, q: str = "") -> DataFrame:
    """People of a school (all without one) with a name that contains q."""
    hit = persons.filter(F.contains(F.lower(F.array_join("names", " ")), F.lit(q.lower())))
    return hit.filter(F.col("school") == school) if school else hit


def mentions(documents: DataFrame, persons: DataFrame, words: int = 0) -> DataFrame:
    """person, doc_id, n: how often each document names each person, by any alias of two characters at least.

    ``words`` above 0 looks for single words of the aliases, of at least so many characters, too.
    """
    alias = persons.select(F.get("names", F.lit(0)).alias("person"), F.explode("names").alias("alias"))
    parts = F.array("alias") if not words else F.array_union(F.array("alias"), F.filter(F.split("alias", " "), lambda w: F.length(w) >= words))
    alias = alias.select("person", F.explode(parts).alias("pattern")).filter(F.length("pattern") >= 2).distinct()
    found = contained(documents.select("doc_id", "text"), alias).drop("text")
    return found.join(alias, "pattern").groupBy("person", "doc_id").agg(F.sum("n").alias("n"))

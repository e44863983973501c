"""Static pages, indexes and shards of persons and titles, and what reads them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.ids import slug
from lexiloom.functions.text import escape_html, life_dates, text_or_empty
from lexiloom.operators.search import distinct_people


def person_facts(persons: DataFrame) -> DataFrame:
    """row_no, name, slug, facts (school, dates, teacher and students, as far as known, between bars), html: a page's body."""
    name, other = F.get("names", F.lit(0)), text_or_empty(F.get("names", F.lit(1)))
    given = lambda label, c: F.when(text_or_empty(c) != "", F.concat(F.lit(label), escape_html(c)))
    dates = F.nullif(life_dates(F.col("floruit"), F.col("death"), True), F.lit(""))
    facts = F.concat_ws(" | ", given("School: ", F.col("school")), dates, given("Teacher: ", F.col("teacher")), given("Students: ", F.array_join("students", ", ")))
    refs = F.array_join(F.transform("links", lambda x: F.concat(F.lit('<a href="'), escape_html(x["url"]), F.lit('">'), escape_html(x["label"]), F.lit("</a>"))), " | ")
    part = lambda a, c, b: F.when(text_or_empty(c) != "", F.concat(F.lit(a), c, F.lit(b)))
    html = F.concat_ws(
        "\n", F.concat(F.lit("<h1>"), escape_html(F.concat_ws(" ", name, F.nullif(other, F.lit("")))), F.lit("</h1>")),
        part('<p class="meta">', facts, "</p>"), part('<p class="bio">', escape_html(F.col("notes")), "</p>"), part('<p class="refs">References: ', refs, "</p>"))
    rows = distinct_people(persons)
    return rows.select("row_no", name.alias("name"), slug(name, "page").alias("slug"), facts.alias("facts"), html.alias("html"))


def scraped(pages: DataFrame, html: str = "html") -> DataFrame:
    """heading, school, teacher, students of person pages, from their markup."""
    meta = F.regexp_extract(html, r'<p class="meta">(.*?)</p>', 1)
    fact = lambda label: F.regexp_extract(meta, rf"(?:^| \| ){label}: (.*?)(?: \| |$)", 1)
    students = F.filter(F.split(fact("Students"), ", "), lambda x: x != "")
    return pages.select("*", F.regexp_extract(html, "<h1>(.*?)</h1>", 1).alias("heading"), fact("School").alias("school"), fact("Teacher").alias("teacher"), students.alias("students"))


def person_index(persons: DataFrame) -> DataFrame:
    """name, other, school, slug, dates in the order of names by the rules of Unicode."""
    rows = distinct_people(persons)
    return rows.select(F.get("names", F.lit(0)).alias("name"), text_or_empty(F.get("names", F.lit(1))).alias("other"), text_or_empty("school").alias("school"), slug(F.get("names", F.lit(0)), "page").alias("slug"),
                       life_dates(F.col("floruit"), F.col("death"), True).alias("dates")).orderBy(F.collate("name", "UNICODE"), "name")


def title_pages(titles: DataFrame, site: str) -> DataFrame:
    """file_id, title, description of each text with an id, from its first row."""
    t, zh, en = titles.filter("fileId <> ''"), text_or_empty("zh"), F.coalesce(F.nullif("en", F.lit("")), F.nullif("enShort", F.lit("")), F.lit(""))
    first = t.groupBy("fileId").agg(F.min("row_no").alias("row_no"))
    named = F.when(en != "", F.concat(en, F.lit(" ("), zh, F.lit(")"))).otherwise(zh)
    return t.join(first, ["fileId", "row_no"]).select(F.col("fileId").alias("file_id"), F.concat(named, F.lit(f" - {site}")).alias("title"), F.concat(F.lit("Read "), named, F.lit(f" on {site}.")).alias("description"))


def sitemap(routes: DataFrame, base: str, day: str) -> DataFrame:
    """url rows of a site map: loc and priority (1.0 the root, 0.6 persons, 0.8 others)."""
    r = F.col("route")
    priority = F.when(r == "", F.lit("1.0")).when(F.startswith(r, F.lit("person/")), F.lit("0.6")).otherwise(F.lit("0.8"))
    return routes.select("route", F.concat(F.lit(f"<url><loc>{base}/"), r, F.lit(f"</loc><lastmod>{day}</lastmod><priority>"), priority, F.lit("</priority></url>")).alias("line"))


def routes_of(persons: DataFrame, titles: DataFrame) -> DataFrame:
    """The root, every text and every person."""
    root = titles.sparkSession.createDataFrame([("",)], "route string")
    texts = titles.filter("fileId <> ''").select(F.col("fileId").alias("route")).distinct()
    return root.unionByName(texts).unionByName(person_facts(persons).select(F.concat(F.lit("person/"), F.col("slug")).alias("route")))


def person_shards(mentions: DataFrame, most: int = 8) -> DataFrame:
    """person, slug, documents, total_mentions, and the ``most`` documents that name them oftenest."""
    top = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "doc_id")))  # of at most so many rows
    w = Window.partitionBy("person").orderBy(F.col("n").desc(), "doc_id")
    sums = mentions.groupBy("person").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("total_mentions"))
    first = mentions.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).groupBy("person").agg(F.transform(top, lambda x: x["doc_id"]).alias("top"))
    return sums.join(first, "person").select("person", slug(F.col("person"), "shard").alias("slug"), "documents", "total_mentions", "top")


def picked(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """One row of a table, at random but the same for a seed."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(1)


def starred(rows: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Rows with their count, 0 where there is none."""
    return rows.join(counts.select(key, "stars"), key, "left").fillna(0, ["stars"])


def placed(nodes: DataFrame, saved: DataFrame, layout: DataFrame) -> DataFrame:
    """Nodes with saved places; graphs of which no node has one take those of the layout, single nodes 0."""
    key = ["collection_id", "node_id"]
    some = saved.join(nodes, key, "left_semi").select("collection_id").distinct().withColumn("some", F.lit(True))
    rows = nodes.join(saved.select(*key, F.col("x").alias("sx"), F.col("y").alias("sy")), key, "left").join(layout.select(*key, F.col("x").alias("lx"), F.col("y").alias("ly")), key, "left").join(some, "collection_id", "left")
    at = lambda s, l: F.coalesce(F.when(F.col("some"), F.col(s)).otherwise(F.col(l)), F.lit(0.0))  # noqa: E731, E741
    return rows.select(*key, at("sx", "lx").alias("x"), at("sy", "ly").alias("y"))


def labelled(nodes: DataFrame, q: str) -> DataFrame:
    """Nodes whose label contains q, of two characters at least."""
    return nodes.filter(F.contains(F.lower("label"), F.lit(q.lower())) & F.lit(len(q) >= 2))


def page_link(name: Column, kind: str = "person") -> Column:
    return F.concat(F.lit(f"#/{kind}/"), slug(name))


def robots(base: str) -> str:
    """What crawlers may read, and where the site map is."""
    return f"User-agent: *\nAllow: /\nSitemap: {base}/sitemap.xml\n"

"""Batch build of a search index: documents with their facets, and postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.ids import KINDS, corpus_of_id
from lexiloom.functions.text import text_or_empty
from lexiloom.operators.search import tokens


def search_documents(documents: DataFrame, titles: DataFrame, translated: DataFrame) -> DataFrame:
    """doc_id, title, title_en, file_id, side, translated, collection, content of every document with text.

    Title and collection (the first path segment, T without one) come from the first title
    row of the text; ``translated`` tells whether the text is in the table of that name.
    """
    first = Window.partitionBy("fileId").orderBy("row_no")
    t = titles.filter("fileId is not null").withColumn("_r", F.row_number().over(first)).filter("_r = 1").select(F.col("fileId").alias("file_id"), "zh", "en", "path")
    have = translated.filter("file_id is not null").select("file_id").distinct().withColumn("has", F.lit(True))
    rows = documents.filter("text <> ''").select("doc_id", "file_id", "source", "text").join(t, "file_id", "left").join(have, "file_id", "left")
    return rows.select(
        "doc_id", F.coalesce(F.nullif("zh", F.lit("")), "file_id", F.lit("")).alias("title"), text_or_empty("en").alias("title_en"), text_or_empty("file_id").alias("file_id"), text_or_empty("source").alias("side"),
        F.coalesce("has", F.lit(False)).alias("translated"), F.when(F.col("path").isNull(), F.lit("T")).otherwise(F.split("path", "/")[0]).alias("collection"), F.col("text").alias("content"))


def index_records(documents: DataFrame, titles: DataFrame, translated: DataFrame) -> DataFrame:
    """Records of all families: documents by side, and the titles themselves."""
    named = titles.filter("coalesce(zh, en) <> ''").select(F.lit("title").alias("side"), F.coalesce("zh", "en").alias("content"), text_or_empty("en").alias("title_en"), text_or_empty("fileId").alias("file_id"))
    return search_documents(documents, titles, translated).unionByName(named, allowMissingColumns=True)


def family_records(texts: DataFrame, titles: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """url, content, language, title, title_other, file_id, corpus, translated, side, chosen, collection, translator of every text.

    texts: file_id, text, family (source, translation or community), translator. Of the five families
    of an index two are sources and two translations, one each for the canonical and the published corpus; the
    fifth are translations by users. Empty texts have no record. A source counts as translated
    if a translation of the family of that name has its id. chosen: a table of file_id.
    """
    first = Window.partitionBy("fileId").orderBy("row_no")
    t = titles.filter("fileId is not null").withColumn("_r", F.row_number().over(first)).filter("_r = 1").select(F.col("fileId").alias("file_id"), F.nullif("zh", F.lit("")).alias("zh"), F.nullif("en", F.lit("")).alias("en"), "path")
    have = texts.filter("family = 'translation' AND text <> ''").select("file_id").distinct().withColumn("has", F.lit(True))
    pick = (chosen.select("file_id").distinct() if chosen is not None else texts.select("file_id").limit(0)).withColumn("pick", F.lit(True))
    rows = texts.filter("text <> ''").join(t, "file_id", "left").join(have, "file_id", "left").join(pick, "file_id", "left")
    source, user = F.col("family") == "source", F.col("family") == "community"
    url = F.concat(F.lit("/"), "file_id", F.when(source, F.lit("")).when(user, F.concat(F.lit("?side=community&translator="), F.col("translator"))).otherwise(F.lit("?side=en")))
    canonical = corpus_of_id(F.col("file_id")) != KINDS[1]
    return rows.select(
        url.alias("url"), F.col("text").alias("content"), F.when(source, F.lit("zh")).otherwise(F.lit("en")).alias("language"),
        F.when(source, F.coalesce("zh", "file_id")).otherwise(F.coalesce("en", "zh", "file_id")).alias("title"), F.coalesce(F.when(source, F.col("en")).otherwise(F.col("zh")), F.lit("")).alias("title_other"), "file_id",
        F.when(canonical | user, F.lit(KINDS[0])).otherwise(F.lit(KINDS[1])).alias("corpus"), F.when(source, F.coalesce("has", F.lit(False))).otherwise(F.lit(True)).alias("translated"), F.when(~source, F.col("family")).alias("side"),
        F.when(~user, F.coalesce("pick", F.lit(False)) & canonical).alias("chosen"),
        F.when(source, F.when(~canonical, F.lit(KINDS[1])).otherwise(F.coalesce(F.nullif(F.split("path", "/")[0], F.lit("")), F.lit("T")))).alias("collection"), F.when(user, F.col("translator")).alias("translator"))


def postings(documents: DataFrame, text: str = "text") -> DataFrame:
    """token, doc_id, n: tokens of every script (see ``operators.search.tokens``); counted in the map tasks before they are shuffled."""
    each = documents.select("doc_id", F.explode(tokens(F.col(text))).alias("token"))
    return each.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def write_postings(index: DataFrame, path: str, buckets: int = 256) -> None:
    """Postings as Parquet, in folders by hash of the token and ordered by it, so that a query reads the row groups of its tokens alone."""
    rows = index.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "token", "doc_id").write.partitionBy("bucket").mode("overwrite").parquet(path)


def phrase_candidates(index: DataFrame, words: list[str]) -> DataFrame:
    """doc_id of the documents that have all of the words: what a phrase is then looked for in."""
    wanted = sorted({w.lower() for w in words})
    return index.filter(F.col("token").isin(wanted)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == len(wanted)).select("doc_id")

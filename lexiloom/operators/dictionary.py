"""Dictionary build and lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.ids import first_codepoint_bucket

#: Most entries of a first character that a reader is given.
CHARACTER_ENTRIES = 20_000

_ENTRY = r"^([^\s]+) ([^\s]+) [^\[]*\[([^\]]*)\][^/]*/(.*)$"


def parsed_entries(lines: DataFrame, order: str = "row_no", line: str = "line") -> DataFrame:
    """row_no, trad, simp, pinyin, defs of ``trad simp [pinyin] /a/b/`` lines.

    Senses begin at the first slash after the brackets, so that brackets may hold slashes.
    Comments, lines without brackets and lines without sense are left out.
    """
    t = F.trim(line)
    part = lambda k: F.regexp_extract(t, _ENTRY, k)
    defs = F.filter(F.transform(F.split(part(4), "/"), lambda x: F.trim(x)), lambda x: x != "")
    rows = lines.filter(~F.startswith(t, F.lit("#")) & t.rlike(_ENTRY)).select(F.col(order).alias("row_no"), part(1).alias("trad"), part(2).alias("simp"), part(3).alias("pinyin"), defs.alias("defs"))
    return rows.filter(F.size("defs") > 0)


def by_character(entries: DataFrame, most: int = CHARACTER_ENTRIES) -> DataFrame:
    """Entries with first_char, bucket (of its code point) and place among the character's, in input order, up to ``most``."""
    w = Window.partitionBy("first_char").orderBy("row_no")
    rows = entries.withColumn("first_char", F.substring("trad", 1, 1)).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    return rows.withColumn("bucket", first_codepoint_bucket(F.col("first_char")))


def character_index(entries: DataFrame) -> DataFrame:
    """first_char, bucket, n: what the buckets hold."""
    return by_character(entries).groupBy("first_char", "bucket").agg(F.count(F.lit(1)).alias("n"))


def looked_up(terms: DataFrame, entries: DataFrame) -> DataFrame:
    """term with every entry whose traditional or simplified form it is, under the term's first character.

    Two equi-joins in place of one on a disjunction; an entry equal in both forms comes once.
    """
    asked = terms.select("term").filter("term <> ''").distinct()
    e = entries.withColumn("first_char", F.substring("trad", 1, 1))
    trad = asked.join(e, F.col("term") == F.col("trad"))
    simp = asked.join(e, (F.col("term") == F.col("simp")) & (F.substring("term", 1, 1) == F.col("first_char"))).filter("simp <> trad")
    return trad.unionByName(simp).drop("first_char")


def merged_senses(found: DataFrame) -> DataFrame:
    """term, pinyin, defs, forms: distinct values over a term's entries, in entry order."""
    ordered = F.sort_array(F.collect_list(F.struct("row_no", "pinyin", "defs", "trad", "simp")))
    g = found.groupBy("term").agg(ordered.alias("e"))
    pick = lambda f: F.array_distinct(F.flatten(F.transform("e", f)))
    return g.select("term", pick(lambda x: F.array(x["pinyin"])).alias("pinyin"), pick(lambda x: x["defs"]).alias("defs"), pick(lambda x: F.array(x["trad"], x["simp"])).alias("forms"))


def longest_prefix(texts: DataFrame, entries: DataFrame, longest: int = 4, key: str = "key", text: str = "text") -> DataFrame:
    """key, found: the longest word of the dictionary, of up to ``longest`` characters, that each text begins with."""
    words = entries.select(F.col("trad").alias("found")).unionByName(entries.select(F.col("simp").alias("found"))).filter("found <> ''").distinct()
    prefixes = texts.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.substr(F.col(text), F.lit(1), n))).alias("found")).distinct()
    return prefixes.join(words, "found").groupBy(key).agg(F.max_by("found", F.length("found")).alias("found"))


def with_grammar(terms: DataFrame, grammar: DataFrame) -> DataFrame:
    """Terms with the functions of a grammar table (char, functions); null for terms of more than one character and unknown ones."""
    g = grammar.groupBy(F.col("char").alias("_c")).agg(F.first("functions").alias("functions"))
    return terms.join(g, (F.length("term") == 1) & (F.col("term") == F.col("_c")), "left").drop("_c")

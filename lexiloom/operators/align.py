"""Joins of ordered tables: alignment, fallbacks, witnesses, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.lines import with_ordinal


def aligned(source: DataFrame, translation: DataFrame, on: list[str], text: str = "text") -> DataFrame:
    """Source rows with the translation of the same key, empty without one."""
    other = translation.groupBy(*on).agg(F.min(text).alias("_t"))
    return source.join(other, on, "left").withColumn("translation", F.coalesce("_t", F.lit(""))).drop("_t")


def zipped(tables: dict[str, DataFrame], key: str, order: str, text: str) -> DataFrame:
    """Rows of several tables by place within the key, as far as all have one: key, ordinal, a text column a table."""
    sides = [with_ordinal(d.select(key, F.col(order).alias("_o"), F.col(text).alias(name)), key, "_o").drop("_o") for name, d in tables.items()]
    return reduce(lambda a, b: a.join(b, [key, "ordinal"]), sides)


def first_available(choices: list[DataFrame], key: str) -> DataFrame:
    """For every key the row of the first table that has it; ``choice`` is its number from 0."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("choice", F.lit(i)) for i, d in enumerate(choices)])
    w = Window.partitionBy(key).orderBy("choice")
    return every.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def first_of(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_rank = 1").drop("_rank")


def best(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The row of each key with the greatest positive value, the first on a tie; none where no value is positive."""
    return first_of(rows.filter(F.col(value) > 0), by, [F.col(value).desc(), F.col(order)])


def witnesses(readings: DataFrame) -> DataFrame:
    """key_a columns kept, one row a siglum: the wit string split on white space, without leading ``#``."""
    return readings.withColumn("siglum", F.explode(F.filter(F.transform(F.split("wit", r"\s+"), lambda x: F.regexp_replace(x, "^#", "")), lambda x: x != "")))


def witness_labels(readings: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """key, witnesses: labels of a reading's witnesses joined by a comma, the siglum where there is no label."""
    each = readings.select(*key, F.posexplode(F.filter(F.transform(F.split("wit", r"\s+"), lambda x: F.regexp_replace(x, "^#", "")), lambda x: x != "")).alias("i", "siglum"))
    named = each.join(labels.select("siglum", "label"), "siglum", "left").withColumn("label", F.coalesce("label", "siglum"))
    return named.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "label"))), lambda x: x["label"]), ", ").alias("witnesses"))


def with_labels(rows: DataFrame, vocabulary: DataFrame, key: str, default: str) -> DataFrame:
    """Rows with label and color of the vocabulary's first entry for the key; the key and the default colour without one."""
    first = first_of(vocabulary.select(F.col("id").alias(key), "name", "color", "seq"), [key], [F.col("seq")]).drop("seq")
    valid = F.col("color").rlike("^#[0-9A-Fa-f]{3,8}$")
    return rows.join(first, key, "left").withColumn("label", F.coalesce("name", key)).withColumn("color", F.when(valid, F.col("color")).otherwise(F.lit(default))).drop("name")

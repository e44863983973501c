"""Readers of files and folders, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.ids import first_codepoint_bucket, id_of_path, slug


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of line-delimited JSON; blank and malformed lines are left out, members of other case are found too."""
    bad = "_corrupt_record"
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(bad, T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)
    # The bad column alone cannot be filtered on a raw scan, so that it goes through the row.
    return rows.withColumn("_bad", F.col(bad).isNotNull()).filter("NOT _bad").drop(bad, "_bad")


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One JSON document a file; anything that is not JSON is an error."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_documents(spark: SparkSession, root: str, pattern: str = "*.xml") -> DataFrame:
    """path, xml of every matching file below a folder; a missing folder has none."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], "path string, xml string")
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root).select(F.input_file_name().alias("path"), F.col("value").alias("xml"))


def listed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, file_id, length, modificationTime of every file below a folder, without reading it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return rows.select("path", id_of_path(F.col("path")).alias("file_id"), "length", "modificationTime")


def nonempty(files: DataFrame, least: int = 10) -> DataFrame:
    return files.filter(F.col("length") > least)


def over_keyed(rows: DataFrame) -> DataFrame:
    """key and the row that key means last: titles by path, stated id and id derived from the path."""
    keys = F.array_distinct(F.filter(F.array("path", "fileId", id_of_path(F.col("path"))), lambda k: (k.isNotNull()) & (k != "")))
    each = rows.filter("path <> ''").withColumn("key", F.explode(keys))
    return each.groupBy("key").agg(F.max_by("row_no", "row_no").alias("row_no"))


def counts_of(json: DataFrame, column: str) -> DataFrame:
    """key, n of a JSON object of numbers, those above zero."""
    return json.select(F.explode(F.from_json(column, "map<string,double>")).alias("key", "n")).filter("n > 0")


def write_by_character(entries: DataFrame, path: str) -> None:
    """JSON files of dictionary entries by bucket of their first character."""
    entries.withColumn("first_char", F.substring("trad", 1, 1)).withColumn("bucket", first_codepoint_bucket(F.substring("trad", 1, 1))).repartition("bucket").write.partitionBy("bucket").mode("overwrite").json(path)


def write_by_person(rows: DataFrame, name: str, path: str) -> None:
    """JSON files by the slug of a person."""
    rows.withColumn("slug", slug(F.col(name), "shard")).repartition("slug").write.partitionBy("slug").mode("overwrite").json(path)


def write_text(lines: DataFrame, column: str, path: str) -> None:
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def read_character(spark: SparkSession, path: str, character: str) -> DataFrame:
    """Dictionary entries of one first character, from the bucket that has it; none if there is no such bucket."""
    bucket = ord(character[0]) % 201 if character else -1
    return spark.read.option("basePath", path).json(f"{path}/bucket=*").filter((F.col("bucket") == bucket) & (F.col("first_char") == character[:1]))


def owners(files: DataFrame, suffix: str = ".jsonl") -> DataFrame:
    """owner: the users of a folder of files, by file name or, for other files, by the folder they are in."""
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.url_decode(F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(-2)), F.lit("")))
    own = F.when(F.endswith(name, F.lit(suffix)), F.url_decode(F.substring(name, F.lit(1), F.length(name) - len(suffix)))).otherwise(folder)
    return files.select(own.alias("owner")).filter("owner <> ''").distinct()


def listed_ids(json: DataFrame, column: str) -> DataFrame:
    """fileId of every path in an array column: the file name without .xml."""
    from lexiloom.functions.ids import stem_of_path

    return json.select(F.explode(column).alias("path")).select(stem_of_path(F.col("path")).alias("fileId")).filter("fileId <> ''").distinct()


def people_of(json: DataFrame, column: str = "masters") -> DataFrame:
    """row_no and the members of every person in an array column, in the order of the file."""
    return json.select(F.posexplode(column).alias("row_no", "p")).select(F.col("row_no").cast("long").alias("row_no"), "p.*")


def write_manifest(entries: DataFrame, path: str) -> None:
    """Which bucket has each first character, beside the buckets, by the hash of the character so that a reader opens one file."""
    first = F.substring("trad", 1, 1)
    rows = entries.groupBy(first.alias("first_char")).agg(F.count(F.lit(1)).alias("n")).withColumn("in_bucket", first_codepoint_bucket(F.col("first_char")))
    rows.coalesce(1).write.mode("overwrite").option("compression", "none").json(f"{path}/_manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """first_char, n, in_bucket of the buckets in a folder."""
    return spark.read.schema("first_char string, n long, in_bucket int").json(f"{path}/_manifest")


def listed_works(spark: SparkSession, *roots: str, pattern: str = "*.xml") -> DataFrame:
    """fileId of every file below any of several folders, by base name; a folder that is missing has none."""
    found = spark.createDataFrame([], "fileId string")
    for root in roots:
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
            found = found.unionByName(listed(spark, root, pattern).select(name.alias("fileId")))
    return found.distinct()

"""Line-delimited JSON as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Rows of the JSONL files of a folder as they arrive, without blank and malformed lines."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    rows = raw.select(F.from_json(F.regexp_replace("value", "\r$", ""), schema, {"mode": "PERMISSIVE"}).alias("r"), "value")
    return rows.filter((F.trim("value") != "") & F.try_parse_json("value").isNotNull()).select("r.*")


def latest_by_key(stream: DataFrame, key: str, order: str, horizon: str, at: str) -> DataFrame:
    """The latest row of every key, with state kept for ``horizon`` of event time ``at``."""
    fields = [c for c in stream.columns if c != key]
    return stream.withWatermark(at, horizon).groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("row")).select(key, "row.*")


def counted(stream: DataFrame, at: str, width: str, late: str, *by: str) -> DataFrame:
    """Rows per window of event time; rows later than ``late`` are left out once their window closed."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def drained(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a stream over all that is there, batch by batch, and end."""
    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

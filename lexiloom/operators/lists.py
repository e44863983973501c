"""Small stores: reading lists, last write, expiry, least recent use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows without those of the new rows' keys, and the new rows."""
    return stored.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def removed(stored: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows without those of the given keys; a list that loses its last row is gone with it."""
    return stored.join(gone.select(*key).distinct(), key, "left_anti")


def last_write(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The latest row of every key."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def unexpired(rows: DataFrame, at_ms: str, ttl_ms: str, now_ms: int) -> DataFrame:
    """Rows that have not lived longer than their time; those without a limit stay."""
    return rows.filter(F.col(ttl_ms).isNull() | (F.lit(now_ms) <= F.col(at_ms) + F.col(ttl_ms)))


def _parts(rows: DataFrame, at: str, seconds: int) -> DataFrame:
    """Rows with ``_part``, a stretch of time: what a task takes of a key at once."""
    return rows.withColumn("_part", F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (seconds * 1_000_000)))


def within_budget(rows: DataFrame, scope: str, used: str, size: str, budget: int, *ties: str, part_seconds: int = 86_400) -> DataFrame:
    """Rows that stay if the least recently used leave until the rest fits the budget, scope by scope.

    Sizes are summed by stretches of time first, so that a scope may be any size.
    """
    rows = _parts(rows, used, part_seconds)
    later = Window.partitionBy(scope).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(scope, "_part").agg(F.sum(size).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(later), F.lit(0))).drop("_n")
    inside = Window.partitionBy(scope, "_part").orderBy(F.col(used).desc(), *[F.col(t).desc() for t in ties]).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum(size).over(inside)).join(base, [scope, "_part"])
    return rows.filter(F.col("_sum") + F.col("_base") <= budget).drop("_sum", "_base", "_part")


def cooled_down(rows: DataFrame, key: str, at: str, seconds: int, *ties: str, part_seconds: int = 86_400) -> DataFrame:
    """Events with ``shown``: whether the time since the key's event before is at least so long; the first is."""
    rows = _parts(rows, at, part_seconds)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    inside = Window.partitionBy(key, "_part").orderBy(at, *ties)
    before = rows.groupBy(key, "_part").agg(F.max(micros).alias("_end")).withColumn("_end", F.lag("_end").over(Window.partitionBy(key).orderBy("_part")))
    rows = rows.withColumn("_last", F.lag(micros).over(inside)).join(before, [key, "_part"])
    gap = micros - F.coalesce("_last", "_end")
    return rows.withColumn("shown", gap.isNull() | (gap >= seconds * 1_000_000)).drop("_last", "_end", "_part")


def last_read(events: DataFrame, key: list[str], order: str, action: str = "action") -> DataFrame:
    """The position every reader is left with: the last ``set`` that was not suppressed or cleared.

    ``clear`` forgets the position and suppresses every ``set`` until ``resume``; other actions
    mean nothing. Keys without position have no row. What counts is taken from the last clear
    and the first resume after it, without ordering a reader's events.
    """
    cleared = events.filter(F.col(action) == "clear").groupBy(*key).agg(F.max(order).alias("_cleared"))
    rows = events.join(cleared, key, "left")
    resumed = rows.filter((F.col(action) == "resume") & (F.col(order) > F.col("_cleared"))).groupBy(*key).agg(F.min(order).alias("_resumed"))
    rows = rows.filter(F.col(action) == "set").join(resumed, key, "left").filter(F.col("_cleared").isNull() | (F.col(order) > F.col("_resumed")))
    names = [c for c in events.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*names), order).alias("_e")).select(*key, "_e.*")

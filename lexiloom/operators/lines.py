"""Ordered line tables: ordinals, chunks, slices, pages.

Order is data: every operator takes it from a column. A file may be any size, so nothing
here orders a whole file in one task: ordinals come from counts of ranges of the order
column, and neighbourhoods from chunks of lines with a margin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import text_or_empty

#: Values of the order column that one task numbers together.
RANGE = 1 << 14


def clean_lines(lines: DataFrame) -> DataFrame:
    """Rows that come twice under (file_id, line_no) once, null text empty; rows without key left out."""
    rows = lines.filter("file_id is not null and line_no is not null")
    return rows.groupBy("file_id", "line_no").agg(
        F.min("line_id").alias("line_id"), F.min(text_or_empty("text")).alias("text"), F.max(F.coalesce("is_synthetic", F.lit(False))).alias("is_synthetic"))


def real_lines(lines: DataFrame) -> DataFrame:
    return clean_lines(lines).filter("NOT is_synthetic").drop("is_synthetic")


def with_ordinal(rows: DataFrame, key: str = "file_id", order: str = "line_no", name: str = "ordinal", span: int = RANGE) -> DataFrame:
    """Adds the rank, from 0, of each row within its key; ``order`` must be an integer, unique within the key.

    The ranks are exact, and a key's rows spread over as many tasks as it has ranges.
    """
    rows = rows.withColumn("_range", F.floor(F.col(order) / span))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(key, "_range").orderBy(order))
    return rows.withColumn("_within", within).join(base, [key, "_range"]).withColumn(name, (F.col("_base") + F.col("_within") - 1).cast("long")).drop("_range", "_within", "_base")


def with_margin(rows: DataFrame, size: int, margin: int, ordinal: str = "ordinal") -> DataFrame:
    """Rows with the chunk each belongs to, and repeated (``own`` false) in the chunk beside if within ``margin`` of it."""
    at = F.floor(F.col(ordinal) / size)
    place = F.col(ordinal) % size
    near = F.array(F.lit(0), F.when(place < margin, F.lit(-1)), F.when(place >= size - margin, F.lit(1)))
    each = rows.withColumn("_step", F.explode(F.filter(near, lambda x: x.isNotNull())))
    return each.withColumn("chunk", at + F.col("_step")).withColumn("own", F.col("_step") == 0).drop("_step").filter("chunk >= 0")


def neighbours(rows: DataFrame, exprs: dict[str, tuple[str, int]], key: str = "file_id", size: int = 4096) -> DataFrame:
    """Columns of the row a number of steps away (negative: before), null outside the key.

    exprs: new column -> (column, steps).
    """
    margin = max(abs(s) for _, s in exprs.values())
    cut = with_margin(rows, size, margin)
    w = Window.partitionBy(key, "chunk").orderBy("ordinal")
    for name, (column, steps) in exprs.items():
        cut = cut.withColumn(name, F.lag(column, -steps).over(w) if steps < 0 else F.lead(column, steps).over(w))
    return cut.filter("own").drop("own", "chunk")


def cited_range(lines: DataFrame, steps: int = 2) -> DataFrame:
    """start_id and end_id: the real lines ``steps`` before and after, or as far as there are."""
    rows = with_ordinal(real_lines(lines))
    wanted = {f"_{side}{k}": ("line_id", k if side == "a" else -k) for side in "ba" for k in range(1, steps + 1)}
    rows = neighbours(rows, wanted)
    back = F.coalesce(*[F.col(f"_b{k}") for k in range(steps, 0, -1)], F.col("line_id"))
    ahead = F.coalesce(*[F.col(f"_a{k}") for k in range(steps, 0, -1)], F.col("line_id"))
    return rows.select("file_id", "line_no", "line_id", back.alias("start_id"), ahead.alias("end_id"))


def slice_between(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines of each range: range_id, file_id, line_no, line_id, text.

    ranges: range_id, file_id, from_id, to_id. Both empty: all lines; no end: one line; an
    unknown start, or an end that is unknown or before the start: the whole file, with
    ``fallback`` true.
    """
    rows = real_lines(lines)
    at = rows.select("file_id", "line_id", "line_no")
    named = (
        ranges.join(at.select("file_id", F.col("line_id").alias("from_id"), F.col("line_no").alias("a")), ["file_id", "from_id"], "left")
        .join(at.select("file_id", F.col("line_id").alias("to_id"), F.col("line_no").alias("b")), ["file_id", "to_id"], "left"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    end = F.when(blank("to_id"), F.col("a")).otherwise(F.col("b"))
    good = F.col("a").isNotNull() & end.isNotNull() & (end >= F.col("a"))
    every = blank("from_id") & blank("to_id")
    bounds = named.select("range_id", "file_id", F.when(good, F.col("a")).alias("a"), F.when(good, end).alias("b"), (~good & ~every).alias("fallback"))
    part = in_ranges(bounds.filter("a is not null"), rows, "line_no")
    whole = bounds.filter("a is null").join(rows, "file_id")
    pick = lambda d: d.select("range_id", "file_id", "line_no", "line_id", "text", "fallback")
    return pick(part).unionByName(pick(whole))


def in_ranges(ranges: DataFrame, rows: DataFrame, order: str, span: int = 4096) -> DataFrame:
    """Rows of each file whose ``order`` lies between a and b of its ranges.

    Both sides are cut into stretches of the order, so that a range meets the lines about
    it and not the file.
    """
    cut = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("a") / span), F.floor(F.col("b") / span))))
    near = cut.join(rows.withColumn("_cell", F.floor(F.col(order) / span)), ["file_id", "_cell"])
    return near.filter(F.col(order).between(F.col("a"), F.col("b"))).drop("_cell")


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first n lines of every file, empty ones included; none for n <= 0."""
    return with_ordinal(real_lines(lines)).filter(F.col("ordinal") < max(n, 0)).drop("ordinal")


def pages(rows: DataFrame, size: int, key: str = "file_id", whole_up_to: int = 0) -> DataFrame:
    """page and pages (both from 1) of ordinal rows; keys of at most ``whole_up_to`` rows are one page."""
    total = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    each = rows.join(total, key)
    one = F.col("_n") <= whole_up_to
    page = F.when(one, F.lit(1)).otherwise(F.floor(F.col("ordinal") / size) + 1).cast("int")
    count = F.when(one, F.lit(1)).otherwise(F.ceil(F.col("_n") / size)).cast("int")
    return each.withColumn("page", page).withColumn("pages", count).drop("_n")


def page_of(rows: DataFrame, found: Column, size: int, key: str = "file_id") -> DataFrame:
    """Page, from 1, of the first row of each key for which ``found`` holds; 1 if there is none."""
    first = F.min(F.when(found, F.col("ordinal")))
    return rows.groupBy(key).agg((F.coalesce(F.floor(first / size), F.lit(0)) + 1).cast("int").alias("page"))


def page_buttons(page: Column, total: Column) -> Column:
    """Numbers to show: first, last, and the page with its neighbours."""
    return F.array_sort(F.array_distinct(F.filter(F.array(F.lit(1), total, page - 1, page, page + 1), lambda x: (x >= 1) & (x <= total))))


def snippets(lines: DataFrame, ranges: DataFrame, enough: int = 160, shown: int = 80) -> DataFrame:
    """range_id, snippet: the text of a range of lines, cut.

    An unknown start reads ``[line not found]``, an unknown end or one before the start is
    the start, no text is ``[empty]``. Lines are taken until ``enough`` characters.
    """
    rows = with_ordinal(clean_lines(lines))
    at = rows.select("file_id", "line_id", "ordinal")
    named = (
        ranges.join(at.select("file_id", F.col("line_id").alias("from_id"), F.col("ordinal").alias("a")), ["file_id", "from_id"], "left")
        .join(at.select("file_id", F.col("line_id").alias("to_id"), F.col("ordinal").alias("b")), ["file_id", "to_id"], "left"))
    b = F.when(F.col("b") >= F.col("a"), F.col("b")).otherwise(F.col("a"))
    named = named.withColumn("b", b)
    # Lines that count have a character at least, so that the first ``enough`` of them are enough.
    full = with_ordinal(rows.filter("text <> ''"), name="place").select("file_id", F.col("ordinal").alias("o"), "place", "text")
    part = in_ranges(named.filter("a is not null").select("range_id", "file_id", "a", "b"), full, "o")
    first = part.groupBy("range_id").agg(F.min("place").alias("first"))
    part = part.join(first, "range_id").filter(F.col("place") < F.col("first") + enough)
    w = Window.partitionBy("range_id").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("before", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))).filter(F.col("before") < enough)
    joined = part.groupBy("range_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "text"))), lambda x: x["text"]), " ").alias("s"))
    s = F.coalesce("s", F.lit(""))
    cut = F.when(F.length(s) > shown, F.concat(F.substring(s, 1, shown), F.lit("…"))).when(s == "", F.lit("[empty]")).otherwise(s)
    return named.join(joined, "range_id", "left").select("range_id", F.when(F.col("a").isNull(), F.lit("[line not found]")).otherwise(cut).alias("snippet"))


def clamped(page: Column, total: Column) -> Column:
    """The asked page, held within the first and the last."""
    return F.greatest(F.lit(1), F.least(F.coalesce(page, F.lit(1)), F.greatest(total, F.lit(1))))


def start_page(source: Column, translated: Column) -> Column:
    """Page on which two aligned texts open for a term: the earlier of both that has it, where 1 stands for none."""
    return F.when(source == 1, translated).when(translated == 1, source).otherwise(F.least(source, translated))

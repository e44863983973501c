"""Keyword in context over ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import is_ideographic
from lexiloom.operators.lines import neighbours, real_lines, with_margin, with_ordinal

#: Lines of a chunk that is searched as one text.
CHUNK_LINES = 512


def chunked(rows: DataFrame, margin: int, gap: int, size: int = CHUNK_LINES) -> DataFrame:
    """file_id, chunk, rows: chunks of ordinal lines in order, with ``margin`` lines to either side.

    Each line has the place at which it begins in the chunk's text, lines being ``gap``
    characters apart. A written table of it serves any number of terms whose contexts keep
    within the margin.
    """
    cut = with_margin(rows, max(size, margin), margin)
    before = Window.partitionBy("file_id", "chunk").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("begin", F.coalesce(F.sum(F.length("text") + gap).over(before), F.lit(0)).cast("int"))
    kept = [c for c in rows.columns if c not in ("file_id", "ordinal")]
    return cut.groupBy("file_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("ordinal", *kept, "begin", "own"))).alias("rows"))


def positions(text: Column, term: str) -> Column:
    """0-based places of a term: ideographic ones exact and overlapping, others in any case and not overlapping."""
    if is_ideographic(term):
        n = F.greatest(F.length(text) - len(term) + 1, F.lit(0))
        at = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substr(text, i + 1, F.lit(len(term))) == term)
        return F.when(F.contains(text, F.lit(term)), at).otherwise(F.array().cast("array<int>"))
    low = term.lower()
    pieces = F.split(F.lower(text), "\\Q" + low + "\\E", -1)
    lengths = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), F.length)
    step = F.aggregate(
        lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, n: F.struct((acc["at"] + n + len(term)).alias("at"), F.concat(acc["all"], F.array(acc["at"] + n)).alias("all")))
    return F.when(F.contains(F.lower(text), F.lit(low)), step["all"]).otherwise(F.array().cast("array<int>"))


def kwic(lines: DataFrame, term: str, context: int = 40, only: DataFrame | None = None) -> DataFrame:
    """file_id, line_no, line_id, pos, left, match, right, start_id, end_id of every hit.

    Hits lie within a line; the contexts run on into the lines beside, joined without
    separator for ideographic terms and with a blank for others, whose partial words at
    a full context's edge are dropped. start_id and end_id are the lines two before and
    after. Synthetic lines take no part, null text is empty, an empty term finds nothing. Offsets
    count code points. ``only``, a table with file_id, restricts the search to its files.
    """
    if context < 1:
        raise ValueError("context must be at least 1")
    cjk = is_ideographic(term)
    rows = real_lines(lines)
    if only is not None:
        rows = rows.join(only.select("file_id").distinct(), "file_id", "left_semi")
    if not term:
        rows, term = rows.filter(F.lit(False)), " "
    ids = neighbours(with_ordinal(rows), {"_b2": ("line_id", -2), "_b1": ("line_id", -1), "_a1": ("line_id", 1), "_a2": ("line_id", 2)})
    ids = ids.select("file_id", "line_no", "line_id", "text", "ordinal", F.coalesce("_b2", "_b1", "line_id").alias("start_id"), F.coalesce("_a2", "_a1", "line_id").alias("end_id"))
    # Every line of the margin adds a character at least: the separator, or itself where there is none.
    chunks = chunked(with_ordinal(ids.drop("ordinal").filter("text <> ''")) if cjk else ids, context, 0 if cjk else 1)
    has = F.exists("rows", lambda r: r["own"] & F.contains(r["text"] if cjk else F.lower(r["text"]), F.lit(term if cjk else term.lower())))
    chunks = chunks.filter(has)
    chunks = chunks.select("file_id", "rows", F.array_join(F.transform("rows", lambda r: r["text"]), "" if cjk else " ").alias("whole"))
    k = len(term)

    # Of a line with hits goes on what lies within reach of it, not the chunk.
    own = F.filter("rows", lambda r: r["own"] & F.contains(r["text"] if cjk else F.lower(r["text"]), F.lit(term if cjk else term.lower())))
    reach = lambda r: F.substr("whole", F.greatest(r["begin"] - context, F.lit(0)) + 1, F.length(r["text"]) + F.least(r["begin"], F.lit(context)) + context)
    found = chunks.select("file_id", F.explode(F.transform(own, lambda r: F.struct(r["line_no"].alias("line_no"), r["line_id"].alias("line_id"), r["start_id"].alias("start_id"), r["end_id"].alias("end_id"), r["text"].alias("text"), F.least(r["begin"], F.lit(context)).alias("lead"), reach(r).alias("around")))).alias("r")).select("file_id", "r.*")
    found = found.withColumn("pos", F.explode(positions(F.col("text"), term)))
    at = F.col("lead") + F.col("pos")
    found = found.withColumn("left", F.substr("around", F.greatest(at - context, F.lit(0)) + 1, F.least(at, F.lit(context)))).withColumn("right", F.substr("around", at + k + 1, F.lit(context)))
    if not cjk:
        i = F.instr("left", " ")
        found = found.withColumn("left", F.when((F.length("left") == context) & (i > 1) & (i < F.length("left")), F.substr("left", i + 1, F.lit(context))).otherwise(F.col("left")))
        j = F.length("right") - F.instr(F.reverse("right"), " ")
        found = found.withColumn("right", F.when((F.length("right") == context) & (F.instr("right", " ") > 0) & (j > 0), F.substr("right", F.lit(1), j)).otherwise(F.col("right")))
    return found.select("file_id", "line_no", "line_id", "pos", "left", F.substr("text", F.col("pos") + 1, F.lit(k)).alias("match"), "right", "start_id", "end_id")

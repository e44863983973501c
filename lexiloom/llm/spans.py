"""Long exact spans shared between records.

Level-wise doubling: windows of a quarter of the wanted length are compared first, those
repeated in another text alone are extended to twice the length, and so on up to the
wanted length, where every position that is left is compared. Below the wanted length
a level compares only windows chosen by content (the least hash in every stretch of the
wanted length), which holds at least one window of every shared stretch, so nothing is
lost. Records equal as a whole are settled first and take part once. Windows are told apart
by 64-bit hashes, at the wanted length by 128 bits: among 10**14 windows two different ones
are then taken for equal with a probability below 10**-10.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import materialise

#: Characters that are hashed at a time; longer texts are cut into overlapping pieces.
BLOCK = 1 << 21

_BASE = 0x9E3779B97F4A7C15 | 1
_BASES = (_BASE, 0xC2B2AE3D27D4EB4F)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}


def _power(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    size = 1 << max(10, n.bit_length())
    if _powers.get(base, (0,))[0] != size:
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        _powers[base] = (size, pair[0], pair[1])
    return _powers[base][1:]


def rolling(codes: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """64-bit hashes of all windows of ``k`` code points."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _power(n + 1, base)
    x = _mixed(codes.astype(np.uint64) + np.uint64(base)) * up[:n]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(x, out=sums[1:])
    return _mixed((sums[k:] - sums[: n + 1 - k]) * down[: n - k + 1])


def _slide(a: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every ``w`` consecutive entries."""
    p = 1
    while 2 * p <= w:
        a = pick(a[:-p], a[p:])
        p *= 2
    return pick(a[: len(a) - (w - p)], a[w - p:]) if w > p else a


def chosen(codes: np.ndarray, piece: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows to compare.

    At k = length all windows inside a piece; below, those with the least hash among the
    windows of some stretch of ``length`` characters inside a piece.
    """
    n = len(codes)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = rolling(codes, k)
    if k == length:
        at = np.nonzero(piece[: n - k + 1] == piece[k - 1:])[0]
        return at, h[at]
    w = length - k + 1
    least = _slide(h, w, np.minimum)
    least[piece[: n - length + 1] != piece[length - 1:]] = 0  # stretches across pieces choose nothing
    edge = np.zeros(w - 1, np.uint64)
    most = _slide(np.concatenate([edge, least, edge]), w, np.maximum)
    at = np.nonzero((most == h) & (most > 0))[0]
    return at, h[at]


def _windows(pieces: DataFrame, k: int, length: int) -> DataFrame:
    """h, g (both are the hash; g is 0 below the wanted length), doc_id, pos (in the text) of the windows of ``k`` characters to compare."""

    def block(ids: list[int], offs: list[int], texts: list[str]) -> pa.RecordBatch:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        piece = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        begin = np.cumsum(sizes) - sizes
        at, h = chosen(codes, piece, k, length)
        own = piece[at]
        base = np.array(offs, np.int64)[own]
        g = rolling(codes, k, _BASES[1])[at] if k == length else np.zeros(len(at), np.uint64)
        return pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(np.array(ids, np.int64)[own]), pa.array((at - begin[own] + base).astype(np.int32))],
            names=["h", "g", "doc_id", "pos"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, offs, texts, size = [], [], [], 0
        for b in batches:
            for i, o, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                t = t.as_py()
                for a in range(0, max(1, len(t) - length + 1), BLOCK):
                    ids.append(i)
                    offs.append(o + a)
                    texts.append(t[a: a + BLOCK + length - 1])
                    size += len(texts[-1])
                    if size >= BLOCK:
                        yield block(ids, offs, texts)
                        ids, offs, texts, size = [], [], [], 0
        if texts:
            yield block(ids, offs, texts)

    return pieces.select("doc_id", "off", "text").mapInArrow(hashed, "h long, g long, doc_id long, pos int")


def _repeated(windows: DataFrame) -> DataFrame:
    """Windows that occur in texts of two records, hashed once; hot windows shrink to a row a task before the shuffle."""
    windows = materialise(windows, "windows")
    twice = windows.groupBy("h", "g").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("h", "g")
    return windows.join(twice, ["h", "g"], "left_semi")


def _islands(at: DataFrame, before: int, after: int) -> DataFrame:
    """doc_id, a, b: the stretches [pos - before, pos + after) of each record, joined where they overlap or touch."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    fresh = F.coalesce((F.col("pos") - before > F.lag("pos").over(w) + after).cast("int"), F.lit(1))
    marked = at.select("doc_id", "pos").withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w))
    return marked.groupBy("doc_id", "island").agg((F.min("pos") - before).alias("a"), (F.max("pos") + after).alias("b")).select("doc_id", "a", "b")


def shared_spans(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, span_start, span_end: what of each record occurs letter for letter in another.

    Every run of ``length`` consecutive characters that also occurs in a record with
    another id counts; runs that overlap or touch are one span. Offsets count code points
    from 0, end exclusive. Ids are integers; rows without id or text, and texts shorter
    than ``length``, give no span; a row repeated under its own id is one record. An empty
    table gives no rows.
    """
    if length < 8:
        raise ValueError("length must be at least 8")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.col("doc_id").isNotNull() & (F.length("text") >= length))
    ids = rows.select("doc_id", F.unhex(F.md5("text")).alias("same"), F.length("text").alias("n")).distinct()
    classes = materialise(
        ids.join(ids.groupBy("same").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "same").select("doc_id", "n", "first", "copies"), "copies")
    copied = classes.filter("copies > 1")
    spare = copied.filter("doc_id <> first").select("doc_id")
    singles = rows.join(spare, "doc_id", "left_anti")
    pieces = singles.select("doc_id", F.lit(0).alias("off"), "text")
    k = length // 4
    first = True
    while k < length:
        near = _islands(_repeated(_windows(pieces, k, length)), length - k, length)
        if first:
            held = singles.select("doc_id", F.lit(0).alias("off"), "text")
        else:
            held = pieces
        cut = held.join(near, "doc_id")
        lo, hi = F.greatest(F.col("a"), F.col("off")), F.least(F.col("b"), F.col("off") + F.length("text"))
        pieces = materialise(
            cut.select("doc_id", lo.alias("lo"), hi.alias("hi"), "off", "text").filter(F.col("hi") - F.col("lo") >= length)
            .select("doc_id", F.col("lo").cast("int").alias("off"), F.expr("substring(text, lo - off + 1, hi - lo)").alias("text")), f"pieces{k}")
        k, first = min(2 * k, length), False
    found = _islands(_repeated(_windows(pieces, length, length)), 0, length)
    whole = copied.select("doc_id", F.lit(0).alias("span_start"), F.col("n").cast("int").alias("span_end"))
    part = found.join(copied.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("a").cast("int").alias("span_start"), F.col("b").cast("int").alias("span_end"))
    return part.unionByName(whole)


def shared_amount(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, shared_chars, shared_ratio, n_spans, longest_span for every record; 0 where nothing is shared."""
    sums = spans.groupBy("doc_id").agg(
        F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count(F.lit(1)).alias("n_spans"), F.max(F.col("span_end") - F.col("span_start")).alias("longest_span"))
    every = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars")).filter("doc_id is not null").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(sums, "doc_id", "left").select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), zero("shared_chars"), zero("n_spans"), zero("longest_span")).withColumn(
        "shared_ratio", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)))

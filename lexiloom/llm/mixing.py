"""Mixing sources to target weights.

The sources' token quotas are cut into blocks of one size. A tree of multivariate
hypergeometric draws splits the exact block quotas among the output shards: each node
divides its blocks between its halves, seeded by its place, so that subtrees can be drawn
anywhere. Every shard then takes its own run of each source's permuted blocks, disjoint
from the other shards', and shuffles what it has got.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.session import materialise

#: Tokens of a block and of a shard.
BLOCK_TOKENS = 2_048
SHARD_TOKENS = 1 << 20
#: Rows of a source that one task puts in order.
BUCKET_ROWS = 20_000
#: Levels of the splitting tree that are drawn in one task; below, each subtree has its own.
TOP_LEVELS = 10
#: Rounds of the permutation of a source's blocks.
ROUNDS = 32
#: Largest urn that the library draws from at once.
URN = 1_000_000_000 - 1
#: Draws from a larger one that are made one by one.
FEW = 64

# Fixed value: the pattern that splits text before the merges of a rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(4)
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, n_tokens; 0 for null and empty texts. The vocabulary is read from its path on each executor."""

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(vocabulary).encode_ordinary
        for s in texts:
            yield pd.Series([len(encode(t)) if t else 0 for t in s], dtype="int64")

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), count(F.col(text)).alias("n_tokens"))


def drawn_of(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement from ``good`` and ``bad`` ones are good, for urns of any size.

    A large urn is parted by coins that come up for n of it on average; those taken are then
    a uniform sample of their number, and the few too many or too few are drawn again, from
    those taken or those left, by the same step.
    """
    if good + bad <= URN:
        return int(rng.hypergeometric(good, bad, n)) if good + bad else 0
    if 2 * n > good + bad:
        return good - drawn_of(rng, good, bad, good + bad - n)
    if n <= FEW:
        got = 0
        for k in range(n):
            got += int(rng.integers(good + bad - k)) < good - got
        return got
    p = n / (good + bad)
    a, b = int(rng.binomial(good, p)), int(rng.binomial(bad, p))
    if a + b < n:
        return a + drawn_of(rng, good - a, bad - b, n - a - b)
    return a - drawn_of(rng, a, b, a + b - n)


def _divided(rng: np.random.Generator, counts: np.ndarray, take: int) -> np.ndarray:
    """A multivariate hypergeometric draw, source by source."""
    left, rest = np.zeros_like(counts), int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        left[i] = drawn_of(rng, c, rest - c, take)
        rest -= c
        take -= int(left[i])
    return left


def split(counts: np.ndarray, offsets: np.ndarray, lo: int, hi: int, seed: int, stop: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Nodes of at most ``stop`` shards below the node of shards [lo, hi): (lo, hi, blocks by source, first block by source)."""
    if hi - lo <= stop:
        yield lo, hi, counts, offsets
        return
    mid = (lo + hi) // 2
    left = _divided(np.random.default_rng([seed, lo, hi]), counts, int(counts.sum()) * (mid - lo) // (hi - lo))
    yield from split(left, offsets, lo, mid, seed, stop)
    yield from split(counts - left, offsets + left, mid, hi, seed, stop)


def permuted(x: Column, n: Column, keys: Column) -> Column:
    """A permutation of [0, n) that the ``keys``, numbers below n, choose.

    By swap or not: in each round a number and its mirror image change places if a hash of
    the larger of the two and the round's key says so. Nothing leaves 64 bits.
    """
    def round_(x: Column, k: Column) -> Column:
        other = F.pmod(k - x, n)
        return F.when(F.xxhash64(F.greatest(x, other), k).bitwiseAND(1) == 1, other).otherwise(x)

    return F.aggregate(keys, x, round_)


def _dealt(spark, names: list[str], blocks: list[int], shards: int, seed: int) -> DataFrame:
    """source, slot, shard: which shard gets which of each source's permuted blocks."""
    kind = "lo long, hi long, counts array<long>, offsets array<long>"
    root = spark.createDataFrame([(0, shards, [int(b) for b in blocks], [0] * len(blocks))], kind)

    def grow(stop: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = [x for lo, hi, c, o in zip(pdf["lo"], pdf["hi"], pdf["counts"], pdf["offsets"]) for x in split(np.asarray(c, np.int64), np.asarray(o, np.int64), lo, hi, seed, stop)]
                yield pd.DataFrame({"lo": [x[0] for x in out], "hi": [x[1] for x in out], "counts": [x[2].tolist() for x in out], "offsets": [x[3].tolist() for x in out]})

        return run

    top = -(-shards // (1 << TOP_LEVELS))
    leaves = root.mapInPandas(grow(top), kind)
    if top > 1:
        leaves = leaves.repartition("lo").mapInPandas(grow(1), kind)
    parts = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("source"), F.col("counts").alias("n"), F.col("offsets").alias("first"))
    quota = leaves.select(F.col("lo").alias("shard"), F.explode(parts).alias("q")).select("shard", F.col("q.source").alias("source"), F.col("q.n").alias("n"), F.col("q.first").alias("first"))
    return quota.filter("n > 0").select("source", "shard", F.explode(F.expr("sequence(first, first + n - 1)")).alias("slot"))


def quotas(totals: dict[str, int], targets: list[tuple[str, float, int]], total_tokens: int | None = None) -> dict[str, int]:
    """Tokens of each source in the mixture.

    Without ``total_tokens`` the mixture is the largest in which every source with records
    has its share of the shares of such sources, none above its records times its repeats.
    """
    have = {s: (share, totals[s] * repeats) for s, share, repeats in targets if share > 0 and repeats > 0 and totals.get(s, 0) > 0}
    whole = sum(share for share, _ in have.values())
    if not have:
        return {}
    size = min(cap * whole / share for share, cap in have.values())
    if total_tokens is not None:
        size = min(size, total_tokens)
    return {s: min(cap, math.floor(size * share / whole)) for s, (share, cap) in have.items()}


def mixture(docs: DataFrame, targets: DataFrame, vocabulary: str, seed: int = 17, total_tokens: int | None = None,
            block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, repeat_no, n_tokens, shard, position: the combined set.

    vocabulary: path of a rank file that every executor can read. docs: doc_id, text, source; targets: source, target_share, max_repeats (null is once; of
    repeated rows of a source the first by share and repeats counts). Sources without target,
    and null sources, take no part; nor do texts without tokens. Targets without records
    cannot be met: the others keep their proportions. A source falls short of its quota by
    less than one record. No record is used more than ``max_repeats`` times. An empty table
    on either side gives an empty mixture.
    """
    spark = docs.sparkSession
    listed = targets.filter("source is not null and target_share is not null").groupBy("source").agg(F.min(F.struct("target_share", F.coalesce("max_repeats", F.lit(1)).alias("r"))).alias("t")).collect()
    wanted = sorted((r["source"], float(r["t"][0]), int(r["t"][1])) for r in listed)
    names = [s for s, _, _ in wanted]
    sized = materialise(token_counts(docs, vocabulary).filter(F.col("source").isin(names) & (F.col("n_tokens") > 0)), "tokens")
    sums = {r["source"]: r for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
    quota = quotas({s: r["n"] for s, r in sums.items()}, wanted, total_tokens)
    none = "doc_id long, source string, repeat_no int, n_tokens long, shard long, position int"
    if not sum(quota.values()):
        return spark.createDataFrame([], none)
    plan, names, blocks = [], [], []
    for s, q in sorted(quota.items()):
        n = sums[s]["n"]
        full, rest = divmod(q, n)
        per_pass = -(-n // block_tokens)
        slots = full * per_pass + -(-rest // block_tokens)
        keys = np.random.default_rng([seed, len(names)]).integers(0, slots, ROUNDS).tolist()
        plan.append((s, full, rest, per_pass, slots, keys, max(1, -(-sums[s]["rows"] // bucket_rows))))
        names.append(s)
        blocks.append(slots)
    plan_of = F.broadcast(spark.createDataFrame(plan, "source string, full long, rest long, per_pass long, slots long, keys array<long>, buckets long"))  # a row for each target

    # Place in the source's permutation: by hash range first, then within the range, so that no task orders a whole source.
    order = F.xxhash64("doc_id", F.lit(seed))
    rows = sized.join(plan_of, "source").withColumn("order", order)
    rows = rows.withColumn("bucket", F.least((F.shiftrightunsigned(F.col("order"), 1) / F.lit(float(1 << 63)) * F.col("buckets")).cast("long"), F.col("buckets") - 1))
    within = Window.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    rows = rows.withColumn("upto", F.sum("n_tokens").over(within)).join(base, ["source", "bucket"]).withColumn("upto", F.col("upto") + F.col("base"))
    uses = F.col("full") + (F.col("upto") <= F.col("rest")).cast("long")
    drawn = rows.withColumn("uses", uses).filter("uses > 0").withColumn("repeat_no", F.explode(F.expr("sequence(0L, uses - 1)")))
    block = F.col("repeat_no") * F.col("per_pass") + F.floor((F.col("upto") - F.col("n_tokens")) / block_tokens)
    drawn = drawn.withColumn("slot", permuted(block.cast("long"), F.col("slots"), F.col("keys")))
    shards = max(1, -(-sum(quota.values()) // shard_tokens))
    dealt = drawn.join(_dealt(spark, names, blocks, shards, seed), ["source", "slot"])
    local = Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "repeat_no", F.lit(seed + 1)), "doc_id", "repeat_no")
    return dealt.withColumn("position", F.row_number().over(local)).select("doc_id", "source", F.col("repeat_no").cast("int").alias("repeat_no"), "n_tokens", "shard", "position")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, records, tokens, actual_share, most_repeats for every target, those that got nothing included."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("n_tokens").alias("tokens"), (F.max("repeat_no") + 1).alias("most_repeats"))
    every = targets.select("source", "target_share").join(got, "source", "left").fillna(0, ["records", "tokens", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # over the targets' few rows
    return every.withColumn("actual_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(F.lit(0.0)))

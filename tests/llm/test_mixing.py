import numpy as np

from pyspark.sql import functions as F

from lexiloom.llm import mixing as M

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def corpus(spark, sizes):
    rows = [(i * 1000 + j, "word " * (3 + j % 7), s) for i, (s, n) in enumerate(sizes.items()) for j in range(n)]
    return spark.createDataFrame([*rows, (99001, None, "a"), (99002, "", "a"), (99003, "x y", None), (99004, "x y", "other")], "doc_id long, text string, source string")


def test_split_is_exact_and_disjoint():
    counts = np.array([10, 0, 37, 5])
    leaves = list(M.split(counts, np.zeros(4, np.int64), 0, 6, 3))
    assert [(lo, hi) for lo, hi, _, _ in leaves] == [(i, i + 1) for i in range(6)]
    assert (sum(c for _, _, c, _ in leaves) == counts).all() and max(c.sum() for _, _, c, _ in leaves) - min(c.sum() for _, _, c, _ in leaves) <= 1
    for s in range(4):
        at = 0
        for _, _, c, o in leaves:
            assert o[s] == at
            at += c[s]
    again = [c.tolist() for _, _, c, _ in M.split(counts, np.zeros(4, np.int64), 0, 6, 3)]
    top = [x for lo, hi, c, o in M.split(counts, np.zeros(4, np.int64), 0, 6, 3, stop=3) for x in M.split(c, o, lo, hi, 3)]
    assert again == [c.tolist() for _, _, c, _ in top]  # subtrees can be drawn anywhere


def test_quotas():
    targets = [("a", 0.5, 1), ("b", 0.3, 4), ("gone", 0.2, 1), ("zero", 0.0, 3)]
    q = M.quotas({"a": 1000, "b": 50, "zero": 10}, targets)
    assert q == {"a": 333, "b": 200} and M.quotas({}, targets) == {}
    assert M.quotas({"a": 1000, "b": 50}, targets, 80) == {"a": 50, "b": 30}


def test_mixture(spark):
    docs = corpus(spark, {"a": 300, "b": 40, "c": 100})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, None), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    kw = dict(vocabulary=VOCABULARY, block_tokens=32, shard_tokens=400, bucket_rows=50)
    rows = M.mixture(docs, targets, **kw).collect()
    used = {}
    for r in rows:
        used.setdefault((r["source"], r["doc_id"]), []).append(r["repeat_no"])
    assert all(sorted(v) == list(range(len(v))) for v in used.values())
    assert max(len(v) for (s, _), v in used.items() if s == "b") == 3 and all(len(v) == 1 for (s, _), v in used.items() if s in "ac")
    assert {r["source"] for r in rows} == {"a", "b", "c"}
    places = sorted((r["shard"], r["position"]) for r in rows)
    assert all(b == (a[0], a[1] + 1) or b == (a[0] + 1, 1) for a, b in zip(places, places[1:])) and len(set(places)) == len(rows)
    got = {r["source"]: r for r in M.shares(M.mixture(docs, targets, **kw), targets).collect()}
    for s, share in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert abs(got[s]["actual_share"] - share) < 0.02
    assert got["gone"]["records"] == 0
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mixture(docs, targets, **kw).collect()))


def test_nothing_to_mix(spark):
    docs = corpus(spark, {"a": 3})
    targets = spark.createDataFrame([("z", 1.0, 1), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    assert M.mixture(docs, targets, VOCABULARY).count() == 0 and M.mixture(docs.filter("false"), targets, VOCABULARY).count() == 0 and M.mixture(docs, targets.filter("false"), VOCABULARY).count() == 0


def test_two_levels_of_subtrees(spark, monkeypatch):
    monkeypatch.setattr(M, "TOP_LEVELS", 2)
    rows = M._dealt(spark, ["a", "b"], [50, 23], 11, 5).collect()
    assert sorted((r["source"], r["slot"]) for r in rows) == [("a", i) for i in range(50)] + [("b", i) for i in range(23)]
    assert {r["shard"] for r in rows} == set(range(11))


def test_split_of_any_number_of_blocks():
    counts = np.array([60_000_000_000, 39_999_999_999, 1, 0])
    leaves = list(M.split(counts, np.zeros(4, np.int64), 0, 16, 3))
    assert (sum(c for _, _, c, _ in leaves) == counts).all() and max(c.sum() for _, _, c, _ in leaves) - min(c.sum() for _, _, c, _ in leaves) <= 1
    for _, _, c, _ in leaves:  # within ten standard deviations
        assert abs(c[0] / c.sum() - 0.6) < 10 * (0.24 / c.sum()) ** 0.5


def test_draws_from_large_urns_are_distributed_as_from_small_ones(monkeypatch):
    good, bad, n = 30, 50, 24
    rng = np.random.default_rng(1)
    want = rng.hypergeometric(good, bad, n, 20_000)
    monkeypatch.setattr(M, "URN", 5)
    monkeypatch.setattr(M, "FEW", 2)
    got = np.array([M.drawn_of(rng, good, bad, n) for _ in range(20_000)])
    assert abs(got.mean() - want.mean()) < 0.06 and abs(got.std() - want.std()) < 0.06
    assert np.abs(np.bincount(got, minlength=25) - np.bincount(want, minlength=25)).max() < 400


def test_blocks_are_permuted(spark):
    for n in (1, 2, 97, 1000):
        keys = F.array(*[F.lit(k).cast("long") for k in np.random.default_rng(n).integers(0, n, M.ROUNDS).tolist()])
        got = [r[0] for r in spark.range(n).select(M.permuted(F.col("id"), F.lit(n).cast("long"), keys)).collect()]
        assert sorted(got) == list(range(n)) and (n < 97 or abs(np.corrcoef(got, range(n))[0, 1]) < 0.3)
    big = 50_000_000_000_000
    keys = F.array(*[F.lit(k).cast("long") for k in (3, big - 1, big // 2)])
    got = [r[0] for r in spark.range(big - 1000, big).select(M.permuted(F.col("id"), F.lit(big).cast("long"), keys)).collect()]
    assert len(set(got)) == 1000 and 0 <= min(got) and max(got) < big

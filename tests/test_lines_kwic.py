import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import kwic as K
from lexiloom.operators import lines as L

SCHEMA = "file_id string, line_no int, line_id string, text string, is_synthetic boolean"


def table(spark, texts, file="f", start=0):
    return spark.createDataFrame([(file, i + start, f"{i:04}a", t, t is None and i % 2 == 1) for i, t in enumerate(texts)], SCHEMA)


def brute(rows, term, ctx):
    """rows: (line_no, line_id, text) in order."""
    cjk = K.is_ideographic(term)
    out = []
    for i, (no, lid, t) in enumerate(rows):
        low, want = (t, term) if cjk else (t.lower(), term.lower())
        p = low.find(want)
        while p >= 0:
            sep = "" if cjk else " "
            left = sep.join([x[2] for x in rows[:i]] + [t[:p]])[-ctx:]
            right = sep.join([t[p + len(term):]] + [x[2] for x in rows[i + 1:]])[:ctx]
            if not cjk:
                if len(left) == ctx and 0 < left.find(" ") < len(left) - 1:
                    left = left[left.find(" ") + 1:]
                if len(right) == ctx and right.rfind(" ") > 0:
                    right = right[: right.rfind(" ")]
            out.append((no, lid, p, left, t[p: p + len(term)], right, rows[max(0, i - 2)][1], rows[min(len(rows) - 1, i + 2)][1]))
            p = low.find(want, p + (1 if cjk else len(term)))
    return sorted(out)


def hits(df):
    return sorted((r["line_no"], r["line_id"], r["pos"], r["left"], r["match"], r["right"], r["start_id"], r["end_id"]) for r in df.collect())


@pytest.mark.parametrize("term, texts", [("佛佛", ["佛佛佛", "", "x佛", "佛佛"]), ("aa", ["aaaa", "b AA c", ""]), ("the", ["the cat and the hat sat there for the long while indeed", "then", "", "x", "over the hill"])])
def test_hits_and_contexts(spark, term, texts):
    rows = [(i, f"{i:04}a", t) for i, t in enumerate(texts)]
    assert hits(K.kwic(table(spark, texts), term, 12)) == brute(rows, term, 12)


def test_many_lines_over_chunks(spark):
    rng = random.Random(4)
    words = ["the", "cat", "", "禪", "a the b", "long word here", "The"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(4))) for _ in range(1300)]
    rows = [(i, f"{i:04}a", t) for i, t in enumerate(texts)]
    assert hits(K.kwic(table(spark, texts), "the", 40)) == brute(rows, "the", 40)
    assert hits(K.kwic(table(spark, texts), "禪", 20)) == brute(rows, "禪", 20)


def test_synthetic_repeats_nulls_and_empty(spark):
    rows = [("f", 0, "a", "x q", False), ("f", 1, "pb", "q", True), ("f", 2, "b", None, False), ("f", 3, "c", "q", False), ("f", 3, "c", "q", False), (None, 1, "z", "q", False)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(h[0], h[6], h[7]) for h in hits(K.kwic(df, "q"))] == [(0, "a", "c"), (3, "a", "c")]
    assert K.kwic(df.filter("false"), "q").count() == 0 and K.kwic(df, "").count() == 0
    assert K.kwic(df, "q", only=spark.createDataFrame([("g",)], "file_id string")).count() == 0


def test_ordinals_are_exact_with_gaps(spark):
    rows = spark.createDataFrame([("f", i * 7 % 1000 * 50) for i in range(1000)] + [("g", 5)], "file_id string, line_no int")
    got = L.with_ordinal(rows, span=64).filter("file_id = 'f'").orderBy("line_no").select("ordinal").collect()
    assert [r["ordinal"] for r in got] == list(range(1000))


def test_slices_and_snippets(spark):
    df = table(spark, ["one", "two", "", "four", "five"])
    ask = spark.createDataFrame([("a", "f", "0001a", "0003a"), ("b", "f", "0001a", ""), ("c", "f", "zz", "0001a"), ("d", "f", "0003a", "0001a"), ("e", "f", "", "")], "range_id string, file_id string, from_id string, to_id string")
    got = {}
    for r in L.slice_between(df, ask).orderBy("line_no").collect():
        got.setdefault((r["range_id"], r["fallback"]), []).append(r["text"])
    assert got == {("a", False): ["two", "", "four"], ("b", False): ["two"], ("c", True): ["one", "two", "", "four", "five"], ("d", True): ["one", "two", "", "four", "five"], ("e", False): ["one", "two", "", "four", "five"]}
    s = {r["range_id"]: r["snippet"] for r in L.snippets(df, ask, shown=8).collect()}
    assert s["a"] == "two four" and s["c"] == "[line not found]" and s["d"] == "four"


def test_first_and_pages(spark):
    df = table(spark, ["a", "b", "", "the", "e"])
    assert L.first_lines(df, 0).count() == 0 and L.first_lines(df, 3).count() == 3
    rows = L.with_ordinal(L.real_lines(df))
    assert [(r["page"], r["pages"]) for r in L.pages(rows, 2).orderBy("line_no").collect()] == [(1, 3), (1, 3), (2, 3), (2, 3), (3, 3)]
    assert L.page_of(rows, F.col("text") == "the", 2).first()["page"] == 2 and L.page_of(rows, F.col("text") == "no", 2).first()["page"] == 1
    assert spark.range(1).select(L.page_buttons(F.lit(5), F.lit(9)).alias("b")).first()["b"] == [1, 4, 5, 6, 9]

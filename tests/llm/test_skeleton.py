import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.llm import skeleton as S

SAME = [
    ("\uff21bc", "Abc"), ("\u00e9", "e\u0301"), ("a\u200bb", "ab"), ("a\u00a0b", "a b"), ("\u3000", " "), ("\u0430\u0440\u0435", "ape"), ("\ufb01n", "fin"), ("\u2f08", "\u4eba"), ("\uf90a", "\u91d1"),
    ("\u535c", "\u30c8"), ("\uac01", "\u1100\u1161\u11a8"), ("a\u00adb\ufe00\U000e0100", "ab"), ("q\u0307\u0323", "q\u0323\u0307"), ("\uff1a", ":"), ("\u0391\u2060", "A"), ("\u2026", "..."), ("\u2010", "-"), ("\u202f", "\u2007"),
]
DIFFERENT = [("a", "A"), ("\u00e9", "e"), ("\u56fd", "\u570b"), ("x\u00b2", "x2"), ("\u2460", "1"), ("\u3280", "\u4e00"), ("a  b", "a b"), ("a\nb", "a b"), ("\u2013", "-"), ("", " ")]


def test_pairs():
    for a, b in SAME:
        assert S.skeletons([a]) == S.skeletons([b]), (a, b)
    for a, b in DIFFERENT:
        assert S.skeletons([a]) != S.skeletons([b]), (a, b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=12), max_size=5))
def test_is_stable_and_batching_does_not_matter(texts):
    once = S.skeletons(texts)
    assert S.skeletons(once) == once
    assert once == [S.skeletons([t])[0] for t in texts]
    assert all(unicodedata.normalize("NFD", x) == x for x in once)


def test_pairs_of_rows(spark):
    rows = [("a", "ab"), ("b", "a\u200bb"), ("c", "ab"), ("d", "AB"), ("e", None), (None, "ab"), ("a", "ab"), ("f", ""), ("g", "\u200b")]
    df = spark.createDataFrame(rows, "k string, text string")
    got = sorted((r["key_a"], r["key_b"]) for r in S.look_alike_pairs(df, F.col("k"), "text").collect())
    assert got == [("a", "b"), ("b", "c"), ("f", "g")]
    classes = sorted(tuple(r) for r in S.look_classes(df, F.col("k"), "text").collect())
    assert classes == [("a", "a", 2, 3), ("b", "a", 2, 3), ("c", "a", 2, 3), ("f", "f", 2, 2), ("g", "f", 2, 2)]
    assert S.look_alike_pairs(df.filter("false"), F.col("k"), "text").count() == 0


def test_readings(spark):
    kind = "file_id string, seq int, lem string, readings array<struct<wit:string,text:string>>"
    gold, other = "\u91d1", "\uf90a"
    rows = [("f", 1, gold, [("A", other), ("B", gold), ("C", None), (None, other)]), ("f", 1, gold, [("A", other)]), ("f", 2, None, [("A", "x")]), ("f", 3, "x", None)]
    got = [tuple(r) for r in S.look_alike_readings(spark.createDataFrame(rows, kind)).collect()]
    assert got == [("f#1", "A")]


def test_public_table(spark):
    table = S.prototypes(S.public_table(spark))
    assert len(table) > 8_000
    arrays = S._arrays(table)
    same = lambda a, b: S.skeletons([a], arrays) == S.skeletons([b], arrays)
    for a, b in [*SAME, ("l", "I"), ("1", "l"), ("0", "O"), ("m", "rn"), ("\u13a0", "D"), ("\u2c9f", "o"), ("\ua4d0", "B"), ("\U00010404", "O"), ("\u2019", "'"), ("\u2ec4", "\u897f")]:
        assert same(a, b), (a, b)
    for a, b in [p for p in DIFFERENT if p not in [("\u2013", "-")]]:
        assert not same(a, b), (a, b)
    for arrays_, alike in ((arrays, [{*"lI1|"}, {*"O0"}, {*"'`"}]), (S._tables(), [])):
        kept = {}
        for c in map(chr, range(0x21, 0x7F)):
            kept.setdefault(S.skeletons([c], arrays_)[0], set()).add(c)
        assert sorted(map(sorted, (x for x in kept.values() if len(x) > 1))) == sorted(map(sorted, alike))
    listed = [*map(chr, range(0x20, 0x3000))]
    once = S.skeletons(listed, arrays)
    assert S.skeletons(once, arrays) == once

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import ids, routes, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, wanted", [("   a    b   c   ", "a b c"), ("a   \n   b", "a\nb"), ("a\r\nb", "a\nb"), ("　x ", "x"), ("", ""), (None, None)])
def test_normalize(spark, given, wanted):
    assert one(spark, text.normalize_text(F.col("t")), t=given) == wanted


def test_escape_and_marks(spark):
    assert one(spark, text.escape_html(F.col("t")), t="<tag attr=\"v\" alt='x'>a & b</tag>") == "&lt;tag attr=&quot;v&quot; alt=&#39;x&#39;&gt;a &amp; b&lt;/tag&gt;"
    assert one(spark, text.escape_html(F.col("t")), t=None) == ""
    assert one(spark, text.highlight(F.col("t"), "a.b"), t="A.b axb a.B") == "<mark>A.b</mark> axb <mark>a.B</mark>"
    assert one(spark, text.marked_term(F.col("t")), t="x <mark>q\nr</mark> <mark>z</mark>") == "q\nr"
    assert one(spark, text.marks_only(F.col("t")), t="<b><mark>x</mark></b>") == "&lt;b&gt;<mark>x</mark>&lt;/b&gt;"


def test_numbers_dates_urls(spark):
    assert one(spark, text.leading_int(F.col("t")), t="12px") == 12 and one(spark, text.leading_int(F.col("t")), t="x") is None
    assert one(spark, text.encoded(F.col("t")), t="a b!'()*~ü") == "a%20b!'()*~%C3%BC"
    assert one(spark, text.decoded(F.col("t")), t="a+b%20c") == "a+b c" and one(spark, text.decoded(F.col("t")), t="%zz") == "%zz"
    assert one(spark, text.safe_color(F.col("t")), t="#12ab") == "#12ab" and one(spark, text.safe_color(F.col("t")), t="red") is None
    assert one(spark, text.iso_day(F.col("t")), t="2024-03-05T01:02:03Z") == "Mar 5, 2024" and one(spark, text.iso_day(F.col("t")), t="never") == ""
    assert one(spark, text.line_range(F.col("a"), F.col("b")), a="1", b="1") == "1" and one(spark, text.shortened(F.col("t"), 3), t="abcd") == "abc…"


@pytest.mark.parametrize("i, kind, path", [("T48n2005", "canonical", "T/T48/T48n2005.xml"), ("T85nA2774", "canonical", "T/T85/T85nA2774.xml"), ("ws.gateless-barrier", "published", "ws/gateless-barrier/gateless-barrier.xml"), ("garbage", "unknown", None), ("ws.", "unknown", None), ("", "unknown", None)])
def test_ids(spark, i, kind, path):
    assert one(spark, ids.corpus_of_id(F.col("t")), t=i) == kind and one(spark, ids.path_of_id(F.col("t")), t=i) == path


def test_paths(spark):
    assert one(spark, ids.id_of_path(F.col("t")), t="ws\\a-b\\a-b.xml") == "ws.a-b" and one(spark, ids.id_of_path(F.col("t")), t="T/T48/T48n2005.XML") == "T48n2005"
    assert one(spark, ids.corpus_of_path(F.col("t")), t="x/y.txt") == "unknown" and one(spark, ids.corpus_of_path(F.col("t")), t=None) == "unknown"
    for p, same in (("T48/T48n2005.xml", True), ("t48n2005.xml", True), ("T/T48/T48n2006.xml", False), (None, False)):
        assert one(spark, ids.same_work(F.col("p"), F.col("i")), p=p, i="T48n2005") is same
    assert one(spark, ids.slug(F.col("t"), "shard"), t="Old 'Ann' Lee") == "old_ann_lee" and one(spark, ids.slug(F.col("t"), "page"), t="O'An  Lee") == "OAn_Lee"
    assert one(spark, ids.first_codepoint_bucket(F.col("t")), t="𠀀x") == 131072 % 201


ROUTES = {
    "T48n2005/0292a26-0292a29/en/Some%20One?q=a+b": {"kind": "passage", "work": "T48n2005", "start_line": "0292a26", "end_line": "0292a29", "side": "en", "user": "Some One", "q": "a b"},
    "T48n2005": {"kind": "passage", "start_line": "", "side": "zh", "user": ""},
    "passage/T48n2005/0292b29": {"kind": "passage", "start_line": "0292b29", "end_line": "0292b29"},
    "ws.some-work/wm32.case01.l01-wm32.case01.l02": {"kind": "passage", "corpus": "published", "start_line": "wm32.case01.l01", "end_line": "wm32.case01.l02"},
    "tags/T48n2005//topic-1": {"kind": "tags", "work": "T48n2005", "user": "topic-1", "item": ""},
    "tags/T48n2005/u?tag=x": {"kind": "tags", "user": "u", "item": "x"},
    "dict/%E7%A6%85": {"kind": "dictionary", "item": "禅"},
    "master/Old_Ann/u": {"kind": "master", "item": "Old Ann", "user": "u"},
    "scholar/u/My%20List/graph": {"kind": "scholar-graph", "user": "u", "item": "My List"},
    "scholar/u/list/p1": {"kind": "scholar", "user": "u", "item": "list/p1"},
    "scholar/abc//u": {"kind": "scholar", "user": "u", "item": "abc"},
    "scholar/0123456789abcdef01234567/p/u": {"kind": "scholar", "user": "u", "item": "0123456789abcdef01234567/p"},
    "scholar/abc?user=u": {"kind": "scholar", "user": "u", "item": "abc"},
    "search?q=x%20y&master=Foo": {"kind": "search", "q": "x y", "item": "Foo"},
    "lineage?focus=A_B": {"kind": "lineage", "item": "A B"},
    "compare/T48n2005/ORIG/a/b?from=1&to=2": {"kind": "compare", "work": "T48n2005", "item": "orig/a/b", "start_line": "1", "end_line": "2"},
    "no such thing": {"kind": "unknown"},
}


def test_routes(spark):
    rows = spark.createDataFrame([(r,) for r in [*ROUTES, ""]], "r string")
    got = {r["r"]: r["x"] for r in rows.select("r", routes.parsed_route(F.col("r")).alias("x")).collect()}
    assert got.pop("") is None
    for raw, want in ROUTES.items():
        assert {k: got[raw][k] for k in want} == want, raw
    label = {r["r"]: r["x"] for r in rows.select("r", routes.described_route(routes.parsed_route(F.col("r"))).alias("x")).collect()}
    assert label["T48n2005/0292a26-0292a29/en/Some%20One?q=a+b"] == "T48n2005 · 0292a26-0292a29" and label["lineage?focus=A_B"] == "Lineage · A B"
    assert one(spark, routes.share_url(F.col("t"), "https://x.example/"), t="/a/b") == "https://x.example/#/a/b"

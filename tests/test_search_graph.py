import pytest
from pyspark.sql import functions as F

from lexiloom.operators import align, dictionary, graph, lists, search


@pytest.fixture(scope="module")
def persons(spark):
    return spark.createDataFrame([(0, ["Ann Lee", "安"], "S1"), (1, ["Bo Ro", "伯老"], "S2"), (2, ["Anna Xu"], "S1"), (3, None, None), (4, ["Old Ann"], "")], "row_no long, names array<string>, school string")


@pytest.fixture(scope="module")
def titles(spark):
    rows = [(0, "T/a.xml", "a", "伯老語", "On Reeds", None, "first"), (1, "T/b.xml", "b", None, "Ann Lee's way", "Way", "first"), (2, "ws/c/c.xml", "ws.c", "", "Third", None, "second"), (3, "T/b.xml", "b", None, "Again", None, "first"), (4, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "row_no long, path string, fileId string, zh string, en string, enShort string, corpus string")


def test_people_titles(spark, persons, titles):
    assert [r["row_no"] for r in search.people(persons, "ann").collect()] == [0, 2, 4] and search.people(persons, "").count() == 0
    assert [r["row_no"] for r in search.titles(titles, "way").collect()] == [1] and search.titles(titles, "").count() == 5
    keep = spark.createDataFrame([("b",)], "fileId string")
    assert [r["row_no"] for r in search.titles(titles, "", only=keep).collect()] == [1, 3]
    assert [r["row_no"] for r in search.browse(titles, folder="T", without=keep).collect()] == [0]
    got = [(r["row_no"], r["person_no"]) for r in search.titles_of_people(persons, titles).orderBy("row_no").collect()]
    assert got == [(0, 1), (1, 0)]
    assert [(r["section"], r["key"]) for r in search.typeahead(persons, titles, "an").collect()][:3] == [("people", "Ann Lee"), ("people", "Anna Xu"), ("people", "Old Ann")]
    assert [r["row_no"] for r in search.person_named(persons, spark.createDataFrame([("BO_RO",)], "name string")).collect()] == [1]


def test_contained_blocks_and_overlaps(spark):
    texts = spark.createDataFrame([(1, "aaaa b"), (2, None), (3, ""), (4, "bab")], "i int, text string")
    patterns = spark.createDataFrame([("aa",), ("b",), ("",), (None,), ("ab",)], "pattern string")
    for block in (100, 1):
        got = {(r["i"], r["pattern"], r["n"]) for r in search.contained(texts, patterns, block=block).collect()}
        assert got == {(1, "aa", 2), (1, "b", 1), (4, "b", 2), (4, "ab", 1)}
    assert search.contained(texts, patterns.filter("false")).count() == 0


def test_fulltext_grouping(spark):
    docs = spark.createDataFrame([(1, "f", "Reed reed"), (2, "f", "reed"), (3, "", "reed"), (4, "g", None), (5, "h", "REED reed reed")], "doc_id long, file_id string, text string")
    hits = search.fulltext(docs, "reed")
    assert [(r["doc_id"], r["hits"]) for r in hits.collect()] == [(5, 3), (1, 2), (2, 1), (3, 1)]
    assert [(r["file_id"], r["hits"]) for r in search.grouped_hits(hits).collect()] == [("f", 3), ("h", 3)]


def test_dictionary(spark):
    lines = spark.createDataFrame([(0, "# c"), (1, ""), (2, "中國 中国 [Zhong1 guo2] /China/Middle Kingdom/"), (3, "菩提 菩提 [pu2 ti2] /bodhi/"), (4, "菩 菩 [pu2] / /"), (5, "菩提樹 菩提树 [x] /tree/"), (6, "none")], "row_no long, line string")
    e = dictionary.parsed_entries(lines)
    assert [(r["row_no"], r["trad"], r["simp"], r["pinyin"], r["defs"]) for r in e.orderBy("row_no").collect()] == [(2, "中國", "中国", "Zhong1 guo2", ["China", "Middle Kingdom"]), (3, "菩提", "菩提", "pu2 ti2", ["bodhi"]), (5, "菩提樹", "菩提树", "x", ["tree"])]
    t = spark.createDataFrame([("k", "菩提樹下"), ("m", "水"), ("n", "")], "key string, text string")
    assert [(r["key"], r["found"]) for r in dictionary.longest_prefix(t, e).collect()] == [("k", "菩提樹")]
    terms = spark.createDataFrame([("中国",), ("菩提",), ("",), (None,)], "term string")
    assert {(r["term"], r["row_no"]) for r in dictionary.looked_up(terms, e).collect()} == {("中国", 2), ("菩提", 3)}
    assert dictionary.by_character(e, 1).count() == 2


def test_align_and_lists(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("x", 9), ("z", 3)], "k string, v int")
    assert {(r["k"], r["v"], r["choice"]) for r in align.first_available([a, b], "k").collect()} == {("x", 1, 0), ("y", 2, 0), ("z", 3, 1)}
    assert {(r["k"], r["v"]) for r in lists.upsert(a, b, ["k"]).collect()} == {("x", 9), ("y", 2), ("z", 3)}
    assert [r["k"] for r in lists.removed(a, b, ["k"]).collect()] == ["y"]
    best = spark.createDataFrame([("p", 0, 1), ("q", 5, 2), ("q", 5, 1), ("q", 4, 0)], "k string, v int, o int")
    assert [(r["k"], r["o"]) for r in align.best(best, ["k"], "v", "o").collect()] == [("q", 1)]
    w = spark.createDataFrame([(1, "#w1  w2"), (2, "")], "id int, wit string")
    assert [(r["id"], r["witnesses"]) for r in align.witness_labels(w, spark.createDataFrame([("w1", "One")], "siglum string, label string"), ["id"]).collect()] == [(1, "One, w2")]
    t = spark.createDataFrame([("u", i, s) for i, s in enumerate(["2024-01-01 00:00:00", "2024-01-01 00:10:00", "2024-01-02 23:00:00", "2024-01-03 00:10:00"])], "k string, i int, s string").withColumn("at", F.to_timestamp("s"))
    assert [r["shown"] for r in lists.cooled_down(t, "k", "at", 3600, "i").orderBy("i").collect()] == [True, False, True, True]
    assert [r["i"] for r in lists.within_budget(t.withColumn("n", F.lit(3)), "k", "at", "n", 7, "i").orderBy("i").collect()] == [2, 3]


def test_lineage_layout(spark):
    links = spark.createDataFrame([("A", None), ("B", "A"), ("C", "B"), ("X", "Y"), ("Y", "X"), ("Z", None)], "key string, parent string")
    layers = {r["key"]: r["layer"] for r in graph.lineage_layers(links).collect()}
    assert layers == {"A": 0, "B": 1, "C": 2, "X": -1, "Y": -1, "Z": 0}
    rows = spark.createDataFrame([("l", i, float(y)) for i, y in enumerate([0, 10, 20, 200, 200])], "l string, i int, y double")
    assert [r["placed"] for r in graph.pushed_down(rows, ["l"], "y", "i", 44).orderBy("i").collect()] == [0, 44, 88, 200, 244]
    assert [r["placed"] for r in graph.pushed_down(rows.withColumn("y", F.lit(5.0)), ["l"], "y", "i", 44, span=2).orderBy("i").collect()] == [5, 49, 93, 137, 181]


def test_property_graph(spark):
    kind = ("id string, name string, row_no long, modifiedUtc int, parentCollectionId string, passages array<struct<id:string,sourceRelPath:string,zhText:string,summary:string,annotationType:string,masterNames:array<string>>>,"
            " concepts array<struct<id:string,name:string,status:int>>, links array<struct<fromPassageId:string,toPassageId:string,relationType:string,weight:double,colorHex:string>>, ExtraMasters array<string>")
    p = [("p1", "T/x.xml", "", "", None, ["M", "M", None]), ("p2", None, "字" * 40, "", "Book", ["M"]), None, ("", None, None, "no id", None, None), ("p3", None, None, "S", None, ["N"])]
    rows = [("c", "C", 0, 1, None, p, [("k", None, 1)], [("p1", "p2", "echoes", 0.0, ""), ("person:N", "p3", "x", 2.0, "#fff"), ("p1", "gone", None, None, None), None], ["E"]), ("d", "Sub", 1, 1, " C ", None, None, None, None), ("e", None, 2, 1, None, [], [], [], [])]
    df = spark.createDataFrame(rows, kind)
    nodes = graph.graph_nodes(df)
    got = {r["node_id"]: (r["type"], r["label"]) for r in nodes.filter("collection_id = 'c'").collect()}
    assert got == {"p1": (0, "x"), "p2": (5, "字" * 30), "p3": (0, "S"), "k": (1, "?"), "person:M": (2, "M"), "person:N": (2, "N"), "person:E": (2, "E"), "d": (4, "Sub")}
    edges = graph.graph_edges(df, nodes)
    got = sorted((r["from_id"], r["to_id"], r["weight"], r["is_auto"]) for r in edges.collect())
    assert got == [("p1", "p2", 1.0, False), ("p1", "person:M", 0.5, True), ("p1", "person:M", 0.5, True), ("person:N", "p3", 2.0, False)]
    deg = {r["node_id"]: r["degree"] for r in graph.degrees(edges).collect()}
    assert sum(deg.values()) == 2 * len(got) and deg["p1"] == 3
    place = graph.force_layout(nodes, edges).collect()
    assert len(place) == nodes.count() and all(abs(r["x"]) < 1e6 for r in place)
    assert graph.ego(edges, spark.createDataFrame([("c", "p2")], "collection_id string, node_id string")).count() == 1


def test_pages_round_trip(spark):
    from lexiloom.plans import pages

    rows = [(0, ["A & B", "安"], "S1", 700, 0, "T", ["x", "y"], "No<te", [("https://e.example", "L")]), (1, ["O'C  D"], None, None, 801, None, None, None, None), (2, None, "S", 1, 2, None, None, None, None), (3, ["a & b"], "late", 1, 2, None, None, None, None)]
    df = spark.createDataFrame(rows, "row_no long, names array<string>, school string, floruit int, death int, teacher string, students array<string>, notes string, links array<struct<url:string,label:string>>")
    facts = {r["row_no"]: (r["slug"], r["facts"]) for r in pages.person_facts(df).collect()}
    assert facts == {0: ("A_&_B", "School: S1 | Teacher: T | Students: x, y"), 1: ("OC_D", "d. 801")}
    back = {r["row_no"]: (r["heading"], r["teacher"], r["students"]) for r in pages.scraped(pages.person_facts(df)).collect()}
    assert back == {0: ("A &amp; B 安", "T", ["x", "y"]), 1: ("O&#39;C  D", "", [])}
    routes = spark.createDataFrame([("",), ("person/x",), ("T1",)], "route string")
    assert sorted(r["line"].split("<priority>")[1][:3] for r in pages.sitemap(routes, "https://x.example", "2026-01-01").collect()) == ["0.6", "0.8", "1.0"]
    n = spark.createDataFrame([("p", 1, 5), ("p", 2, 7), ("q", 3, 1)], "person string, doc_id long, n long")
    assert {r["person"]: (r["documents"], r["total_mentions"], r["top"]) for r in pages.person_shards(n, 1).collect()} == {"p": (2, 12, [2]), "q": (1, 1, [3])}

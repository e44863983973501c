import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.sources import files, markup
from lexiloom.sources.markup import read_document
from lexiloom.streaming.jsonl import counted, drained, json_stream, latest_by_key

NS = 'xmlns="http://www.tei-c.org/ns/1.0" xmlns:cb="http://x.example"'


def doc(body, head="", back=""):
    return f"<TEI {NS}><teiHeader>{head}</teiHeader><text><body>{body}</body>{back}</text></TEI>"


def texts(body):
    return [(x["line_id"], x["text"]) for x in read_document(doc(body))["lines"] if not x["is_synthetic"]]


def test_lines():
    assert texts('<p><lb n="0001a01"/>Hello world</p>') == [("0001a01", "Hello world")]
    assert texts('lost<lb n="1"/> a <lb n="2"/>b<lb n="1"/>c') == [("1", "a c"), ("2", "b")]
    assert texts('<lb n="1" ed="X"/>a<lb n="9" ed="R"/>b<lb n="2"/>c') == [("1", "ab"), ("2", "c")]
    assert texts('<lb n="1"/>x<note place="foot">n<lb n="8"/></note>y<cb:mulu>M</cb:mulu><head>M</head>&amp;<!-- c --><![CDATA[<d>]]>') == [("1", "xyM&<d>")]
    assert texts('<lb n="1"/>a<g ref="#x">字</g>b<caesura/>c') == [("1", "a字b　c")]


def test_synthetic_lines():
    got = read_document(doc('<lb n="1"/>a<pb/><lg><l>v</l></lg>'))["lines"]
    assert [x["line_id"] for x in got] == ["1", "__pb_break_0", "__lg_break_1", "__lg_break_2"]


def test_headings_and_juan():
    got = read_document(doc('<cb:juan n="1"/><lb n="1"/><head>Chap <note>no</note>One</head><milestone unit="juan" n="x3"/><lb n="2"/><head> </head><head>Two</head>'))
    assert [(h["line_id"], h["text"], h["juan"]) for h in got["headings"]] == [("1", "Chap One", "1"), ("2", "Two", "x3")]


def test_apparatus_titles_witnesses():
    got = read_document(doc('<lb n="1"/>xx<app><lem>a<app><lem>b</lem><rdg wit="i">q</rdg></app></lem><rdg wit="#w1">c<note>n</note>d</rdg></app>y<anchor xml:id="beg1"/>z',
                            '<fileDesc><titleStmt><title xml:lang="zh-Hant">題</title><title xml:lang="en">T</title></titleStmt></fileDesc><listWit><witness xml:id="w1"> W one </witness></listWit>',
                            '<back><app from="#beg1"><lem>z</lem><rdg wit="w2">k</rdg></app><app from="#none"><lem>z</lem></app></back>'))
    assert [(a["pos"], a["lem"], [(r["wit"], r["text"]) for r in a["readings"]]) for a in got["apparatus"]] == [(3, "b", [("i", "q")]), (2, "ab", [("#w1", "cd")]), (5, "z", [("w2", "k")])]
    assert (got["title_zh"], got["title_en"]) == ("題", "T") and got["witnesses"] == [{"wit_id": "w1", "label": "W one"}]
    assert read_document("<a")["error"].startswith("not well-formed") and read_document("<a/>")["error"] == "no body"


def test_tables(spark):
    df = markup.parsed(spark.createDataFrame([("a", doc('<lb n="1"/><head>H</head>t')), ("b", None), ("c", "<x/>")], "file_id string, xml string"))
    assert [(r["file_id"], r["line_no"], r["text"]) for r in markup.lines(df).collect()] == [("a", 0, "Ht")]
    assert markup.headings(df).count() == 1 and markup.apparatus(df).count() == 0 and df.filter("error is null").count() == 1


def test_index_text(spark):
    rows = [('<body>a<rdg wit="x">b</rdg>c\rd</body>', "a cd"), ("<BODY x='1'>a<b/>  b</BODY>", "a b"), ("no", ""), ("<body>a<rdg/>b</body>", "a"), ("<body>a<rdg><rdg>q</rdg>r</rdg>s</body>", "a s"), ("<body>a <rdg>1<RDG x='2'>2<rdg>3<rdg>4</rdg></rdg>3</rdg >2</rdg> z <rdgGrp>k</rdgGrp></body>", "a z k"), (None, "")]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "i int, x string")
    assert [r["t"] for r in df.orderBy("i").select(markup.index_text(F.col("x")).alias("t")).collect()] == [w for _, w in rows]


def test_jsonl_and_listing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"id": "a", "t": "2024-01-01T00:00:00Z", "n": 1}\n{bad\n\n{"id": "a", "t": "2024-01-01T00:05:00Z", "n": 2}\r\n{"id": "b", "t": "2024-01-01T00:01:00Z", "n": 3}')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("t", T.TimestampType()), T.StructField("n", T.IntegerType())])
    assert sorted(r["n"] for r in files.read_jsonl(spark, str(tmp_path / "in"), schema).collect()) == [1, 2, 3]
    assert files.read_documents(spark, str(tmp_path / "none")).count() == 0
    assert files.nonempty(files.listed(spark, str(tmp_path / "in"))).count() == 1
    rows = json_stream(spark, str(tmp_path / "in"), schema)
    drained(latest_by_key(rows, "id", "t", "1 hour", "t"), str(tmp_path / "c1"), lambda b, _: b.write.mode("append").parquet(str(tmp_path / "latest")), "complete")
    assert {(r["id"], r["n"]) for r in spark.read.parquet(str(tmp_path / "latest")).collect()} == {("a", 2), ("b", 3)}
    drained(counted(rows, "t", "10 minutes", "1 minute", "id"), str(tmp_path / "c2"), lambda b, _: b.write.mode("append").parquet(str(tmp_path / "counts")), "complete")
    assert {(r["id"], r["n"]) for r in spark.read.parquet(str(tmp_path / "counts")).collect()} == {("a", 2), ("b", 1)}


def test_writers(spark, tmp_path):
    e = spark.createDataFrame([("菩提", "b"), ("菩", "c"), ("𠀀", "d")], "trad string, x string")
    files.write_by_character(e, str(tmp_path / "d"))
    back = spark.read.json(str(tmp_path / "d"))
    assert back.count() == 3 and {r["bucket"] for r in back.filter("first_char = '𠀀'").collect()} == {131072 % 201}
    files.write_by_person(spark.createDataFrame([("Old Ann", 1)], "name string, n int"), "name", str(tmp_path / "p"))
    assert (tmp_path / "p" / "slug=old_ann").exists()
    assert json.loads(spark.read.text(str(tmp_path / "p")).first()[0])["n"] == 1


def test_small_readers(spark, tmp_path):
    e = spark.createDataFrame([("菩提", "b"), ("菩", "c"), ("水", "d")], "trad string, x string")
    files.write_by_character(e, str(tmp_path / "d"))
    assert sorted(r["x"] for r in files.read_character(spark, str(tmp_path / "d"), "菩").collect()) == ["b", "c"]
    assert files.read_character(spark, str(tmp_path / "d"), "").count() == 0
    paths = spark.createDataFrame([("file:/a/Some%20One.jsonl",), ("file:/a/Bo/x.xml",), ("file:/a/Bo/y.xml",)], "path string")
    assert sorted(r["owner"] for r in files.owners(paths).collect()) == ["Bo", "Some One"]
    j = spark.createDataFrame([(["T/T1.xml", "T/T1.xml", "x.xml"], [(["A"], 1), (["B"], None)])], "Works array<string>, masters array<struct<names:array<string>,death:int>>")
    assert sorted(r["fileId"] for r in files.listed_ids(j, "Works").collect()) == ["T1", "x"]
    assert [(r["row_no"], r["names"]) for r in files.people_of(j).collect()] == [(0, ["A"]), (1, ["B"])]
    c = spark.createDataFrame([('{"a": 2, "b": 0, "c": -1}',), (None,)], "j string")
    assert [(r["key"], r["n"]) for r in files.counts_of(c, "j").collect()] == [("a", 2.0)]


def test_grammar_and_index(spark):
    from lexiloom.operators.dictionary import with_grammar
    from lexiloom.plans.index import phrase_candidates, postings

    g = spark.createDataFrame([("也", ["end"])], "char string, functions array<string>")
    t = spark.createDataFrame([("也",), ("也乎",), (None,)], "term string")
    assert {(r["term"], tuple(r["functions"] or [])) for r in with_grammar(t, g).collect()} == {("也", ("end",)), ("也乎", ()), (None, ())}
    d = spark.createDataFrame([(1, "Old reed, old reed"), (2, "reed"), (3, None), (4, "")], "doc_id long, text string")
    p = postings(d)
    assert {(r["token"], r["doc_id"], r["n"]) for r in p.collect()} == {("old", 1, 2), ("reed", 1, 2), ("reed", 2, 1)}
    many = postings(spark.createDataFrame([(1, "禪師 a禪 Mé́b2，བོད་ 가"), (2, "x")], "doc_id long, text string"))
    assert {r["token"] for r in many.filter("doc_id = 1").collect()} == {"禪師", "a", "禪", "mé́b2", "བོ", "ོད", "가"}
    assert [r["doc_id"] for r in phrase_candidates(p, ["Old", "reed"]).collect()] == [1]


def test_manifest_and_listings(spark, tmp_path):
    e = spark.createDataFrame([("菩提", "b"), ("菩", "c"), ("𠀀", "d")], "trad string, x string")
    files.write_by_character(e, str(tmp_path / "d"))
    files.write_manifest(e, str(tmp_path / "d"))
    assert {(r["first_char"], r["n"], r["in_bucket"]) for r in files.manifest(spark, str(tmp_path / "d")).collect()} == {("菩", 2, ord("菩") % 201), ("𠀀", 1, 131072 % 201)}
    assert [r["x"] for r in files.read_character(spark, str(tmp_path / "d"), "𠀀").collect()] == ["d"]
    for name in ("a/T/T1.xml", "a/T/x.txt", "b/T1.xml", "b/ws/one/one.xml"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("<x/>")
    assert sorted(r["fileId"] for r in files.listed_works(spark, str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "none")).collect()) == ["T1", "one"]


def test_small_helpers(spark):
    from lexiloom.functions import html, text
    from lexiloom.operators.lists import last_read
    from lexiloom.plans.pages import robots

    one = spark.range(1)
    got = one.select(*[text.described_source(F.lit(x)).alias(f"s{i}") for i, x in enumerate(("", "ME", "auth", "Bo"))], text.described_mode(F.lit("zh"), F.lit("x")).alias("m"),
                     text.passage_name(F.lit(" " + "a" * 60), F.lit("z"), F.lit("i")).alias("p"), html.line_row(F.lit(None), F.lit("t")).alias("l"), html.card_list(F.array().cast("array<string>")).alias("c")).first()
    assert list(got)[:5] == ["—", "My copy (local only)", "Authoritative", "Community · Bo", "Chinese source preview"] and got["p"] == "a" * 49 and got["l"] is None and "—" in got["c"]
    assert robots("https://x").endswith("https://x/sitemap.xml\n")
    e = spark.createDataFrame([("a", 1, "set"), ("a", 2, "clear"), ("a", 3, "set"), ("b", 1, "clear"), ("b", 2, "resume"), ("b", 3, "set"), ("b", 4, "other"), ("c", 1, "set"), ("c", 2, "set")], "u string, n int, action string")
    assert sorted((r["u"], r["n"]) for r in last_read(e, ["u"], "n").collect()) == [("b", 3), ("c", 2)]

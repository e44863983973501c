import datetime
import itertools
import json
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.operators.drift import COVERED_BY, promote, schema_changes, unified
from lexiloom.operators.hierarchy import latest_state
from lexiloom.operators.nested import ROOT, flatten_nested


def test_flatten_keeps_places_and_shares_objects(spark):
    kind = "id string, object_id string, xs array<struct<n:int,tags:array<string>,deep:array<struct<k:string>>>>, ys array<string>"
    rows = [("a", "q", [(1, ["t", None, "t"], [("k",), None]), None, (1, ["t", None, "t"], [("k",), None])], []), (None, None, None, [None, "y"]), ("b", None, [(1, ["t", None, "t"], [("k",)])], None)]
    flat = flatten_nested(spark.createDataFrame(rows, kind), "id")
    bridge = [(r["root_key"], r["entity"], list(r["ordinals"])) for r in flat.bridge.collect()]
    assert sorted(x for x in bridge if x[0] == "a" and x[1] != ROOT) == sorted([("a", "xs", [0]), ("a", "xs", [2]), *[("a", "xs.tags", [i, j]) for i in (0, 2) for j in (0, 2)], ("a", "xs.deep", [0, 0]), ("a", "xs.deep", [2, 0])])
    assert (None, "ys", [1]) in bridge
    ids = {(r["root_key"], tuple(r["ordinals"])): r["object_id"] for r in flat.bridge.filter("entity = 'xs'").collect()}
    assert ids["a", (0,)] == ids["a", (2,)] != ids["b", (0,)]  # a null element makes a difference
    assert flat.objects.filter("entity = 'xs'").count() == 2 and flat.objects.filter("entity = 'xs.tags'").count() == 1
    assert {r["n"] for r in flat.table("xs").collect()} == {1}
    parents = {r["object_id"] for r in flat.bridge.filter("entity = 'xs'").collect()}
    assert {r["parent_id"] for r in flat.bridge.filter("entity = 'xs.tags'").collect()} == parents
    assert flatten_nested(spark.createDataFrame([], kind), "id").bridge.count() == 0
    assert [r["entity"] for r in flatten_nested(spark.createDataFrame([("a", 1)], "id string, n int"), "id").bridge.collect()] == [ROOT]


def test_latest_state_ties(spark):
    rows = spark.createDataFrame([("a", 2, 5), ("a", 3, 4), ("a", 3, 1), ("b", None, 7), (None, 1, 8), (None, 1, 9)], "id string, modifiedUtc int, row_no int")
    assert sorted(r["row_no"] for r in latest_state(rows).collect()) == [1, 7, 8, 9]


def files(spark, versions, feed="f"):
    rows = [(feed, s, i, json.dumps(x) if isinstance(x, dict) else x) for s, lines in versions.items() for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "feed string, file_seq int, line_no int, body string")


def changes(spark, versions):
    return sorted((r["file_seq"], r["change_kind"], r["old_field"], r["new_field"]) for r in schema_changes(files(spark, versions)).collect())


def test_added_removed_retyped_renamed(spark):
    links = [{"a": "p1", "weight": 0.5}, {"a": "p2", "weight": 2}]
    v = {
        1: [{"id": "x", "name": "N one", "links": links, "n": 3, "tags": []}, "", '{"id": "x", "na', {"id": "x", "name": "N one", "links": links, "n": 3}],
        2: [{"id": "x", "title": "N one", "Links": [{"a": "p1", "strength": "0.5"}, {"a": "p2", "strength": "2"}], "n": "3", "new": True}, {"id": "y", "title": "Z"}],
        3: [{"id": "x", "title": None, "Links": {"e0": {"a": "p1", "strength": "0.5"}}, "n": "3", "new": True, "tags": ["q"]}],
        4: [None, "{"],
    }
    assert changes(spark, v) == sorted([
        (2, "renamed", "name", "title"), (2, "renamed", "links", "Links"), (2, "renamed", "links.weight", "Links.strength"), (2, "retyped", "links.weight", "Links.strength"), (2, "retyped", "n", "n"), (2, "added", "", "new"), (2, "removed", "tags", ""),
        (3, "removed", "title", ""), (3, "retyped", "Links", "Links"), (3, "added", "", "tags"),
        *[(4, "removed", x, "") for x in ("id", "Links", "n", "new", "tags")]])


def test_no_files_and_one_file(spark):
    assert changes(spark, {}) == [] and changes(spark, {5: [{"id": "x"}]}) == []


def test_swapped_ends_are_told_apart_by_place(spark):
    a = [{"id": f"c{i}", "links": [{"from": "p0", "to": "p1"}, {"from": "p1", "to": "p0"}]} for i in range(4)]
    b = [{"id": f"c{i}", "links": [{"src": "p0", "dst": "p1"}, {"src": "p1", "dst": "p0"}]} for i in range(4)]
    assert changes(spark, {1: a, 2: b}) == [(2, "renamed", "links.from", "links.src"), (2, "renamed", "links.to", "links.dst")]


def test_lattice():
    assert promote(None, "number") == "number" and promote("number", "string") == "string" == promote("boolean", "number")
    assert promote("object", "list of objects") == "list of objects" == promote("number", "object") and promote("list of values", "object") == "json"
    kinds = [None, *COVERED_BY]
    for a, b, c in itertools.product(kinds, repeat=3):
        assert promote(a, a) == a and promote(a, b) == promote(b, a) and promote(promote(a, b), c) == promote(a, promote(b, c))


def test_union_table(spark):
    v = {1: [{"id": "x", "links": [{"a": "p", "Weight": 1}], "tags": "u, v", "feed": 1}], 2: [{"id": "x", "Links": {"e0": {"a": "p", "weight": "1"}}, "tags": ["w"], "feed": 2}, {"id": "x", "tags": ["z"]}]}
    f = files(spark, v)
    rows = {r["file_seq"]: r.asDict(True) for r in unified(f).collect()}
    name = "links" if "links" in rows[1] else "Links"
    assert rows[1]["tags"] == ["u", "v"] and rows[2]["tags"] == ["z"] and rows[2][name] is None and rows[1]["field_feed"] == 1.0
    assert [sorted(k.lower() for k in m) for m in rows[1][name]] == [["a", "weight"]]


def test_content_of_unified_has_no_duplicates(spark):
    f = files(spark, {1: [{"id": "x", "n": 1}, {"id": "x", "n": 1}, {"id": "y", "n": "2"}]})
    got = unified(f).select("id", F.col("n").cast("string").alias("n")).collect()
    assert sorted((r["id"], r["n"]) for r in got) == [("x", "1"), ("y", "2")]


def test_one_rename_joins_the_columns(spark):
    v = {
        1: [{"id": i, "about": f"text {i}", "links": [{"weight": f"w{i}"}], "odd": "o", "left": f"l {i}"} for i in "xy"],
        2: [{"id": i, "notes": f"text {i}", "links": [{"strength": f"w{i}"}], "right": f"l {i}"} for i in "xy"],
        3: [{"id": "z", "left": "a", "right": "b", "notes": "n"}],
    }
    f = files(spark, v)
    rows = unified(f).collect()
    assert {"about", "notes"} & set(rows[0].asDict()) == {"notes"} and {r["notes"] for r in rows if r["id"] in ("x", "y")} == {"text x", "text y"}
    assert len({tuple(m) for r in rows for one in r["links"] or [] for m in [one.keys()]}) == 1
    last = next(r for r in rows if r["file_seq"] == 3)
    assert (last["left"], last["right"]) == ("a", "b")  # in one record both: two fields


def test_rename_of_one_record_keeps_columns(spark):
    f = files(spark, {1: [{"id": "x", "a": "1"}], 2: [{"id": "x", "b": "1"}]})
    assert {"a", "b"} <= set(unified(f).columns)


def test_plain_objects_have_rows(spark):
    kind = "id string, meta struct<n:int,tags:array<string>,in:struct<k:string>>, xs array<struct<m:struct<t:array<int>>>>"
    rows = [("a", (1, ["t", None, "u"], ("v",)), [None, (([7],),), (None,)]), ("b", None, None)]
    flat = flatten_nested(spark.createDataFrame(rows, kind), "id")
    bridge = flat.bridge.filter("parent_id is not null").collect()
    assert sorted((r["root_key"], r["entity"], list(r["ordinals"])) for r in bridge) == sorted([
        ("a", "meta", []), ("a", "meta.tags", [0]), ("a", "meta.tags", [2]), ("a", "meta.in", []), ("a", "xs", [1]), ("a", "xs", [2]), ("a", "xs.m", [1]), ("a", "xs.m.t", [1, 0])])
    ids = {(r["entity"], tuple(r["ordinals"])): r for r in bridge}
    assert ids["meta.tags", (0,)]["parent_id"] == ids["meta.in", ()]["parent_id"] == ids["meta", ()]["object_id"]
    assert ids["xs.m.t", (1, 0)]["parent_id"] == ids["xs.m", (1,)]["object_id"]
    assert [r["n"] for r in flat.table("meta").collect()] == [1] and [r["k"] for r in flat.table("meta.in").collect()] == ["v"]


DEEP = "id string, n int, xs array<array<struct<a:double,b:array<string>>>>, m map<string,array<int>>, s struct<t:timestamp,u:struct<v:array<struct<w:boolean>>>>, e array<map<string,string>>"
DEEP_ROWS = [
    ("a", 1, [[(0.5, ["x", None]), None], None, []], {"k": [1, None], "j": None}, (datetime.datetime(2020, 1, 2, 3, 4, 5, 678901), ([(True,), (None,)],)), [{"p": "q"}, None, {}]),
    ("a", 1, [[(0.5, ["x", None]), None], None, []], {"j": None, "k": [1, None]}, None, None),
    (None, None, None, {}, (None, None), []),
    ("c", 2, [], None, (None, (None,)), [{"z": None, "y": "1"}]),
]


def rebuilt(bodies, kinds, entity, object_id):
    """The object from the distinct objects alone, as plain values without nulls."""
    out, view = {}, {k for k in kinds}
    for f, v in json.loads(bodies[entity, object_id]).items():
        name = f if entity == ROOT else f"{entity}.{f}"
        if name in view:
            v = [None if x is None else rebuilt(bodies, kinds, name, x) for x in v] if isinstance(v, list) else rebuilt(bodies, kinds, name, v)
        out[f] = v
    return out["value"] if entity != ROOT and set(out) == {"value"} and not isinstance(kinds[entity], T.StructType) else out


def plain(v, kind):
    """The same form of a value as it was read."""
    if isinstance(kind, T.MapType):
        return [{k: x for k, x in (("key", a), ("value", plain(b, kind.valueType))) if x is not None} for a, b in sorted(v.items())] if v is not None else None
    if isinstance(kind, T.ArrayType):
        inner = isinstance(kind.elementType, (T.ArrayType, T.MapType))
        return [None if x is None else {"items": plain(x, kind.elementType)} if inner else plain(x, kind.elementType) for x in v] if v is not None else None
    if isinstance(kind, T.StructType):
        return {f.name: plain(x, f.dataType) for f, x in zip(kind.fields, v) if x is not None} if v is not None else None
    return v.strftime("%Y-%m-%dT%H:%M:%S.%fZ") if isinstance(v, datetime.datetime) else v


def test_objects_rebuild_every_record(spark):
    rows = spark.createDataFrame(DEEP_ROWS, DEEP)
    flat = flatten_nested(rows, "id")
    bodies = {(r["entity"], r["object_id"]): r["body"] for r in flat.objects.collect()}
    bridge = flat.bridge.collect()
    known = {o for _, o in bodies}
    assert all(r["object_id"] in known and (r["parent_id"] in known or r["entity"] == ROOT) for r in bridge)
    roots = [r for r in bridge if r["entity"] == ROOT]
    assert all(r["parent_id"] is None and r["ordinals"] == [] for r in roots) and len(roots) == len(DEEP_ROWS)
    got = sorted((json.dumps(rebuilt(bodies, flat.kinds, ROOT, r["object_id"]), sort_keys=True) for r in roots))
    assert got == sorted(json.dumps(plain(tuple(r), rows.schema), sort_keys=True) for r in rows.collect())
    for name in flat.kinds:
        flat.table(name).collect()


def test_objects_rebuild_records_of_any_shape(spark):
    rng = random.Random(5)

    def value(kind):
        if rng.random() < 0.2:
            return None
        if isinstance(kind, T.StructType):
            return tuple(value(f.dataType) for f in kind.fields)
        if isinstance(kind, T.ArrayType):
            return [value(kind.elementType) for _ in range(rng.randrange(4))]
        if isinstance(kind, T.MapType):
            return {f"k{i}": value(kind.valueType) for i in range(rng.randrange(3))}
        return rng.choice(["", "a", 'q"\\', "禪", "\n"])

    kind = T._parse_datatype_string("id string, a array<struct<b:map<string,array<array<string>>>,c:struct<d:string,e:array<struct<f:string>>>>>, g map<string,struct<h:array<string>>>")
    rows = spark.createDataFrame([value(kind) or (None, None, None) for _ in range(60)], kind)
    flat = flatten_nested(rows, "id")
    bodies = {(r["entity"], r["object_id"]): r["body"] for r in flat.objects.collect()}
    got = sorted(json.dumps(rebuilt(bodies, flat.kinds, ROOT, r["object_id"]), sort_keys=True) for r in flat.bridge.filter(F.col("entity") == ROOT).collect())
    assert got == sorted(json.dumps(plain(tuple(r), rows.schema), sort_keys=True) for r in rows.collect())


def test_chain_of_competing_renames_is_matched_to_the_end(spark):
    # Every field's best partner prefers another: six rounds of mutual best pairs.
    n = 6
    shared = lambda i, j: [f"v{i}-{j}-{k}" for k in range(20 - 2 * i if i == j else 19 - 2 * max(i, j) if abs(i - j) == 1 else 0)]
    old = {"id": "x"} | {f"old{i}": [f"o{i}", *shared(i, i), *(shared(i, i - 1) if i else [])] for i in range(n)}
    new = {"id": "x"} | {f"new{i}": [f"n{i}", *shared(i, i), *(shared(i + 1, i) if i + 1 < n else [])] for i in range(n)}
    got = changes(spark, {1: [old], 2: [new]})
    assert [x for x in got if x[1] == "renamed"] == [(2, "renamed", f"old{i}", f"new{i}") for i in range(n)]


def test_a_file_of_several_types_has_the_least_that_holds_them(spark):
    assert changes(spark, {1: [{"id": "x", "n": 1}, {"id": "y", "n": "a"}, {"id": "z", "n": 2}], 2: [{"id": "x", "n": 1}], 3: [{"id": "x", "n": []}], 4: [{"id": "x", "n": ["q"]}]}) == [(2, "retyped", "n", "n")]


def test_rare_fields_share_a_map(spark):
    f = files(spark, {1: [{"id": "x", "a": 1, "b": "t"}, {"id": "y", "a": 2}], 2: [{"id": "x", "a": 3, "c": {"d": None}}]})
    rows = {(r["file_seq"], r["id"]): r for r in unified(f, columns=2).collect()}
    assert rows[1, "x"]["a"] == 1.0 and rows[1, "x"]["other_fields"] == {"b": '"t"'} and rows[2, "x"]["other_fields"] == {"c": '{"d":null}'} and rows[1, "y"]["other_fields"] == {}

"""Schemas that drift between the files of a feed.

The fields and types of every file are read in parallel, compared file by file, and
logged as ordered differences. Types are folded through a promotion lattice: within a
file, and over all files for the union schema, to which every line is cast. A field that
goes while another comes is a rename if, in the records both files hold, both have the
same content; values are read for such fields alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import materialise

#: Share of a record's values, of the side that has fewer, that must be equal under both names.
SAME_CONTENT = 0.5
#: Share that is enough where the names differ in case and underscores only.
SAME_CONTENT_ALIKE = 0.15
#: Records that must agree, over all files, for a rename to make two names one column.
AGREEING = 2

# Groups of types between which content can pass.
PASSES = (("string", "number"), ("string", "boolean"), ("string", "list of strings"), ("object", "list of objects"), ("list of strings", "list of objects"))

# The promotion lattice, each type with the types right above it.
COVERED_BY = {
    "boolean": ("string",),
    "number": ("string",),
    "string": ("list of strings",),
    "list of strings": ("list of objects",),
    "object": ("list of objects",),
    "list of objects": ("json",),
    "list of values": ("json",),
    "json": (),
}


def _upward(kind: str) -> set[str]:
    return {kind}.union(*map(_upward, COVERED_BY[kind]))


#: By type the set of the types it can be promoted to, itself included, a bit each. The least upper bound has the intersection.
ABOVE = {k: sum(1 << i for i, x in enumerate(COVERED_BY) if x in _upward(k)) for k in COVERED_BY}
#: What says nothing about the type can still become any.
BOTTOM = (1 << len(COVERED_BY)) - 1
_TYPE = {mask: k for k, mask in ABOVE.items()}


def promote(a: str | None, b: str | None) -> str | None:
    """Least upper bound of two types; None is the bottom, ``json`` the top."""
    return _TYPE.get(ABOVE.get(a, BOTTOM) & ABOVE.get(b, BOTTOM))


def _mask(kind: str) -> str:
    """SQL: the set of a type."""
    return f"CASE {kind} {' '.join(f"WHEN '{k}' THEN {m}" for k, m in ABOVE.items())} ELSE {BOTTOM} END"


def _folded(mask: Column) -> Column:
    """The type that has a set; null at the bottom."""
    return reduce(lambda w, kv: w.when(mask == kv[0], kv[1]), list(_TYPE.items())[1:], F.when(mask == list(_TYPE)[0], list(_TYPE.values())[0]))


def _kind(v: str, shape: str) -> str:
    """SQL: type of a variant value from its schema ``shape``, null for what says nothing."""
    return f"""CASE WHEN is_variant_null({v}) THEN NULL
        WHEN startswith({shape}, 'OBJECT') THEN 'object'
        WHEN startswith({shape}, 'ARRAY<OBJECT') THEN 'list of objects'
        WHEN {shape} = 'ARRAY<STRING>' THEN 'list of strings'
        WHEN {shape} = 'ARRAY<VOID>' THEN NULL
        WHEN startswith({shape}, 'ARRAY') THEN 'list of values'
        WHEN {shape} = 'STRING' THEN 'string'
        WHEN {shape} = 'BOOLEAN' THEN 'boolean' ELSE 'number' END"""


def _leaves(json: str) -> str:
    """SQL: the scalar values inside a JSON text, spelled alike whatever their type."""
    token = r'''"(?:[^"\\\\]|\\\\.)*"\\s*:?|-?\\d[\\d.eE+-]*|true|false'''
    bare = r'''regexp_replace(t, '^"|"$', '')'''
    flat = f"flatten(transform(filter(regexp_extract_all({json}, '{token}', 0), t -> NOT endswith(t, ':')), t -> split({bare}, ', ')))"
    return f"""array_distinct(transform({flat}, t -> CASE t WHEN 'true' THEN 'yes' WHEN 'false' THEN 'no' ELSE
        CASE WHEN t RLIKE '^[0-9]{{13}}$' THEN date_format(timestamp_millis(CAST(t AS BIGINT)), "yyyy-MM-dd'T'HH:mm:ss'Z'") ELSE t END END))"""


def read_lines(files: DataFrame) -> DataFrame:
    """feed, file_seq, line_no, doc (variant), id: the readable lines, those that are a JSON object."""
    doc = files.select("feed", "file_seq", "line_no", F.try_parse_json("body").alias("doc"))
    return doc.filter("schema_of_variant(doc) LIKE 'OBJECT%'").withColumn("id", F.expr("try_variant_get(doc, '$.id', 'string')"))


def file_schemas(lines: DataFrame) -> DataFrame:
    """feed, file_seq, scope, field, mask, kind: each file's fields, types folded through the lattice.

    ``scope`` is the list for fields of its objects, else ''. A field that only empty lists speak for has kind null.
    """
    spark = lines.sparkSession
    top = spark.sql(
        """SELECT feed, file_seq, '' AS scope, f.key AS field, f.value AS v, schema_of_variant(f.value) AS shape
           FROM {lines}, LATERAL variant_explode(doc) AS f WHERE NOT is_variant_null(f.value)""", lines=lines)
    inner = spark.sql(
        """SELECT feed, file_seq, field AS scope, f.key AS field, f.value AS v, schema_of_variant(f.value) AS shape
           FROM {top}, LATERAL variant_explode(v) AS o, LATERAL variant_explode(o.value) AS f WHERE startswith(shape, 'ARRAY<OBJECT') AND NOT is_variant_null(f.value)""", top=top)
    each = top.unionByName(inner).select("feed", "file_seq", "scope", "field", F.expr(_mask(_kind("v", "shape"))).alias("mask"))
    masks = each.groupBy("feed", "file_seq", "scope", "field").agg(F.bit_and("mask").alias("mask"))
    return masks.withColumn("kind", _folded(F.col("mask")))


def _values(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The values of wanted fields: the columns of ``wanted`` other than ``fields``, and line_no, id, pos, what (an entry of ``fields``), v.

    wanted: feed, file_seq, scope, fields (structs with ``field``), and others; a row for each scope of a file, or a few.
    """
    rows = lines.join(wanted, ["feed", "file_seq"])
    got = """explode(CASE WHEN scope = '' THEN array(struct(-1 AS pos, try_variant_get(doc, '$', 'map<string,variant>') AS m))
        ELSE transform(try_variant_get(try_variant_get(doc, '$', 'map<string,variant>')[scope], '$', 'array<variant>'), (o, i) -> struct(i AS pos, try_variant_get(o, '$', 'map<string,variant>') AS m)) END)"""
    keep = [c for c in wanted.columns if c != "fields"]
    rows = rows.select(*keep, "line_no", "id", "fields", F.expr(got).alias("o"))
    rows = rows.select(*keep, "line_no", "id", "o.pos", F.expr("explode(filter(transform(fields, f -> struct(f AS what, o.m[f.field] AS v)), x -> x.v IS NOT NULL AND NOT is_variant_null(x.v)))").alias("x"))
    return rows.select(*keep, "line_no", "id", "pos", "x.what", "x.v")


def _may_pass(a: Column, b: Column) -> Column:
    pairs = [(a == x) & (b == y) | (a == y) & (b == x) for x, y in PASSES]
    return a.isNull() | b.isNull() | (a == b) | reduce(lambda p, q: p | q, pairs)


def _bare(c: str) -> Column:
    return F.lower(F.regexp_replace(c, "[_-]", ""))


def _renames(compared: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs of a field gone and one come that hold the same content, each field in one at most, best pairs first.

    compared: feed, file_seq (of the later file), before (file_seq of the earlier), scope_old, scope_new, field, kind_old, kind_new, in_old, in_new.
    """
    step = ["feed", "file_seq", "before", "scope_old", "scope_new"]
    one = lambda when, kind: F.collect_list(F.when(when, F.struct("field", F.col(kind).alias("kind"))))
    open_ = compared.groupBy(*step).agg(one(F.col("in_new").isNull(), "kind_old").alias("gone"), one(F.col("in_old").isNull(), "kind_new").alias("come"))
    open_ = open_.filter((F.size("gone") > 0) & (F.size("come") > 0))
    side = lambda new, seq, scope, fields: open_.select("feed", F.col(seq).alias("file_seq"), F.col("file_seq").alias("at"), F.col("scope_old").alias("pair"), F.col(scope).alias("scope"), F.lit(new).alias("new"), F.col(fields).alias("fields"))
    wanted = side(False, "before", "scope_old", "gone").unionByName(side(True, "file_seq", "scope_new", "come"))
    record = ["feed", "at", "pair", "id", "pos"]
    rows = _values(lines, wanted).filter("id is not null").select(*record, "new", "what", "line_no", F.to_json("v").alias("json"))
    last = rows.repartition(*record).groupBy(*record, "new", "what").agg(F.max_by("json", "line_no").alias("json"))
    held = last.select(*record, "new", F.struct("what.field", "what.kind", F.expr(_leaves("json")).alias("leaves")).alias("x"))
    both = held.groupBy(*record).agg(F.collect_list(F.when(~F.col("new"), F.col("x"))).alias("old"), F.collect_list(F.when(F.col("new"), F.col("x"))).alias("come"))
    pair = """explode(flatten(transform(old, o -> transform(come, n -> struct(o.field AS old, n.field AS new, o.kind AS kind_old, n.kind AS kind_new,
        size(array_intersect(o.leaves, n.leaves)) AS common, least(size(o.leaves), size(n.leaves)) AS least)))))"""
    each = both.select("feed", "at", "pair", F.expr(pair).alias("p")).select("feed", "at", "pair", "p.*")
    same = each.groupBy("feed", "at", "pair", "old", "new", "kind_old", "kind_new").agg(
        (F.sum("common") / F.greatest(F.sum("least"), F.lit(1))).alias("same"), F.count(F.lit(1)).alias("records"), F.count_if(F.col("common") > 0).alias("agreeing"))
    same = same.withColumn("alike", _bare("old") == _bare("new"))
    same = same.filter(_may_pass(F.col("kind_old"), F.col("kind_new")) & ((F.col("same") >= SAME_CONTENT) | F.col("alike") & (F.col("same") >= SAME_CONTENT_ALIKE)))
    # A step's pairs with content in common, in order: a pair is taken if neither field is in one taken before.
    order = F.struct((~F.col("alike")).alias("a"), (-F.col("same")).alias("b"), (-F.col("records")).alias("c"), F.levenshtein("old", "new").alias("d"), "old", "new", "kind_old", "kind_new", "agreeing")
    ranked = same.groupBy("feed", "at", "pair").agg(F.array_sort(F.collect_list(order)).alias("pairs"))
    taken = """explode(aggregate(pairs, filter(pairs, p -> false), (t, p) -> IF(exists(t, q -> q.old = p.old OR q.new = p.new), t, concat(t, array(p)))))"""
    found = ranked.select("feed", F.col("at").alias("file_seq"), F.col("pair").alias("scope_old"), F.expr(taken).alias("p"))
    return found.select("feed", "file_seq", "scope_old", "p.old", "p.new", "p.kind_old", "p.kind_new", "p.agreeing")


def schema_changes(files: DataFrame, lines: DataFrame | None = None, schemas: DataFrame | None = None) -> DataFrame:
    """feed, file_seq, change_kind, old_field, new_field, agreeing: every change of a file against the file before it in its feed.

    files: feed, file_seq, line_no, body. Unreadable and empty lines give no field; a file
    without readable lines has no fields. A file's type of a field is the least to which the
    types of its lines can be promoted. Repeated lines count once for content (the last
    of a record's lines counts). Fields of objects in a list are written ``list.field``.
    ``agreeing``, of renames only, is in how many records, or objects of a list, the two have
    content in common. An empty table gives no changes. ``lines`` and ``schemas`` are those
    of ``read_lines`` and ``file_schemas`` where they are at hand.
    """
    lines = materialise(read_lines(files), "lines") if lines is None else lines
    schemas = materialise(file_schemas(lines), "schemas") if schemas is None else schemas
    every = files.select("feed", "file_seq").distinct()
    steps = every.withColumn("before", F.lag("file_seq").over(Window.partitionBy("feed").orderBy("file_seq"))).filter("before is not null")
    steps = materialise(steps, "steps")

    def compared(scopes: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
        """scopes: feed, file_seq, before, scope_old, scope_new. Returns all fields of both sides, and the renames."""
        on = ["feed", "file_seq", "before", "scope_old", "scope_new"]
        half = lambda seq, scope, mine, other: scopes.join(
            schemas.select("feed", F.col("file_seq").alias(seq), F.col("scope").alias(scope), "field", F.col("kind").alias(f"kind_{mine}"), F.lit(None).cast("string").alias(f"kind_{other}"), F.lit(1).alias(f"in_{mine}"), F.lit(None).cast("int").alias(f"in_{other}")),
            ["feed", seq, scope])
        rows = half("before", "scope_old", "old", "new").unionByName(half("file_seq", "scope_new", "new", "old"))
        both = materialise(rows.groupBy(*on, "field").agg(*[F.max(c).alias(c) for c in ("kind_old", "kind_new", "in_old", "in_new")]), tag)
        return both, materialise(_renames(both, lines), tag + "-renames")

    def report(both: DataFrame, renamed: DataFrame) -> DataFrame:
        k = ["feed", "file_seq", "scope_old"]
        dealt = renamed.select(*k, F.explode(F.array(F.struct(F.lit(True).alias("gone"), F.col("old").alias("field")), F.struct(F.lit(False).alias("gone"), F.col("new").alias("field")))).alias("x"), F.lit(True).alias("dealt")).select(*k, "x.*", "dealt")
        rows = both.withColumn("gone", F.when(F.col("in_new").isNull(), True).when(F.col("in_old").isNull(), False))
        rows = rows.join(dealt, [*k, "gone", "field"], "left").filter("dealt is null")
        renamed = renamed.join(both.select(*k, "scope_new").distinct(), k)
        name = lambda scope, c: F.when(F.col(scope) == "", F.col(c)).otherwise(F.concat_ws(".", scope, c))
        change = lambda kind, old, new, agreeing=F.lit(None).cast("long"): F.struct(F.lit(kind).alias("change_kind"), old.alias("old_field"), new.alias("new_field"), agreeing.alias("agreeing"))
        old, new = name("scope_old", "field"), name("scope_new", "field")
        one = F.when(F.col("gone"), change("removed", old, F.lit(""))).when(~F.col("gone"), change("added", F.lit(""), new)).when(F.col("kind_old") != F.col("kind_new"), change("retyped", old, new))
        plain = rows.select("feed", "file_seq", one.alias("c")).filter("c is not null")
        old, new = name("scope_old", "old"), name("scope_new", "new")
        two = F.explode(F.filter(F.array(change("renamed", old, new, F.col("agreeing")), F.when(F.col("kind_old") != F.col("kind_new"), change("retyped", old, new))), lambda c: c.isNotNull()))
        return plain.unionByName(renamed.select("feed", "file_seq", two.alias("c"))).select("feed", "file_seq", "c.*")

    top, top_renames = compared(steps.withColumn("scope_old", F.lit("")).withColumn("scope_new", F.lit("")), "top")
    lists = top.filter("in_old = 1 AND in_new = 1").select("feed", "file_seq", F.col("field").alias("old"), F.col("field").alias("new"), "kind_old", "kind_new")
    lists = lists.unionByName(top_renames.select(*lists.columns)).filter("kind_old = 'list of objects' AND kind_new = 'list of objects'")
    scopes = lists.select("feed", "file_seq", F.col("old").alias("scope_old"), F.col("new").alias("scope_new")).join(steps, ["feed", "file_seq"])
    return report(top, top_renames).unionByName(report(*compared(scopes, "inner")))


#: Fields that get a column of their own; the others share one column, a map.
COLUMNS = 1_000


def field_families(schemas: DataFrame, lines: DataFrame, changes: DataFrame) -> DataFrame:
    """scope, field, family: names of the same field under one name, the most frequent of them.

    Two names belong together if they differ in case and underscores only, or if renames
    between them, be it in one file, were found by at least AGREEING records that agree, and
    no record, or object of a list, has both. ``scope`` is the family of the list, '' at the
    top. The table has a row a name, however many files there are. Arguments: as of
    file_schemas, read_lines and schema_changes.
    """
    by_file = schemas.select("feed", "file_seq", "scope", "field")
    names = materialise(by_file.groupBy("scope", "field").agg(F.count(F.lit(1)).alias("files")), "names")
    pair = changes.filter("change_kind = 'renamed'").groupBy("old_field", "new_field").agg(F.sum("agreeing").alias("agreeing"))
    cut = lambda c, part: F.when(F.contains(c, F.lit(".")), F.substring_index(c, ".", part)).otherwise(F.lit("") if part == 1 else c)
    pair = materialise(pair.select(cut(F.col("old_field"), 1).alias("scope"), cut(F.col("old_field"), -1).alias("a"), cut(F.col("new_field"), -1).alias("b"), "agreeing"), "pairs")

    def supported(links: DataFrame, lists: DataFrame) -> DataFrame:
        """links: scope, a, b, agreeing; lists: scope, list (the names of a list, and its family). Returns the scope, a, b that hold."""
        links = links.select("scope", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "agreeing")
        links = links.groupBy("scope", "a", "b").agg(F.sum("agreeing").alias("agreeing")).filter(F.col("agreeing") >= AGREEING).drop("agreeing")
        near = by_file.join(lists, "scope").select("feed", "file_seq", F.col("scope").alias("list"), F.col("list").alias("scope"), "field")
        both = near.join(links.withColumn("field", F.explode(F.array("a", "b"))), ["scope", "field"]).groupBy("scope", "feed", "file_seq", "list", "a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
        wanted = both.select("feed", "file_seq", F.col("scope").alias("family"), F.col("list").alias("scope"), "a", "b", F.array(F.struct(F.col("a").alias("field")), F.struct(F.col("b").alias("field"))).alias("fields"))
        seen = _values(lines, wanted).groupBy("feed", "file_seq", "scope", "family", "a", "b", "line_no", "pos").agg(F.count_distinct("what").alias("n")).filter("n = 2")
        return materialise(links.join(seen.select(F.col("family").alias("scope"), "a", "b").distinct(), ["scope", "a", "b"], "left_anti"), "links")

    def families(names: DataFrame, links: DataFrame) -> DataFrame:
        """names: scope, field, files; links: scope, a, b. Least-label propagation over the names."""
        both = links.unionByName(links.select("scope", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        rows = materialise(names.withColumn("label", _bare("field")), "labels")
        while True:
            near = both.join(rows.select("scope", F.col("field").alias("b"), F.col("label").alias("other")), ["scope", "b"]).groupBy("scope", F.col("a").alias("field")).agg(F.min("other").alias("other"))
            step = rows.join(near, ["scope", "field"], "left").withColumn("least", F.least("label", F.coalesce("other", "label")))
            group = step.groupBy("scope", "label").agg(F.min("least").alias("least"))
            after = materialise(rows.join(group, ["scope", "label"]).select("scope", "field", "files", F.col("least").alias("label")), "labels")
            changed = after.join(rows.select("scope", "field", F.col("label").alias("was")), ["scope", "field"]).filter("label <> was").limit(1).count()
            rows = after
            if not changed:
                break
        best = rows.groupBy("scope", "label").agg(F.max_by("field", F.struct("files", "field")).alias("family"))
        return rows.join(best, ["scope", "label"]).select("scope", "field", "family")

    root = names.filter("scope = ''").select("scope", F.col("scope").alias("list")).distinct()
    top = materialise(families(names.filter("scope = ''"), supported(pair.filter("scope = ''"), root)), "top-families")
    lists = top.select(F.col("field").alias("scope"), F.col("family").alias("list"))
    inner = names.filter("scope <> ''").join(lists, "scope").groupBy(F.col("list").alias("scope"), "field").agg(F.sum("files").alias("files"))
    links = pair.filter("scope <> ''").join(lists, "scope").select(F.col("list").alias("scope"), "a", "b", "agreeing")
    return top.unionByName(families(inner, supported(links, lists)))


def unified(files: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """One table of all readable lines under the union schema: feed, file_seq, line_no, and a column a family of fields.

    Each column has the least type to which the lattice promotes all its files' types; values
    of another type are cast: numbers to strings, comma-separated strings to lists, keyed
    objects and lists of names to lists of objects, whose members have their family's names. A
    record that a file holds twice is taken once, the last line. Columns of the key that
    clash with a field's name keep the name, the field's gets ``field_`` before it. Where there are more than
    ``columns`` families the most frequent have a column each; all others are in the map ``other_fields``, by name, as JSON.
    """
    lines = materialise(read_lines(files), "lines")
    schemas = materialise(file_schemas(lines), "schemas")
    families = materialise(field_families(schemas, lines, materialise(schema_changes(files, lines, schemas), "changes")), "families")
    once = Window.partitionBy("feed", "file_seq", F.coalesce("id", F.concat(F.lit("#"), "line_no"))).orderBy(F.col("line_no").desc())
    lines = lines.withColumn("_r", F.row_number().over(once)).filter("_r = 1").drop("_r")
    top = schemas.filter("scope = ''").groupBy("field").agg(F.bit_and("mask").alias("mask"), F.count(F.lit(1)).alias("files")).join(families.filter("scope = ''"), "field")
    each = top.groupBy("family").agg(F.collect_list("field").alias("fields"), F.bit_and("mask").alias("mask"), F.sum("files").alias("files"))
    rows = each.withColumn("kind", _folded(F.col("mask"))).orderBy(F.col("files").desc(), "family").limit(columns + 1).collect()
    more, rows = len(rows) > columns, sorted(rows[:columns], key=lambda r: r["family"])
    renamed = families.filter("scope <> '' AND field <> family").join(F.broadcast(files.sparkSession.createDataFrame([(r["family"],) for r in rows], "scope string")), "scope")
    members = {r["scope"]: r["m"] for r in renamed.groupBy("scope").agg(F.map_from_entries(F.collect_list(F.struct("field", "family"))).alias("m")).collect()}
    named = {r["scope"]: r["family"] for r in families.filter("lower(field) = 'name'").groupBy("scope").agg(F.min("family").alias("family")).collect() if r["scope"]}
    own = []
    for r in rows:
        name = r["family"] if r["family"] not in ("feed", "file_seq", "line_no", "other_fields") else f"field_{r['family']}"
        values = [F.when(~F.isnull(v), v) for v in (_field(f) for f in sorted(r["fields"], key=lambda f: (f != r["family"], f)))]
        own.append(_cast(F.coalesce(*values), r["kind"] or "string", members.get(r["family"], {}), named.get(r["family"], "name")).alias(name))
    if more:
        placed = F.array(*[F.lit(f) for r in rows for f in r["fields"]])
        every = F.map_from_entries(F.transform(F.map_entries(F.try_variant_get("doc", "$", "map<string,variant>")), lambda e: F.struct(e["key"], F.to_json(e["value"]))))
        own.append(F.map_filter(every, lambda k, v: ~F.array_contains(placed, k) & (v != "null")).alias("other_fields"))
    return lines.select("feed", "file_seq", "line_no", *own)


def _field(name: str) -> Column:
    path = '$["' + name.replace("\\", "\\\\").replace('"', '\\"') + '"]' if not name.isidentifier() else "$." + name
    v = F.try_variant_get("doc", path, "variant")
    return F.when(~F.is_variant_null(v), v)


def _cast(v: Column, kind: str, members: dict[str, str], named_by: str) -> Column:
    json = F.to_json(v)
    text = F.coalesce(F.try_variant_get(v, "$", "string"), json)
    has = F.schema_of_variant(v)
    if kind == "number":
        return text.try_cast("double")
    if kind == "boolean":
        return text.try_cast("boolean")
    if kind == "list of strings":
        return F.when(has.startswith("ARRAY"), F.from_json(json, "array<string>")).when(v.isNotNull(), F.split(text, ", "))
    if kind in ("list of objects", "object"):
        one = F.transform(F.from_json(json, "array<string>"), lambda x: F.from_json(x, "map<string,string>"))
        keyed = F.map_values(F.from_json(json, "map<string,map<string,string>>"))
        names = F.when(has.startswith("ARRAY"), F.from_json(json, "array<string>")).otherwise(F.split(text, ", "))
        named = F.transform(names, lambda x: F.create_map(F.lit(named_by), x))
        rows = F.when(has.startswith("ARRAY<OBJECT") | (has == "ARRAY<VOID>"), one).when(has.startswith("OBJECT"), keyed).when(v.isNotNull(), named)
        if not members:
            return rows
        to = F.create_map(*[F.lit(x) for kv in sorted(members.items()) for x in kv])
        return F.transform(rows, lambda m: F.map_from_entries(F.transform(
            F.array_sort(F.map_entries(F.map_filter(m, lambda k, x: (F.coalesce(to[k], k) == k) | ~F.map_contains_key(m, F.coalesce(to[k], k))))),
            lambda e: F.struct(F.coalesce(to[e["key"]], e["key"]).alias("key"), e["value"].alias("value")))))
    return text

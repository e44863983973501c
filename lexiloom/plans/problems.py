"""Registered queries of the general problems (hierarchies, nesting, drift)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.drift import ABOVE, BOTTOM, PASSES, SAME_CONTENT, SAME_CONTENT_ALIKE, file_schemas, read_lines, schema_changes, unified
from lexiloom.operators.hierarchy import bare_key, collection_links, conflicts, forest, labelled_pairs, latest_state, person_links, person_statements, tree_of
from lexiloom.operators.nested import ROOT, flatten_nested
from lexiloom.session import table

#: Entity names of the result, by path.
ENTITIES = {
    "passages": "passage",
    "passages.tags": "passage_tag",
    "passages.masterNames": "passage_master",
    "passages.linkedTexts": "linked_text",
    "passages.apparatus": "passage_app",
    "passages.apparatus.readings": "passage_reading",
    "concepts": "concept",
    "concepts.tags": "concept_tag",
    "links": "link",
    "ExtraMasters": "extra_master",
}


def _trees(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"masters": person_links(table(spark, d, "masters")), "collections": collection_links(table(spark, d, "collections"))}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return labelled_pairs(_trees(spark, d))


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every node's path, depth, root, number of descendants and ring."""
    rows = forest(_trees(spark, d)).summary()
    path = F.array_join(F.transform("path", bare_key), " > ").alias("path")
    return rows.select(tree_of("key").alias("tree"), bare_key("key").alias("key"), path, "depth", bare_key("root").alias("root"), "n_descendants", bare_key("ring_id").alias("ring_id"))


def p1_statements(spark: SparkSession, d: str) -> DataFrame:
    """By person the statements of a teacher, the different teachers named, the one followed, and the number of those not followed."""
    said = person_statements(table(spark, d, "masters"))
    lost = conflicts(said).groupBy("key").agg(F.count(F.lit(1)).alias("not_followed"))
    each = said.groupBy("key").agg(F.count(F.lit(1)).alias("statements"), F.count_distinct("parent").alias("teachers"), F.min("parent").alias("kept"))
    return each.join(lost, "key", "left").fillna(0, ["not_followed"])


def _places() -> list[Column]:
    return [F.coalesce(F.get("ordinals", F.lit(k)), F.lit(-1)).alias(f"i{k}") for k in range(3)]


def _nested(spark: SparkSession, d: str):
    rows = latest_state(table(spark, d, "collections"))
    return flatten_nested(rows.select("id", "passages", "concepts", "links", "ExtraMasters"), "id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv]), F.col("entity"))
    return _nested(spark, d).bridge.filter(F.col("entity") != ROOT).select(name.alias("entity"), F.col("root_key").alias("collection_id"), *_places())


def p4_objects(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct object once, by Merkle identity, the collections themselves included."""
    return _nested(spark, d).objects


def p4_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of an object: where it lies, its parent's identity and its own."""
    return _nested(spark, d).bridge.select("root_key", "entity", *_places(), "parent_id", "object_id")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of each entity, and distinct objects among them by Merkle identity."""
    bridge = _nested(spark, d).bridge.filter(F.col("entity") != ROOT)
    return bridge.groupBy("entity").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("object_id").alias("objects"))


def p4_tables(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables of all entities in one: typed columns, named by entity and field, of an entity's rows; null in the others'."""
    flat = _nested(spark, d)
    keys = ["root_key", "ordinals", "parent_id", "object_id"]
    parts = []
    for name in sorted(flat.kinds):
        rows = flat.table(name)
        own = [F.col(f"`{c}`").alias(f"{name}.{c}".replace(".", "_").strip("()")) for c in rows.columns if c not in keys]
        parts.append(rows.select(F.lit(name).alias("entity"), "root_key", *_places(), "parent_id", "object_id", *own))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_changes(table(spark, d, "collection_files")).drop("agreeing")


def p5_schemas(spark: SparkSession, d: str) -> DataFrame:
    """Every file's fields, at the top and in lists, with the type that its lines' types fold to."""
    return file_schemas(read_lines(table(spark, d, "collection_files"))).drop("mask")


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    """All readable records of all exports in one table."""
    return unified(table(spark, d, "collection_files"))


QUERIES = {"p4_counts": p4_counts, "p5_table": p5_table, "p5_schemas": p5_schemas, "p1_found": p1_found, "p1_paths": p1_paths, "p1_statements": p1_statements, "p4_found": p4_found, "p4_objects": p4_objects, "p4_bridge": p4_bridge, "p4_tables": p4_tables, "p5_found": p5_found}

_NAME = "lower(trim(translate({}, '_-', '  ')))"

_TREES = f"""
WITH RECURSIVE rows AS (SELECT {_NAME.format('names[1]')} AS k, * FROM masters WHERE names[1] IS NOT NULL),
person AS (SELECT k, arg_min(names[1], row_no) AS label FROM rows GROUP BY k),
alias AS (SELECT {_NAME.format('n')} AS a, min(k) AS k FROM (SELECT k, unnest(names) AS n FROM rows) GROUP BY 1),
said AS (SELECT r.k AS c, a.k AS p FROM rows r JOIN alias a ON {_NAME.format('r.teacher')} = a.a
  UNION SELECT a.k, s.k FROM (SELECT k, unnest(students) AS n FROM rows) s JOIN alias a ON {_NAME.format('s.n')} = a.a),
col AS (SELECT id, lower(trim(id)) AS k, lower(trim(parentCollectionId)) AS p FROM collections WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY modifiedUtc DESC NULLS LAST, row_no) = 1),
edge AS (SELECT 'masters' AS tree, c, min(p) AS p FROM said GROUP BY c
  UNION ALL SELECT 'collections', k, p FROM col WHERE p IN (SELECT k FROM col)),
up AS (SELECT tree, c, p FROM edge UNION SELECT u.tree, u.c, e.p FROM up u JOIN edge e ON u.tree = e.tree AND u.p = e.c),
label AS (SELECT 'masters' AS tree, k, label FROM person UNION ALL SELECT 'collections', k, id FROM col)"""

# The nested columns of collections; None is a scalar, a list holds the form of its elements.
_APP = {"lem": None, "readings": [{"wit": None, "text": None}]}
_PASSAGE = {k: None for k in ("id", "sourceRelPath", "zhText", "enText", "fromLb", "toLb", "summary", "importance", "annotationType")} | {
    "tags": [None], "masterNames": [None], "linkedTexts": [{"relPath": None, "note": None}], "apparatus": [_APP]}
_CONCEPT = {"id": None, "name": None, "description": None, "status": None, "tags": [None]}
_LINK = {k: None for k in ("fromPassageId", "toPassageId", "relationType", "weight", "colorHex")}
_SHAPE = {"id": None, "passages": [_PASSAGE], "concepts": [_CONCEPT], "links": [_LINK], "ExtraMasters": [None]}


def _body(shape: dict | None, x: str, depth: int = 0) -> str:
    """SQL: the canonical JSON of ``x``, lists as lists of their elements' hashes."""
    if shape is None:
        return f"""('{{"value":' || to_json({x})::VARCHAR || '}}')"""
    parts = []
    for f in sorted(shape):
        v, z = f'{x}."{f}"', f"z{depth}"
        if shape[f] is None:
            parts.append(f"""CASE WHEN {v} IS NOT NULL THEN '"{f}":' || to_json({v})::VARCHAR END""")
        else:
            ids = f"""list_transform({v}, lambda {z}: CASE WHEN {z} IS NULL THEN 'null' ELSE '"' || sha256({_body(shape[f][0], z, depth + 1)}) || '"' END)"""
            parts.append(f"""CASE WHEN {v} IS NOT NULL THEN '"{f}":[' || coalesce(array_to_string({ids}, ','), '') || ']' END""")
    return f"('{{' || coalesce(array_to_string([{', '.join(parts)}], ','), '') || '}}')"


def _occurrences() -> tuple[str, dict[str, tuple[str, dict | None]]]:
    """SQL of one CTE an entity (root_key, pos, parent_id, x, body, object_id), and each entity's CTE and form."""
    fields = ", ".join(f'"{f}" := "{f}"' for f in _SHAPE)
    ctes = [f"""c AS (SELECT id AS root_key, []::INT[] AS pos, NULL::VARCHAR AS parent_id, struct_pack({fields}) AS x FROM collections QUALIFY id IS NULL OR row_number() OVER (PARTITION BY id ORDER BY modifiedUtc DESC NULLS LAST, row_no) = 1)""",
            f"""e0 AS (SELECT *, sha256(body) AS object_id FROM (SELECT *, {_body(_SHAPE, 'x')} AS body FROM c))"""]
    known: dict[str, tuple[str, dict | None]] = {ROOT: ("e0", _SHAPE)}

    def below(name: str, cte: str, shape: dict) -> None:
        for f, inner in shape.items():
            if inner is not None:
                own, path = f"e{len(known)}", f if name == ROOT else f"{name}.{f}"
                known[path] = (own, inner[0])
                ctes.append(f"""{own} AS (SELECT *, sha256(body) AS object_id FROM (SELECT root_key, pos, parent_id, x, {_body(inner[0], 'x')} AS body FROM (
  SELECT root_key, list_append(pos, i - 1) AS pos, parent_id, x FROM (SELECT root_key, pos, object_id AS parent_id, unnest(x."{f}") AS x, unnest(range(1, len(x."{f}") + 1)) AS i FROM {cte})) WHERE x IS NOT NULL))""")
                if inner[0] is not None:
                    below(path, own, inner[0])

    below(ROOT, "e0", _SHAPE)
    return "WITH " + ",\n".join(ctes), known


def _nested_sql() -> dict[str, str]:
    ctes, known = _occurrences()
    places = ", ".join(f"coalesce(pos[{k + 1}], -1)::INT AS i{k}" for k in range(3))
    columns = {name: [(f"{name}_{f}".replace(".", "_").strip("()"), f'x."{f}"') for f in shape if shape[f] is None] if shape else [(f"{name}_value".replace(".", "_"), "x")] for name, (_, shape) in known.items()}
    typed = []
    for name, (cte, _) in known.items():
        own = ", ".join(f'{v} AS "{c}"' for c, v in columns[name])
        typed.append(f"SELECT '{name}' AS entity, root_key, {places}, parent_id, object_id{', ' + own if own else ''} FROM {cte}")
    return {
        "p4_objects": ctes + "\nSELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS entity, object_id, body FROM {cte}" for name, (cte, _) in known.items()) + ")",
        "p4_bridge": ctes + "\n" + " UNION ALL ".join(f"SELECT root_key, '{name}' AS entity, {places}, parent_id, object_id FROM {cte}" for name, (cte, _) in known.items()),
        "p4_tables": ctes + "\n" + " UNION ALL BY NAME ".join(typed),
    }


_BITS = " ".join(f"WHEN '{k}' THEN {m}" for k, m in ABOVE.items())
_TYPES = " ".join(f"WHEN {m} THEN '{k}'" for k, m in ABOVE.items())
_KIND = """CASE json_type({0}) WHEN 'OBJECT' THEN 'object' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN
  CASE list_sort(list_distinct([json_type(e) FOR e IN json_extract({0}, '$[*]') IF json_type(e) <> 'NULL'])) WHEN [] THEN NULL WHEN ['OBJECT'] THEN 'list of objects' WHEN ['VARCHAR'] THEN 'list of strings' ELSE 'list of values' END ELSE 'number' END"""

_VALUES = f"""l AS (SELECT feed, file_seq, line_no, CASE WHEN json_valid(body) THEN body END AS b FROM collection_files),
t AS (SELECT feed, file_seq, line_no, b->>'$.id' AS id, k AS field, json_extract(b, '$."' || k || '"') AS v FROM (SELECT feed, file_seq, line_no, b, unnest(json_keys(b)) AS k FROM l WHERE json_type(b) = 'OBJECT')),
top AS (SELECT feed, file_seq, line_no, id, field, v, {_KIND.format('v')} AS kind FROM t WHERE json_type(v) <> 'NULL'),
o AS (SELECT feed, file_seq, line_no, id, field AS scope, unnest(json_extract(v, '$[*]')) AS e, unnest(range(len(json_extract(v, '$[*]')))) AS pos FROM top WHERE kind = 'list of objects'),
i AS (SELECT feed, file_seq, line_no, id, scope, pos, k AS field, json_extract(e, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(e)) AS k FROM o WHERE json_type(e) = 'OBJECT')),
vals AS (SELECT feed, file_seq, line_no, id, '' AS scope, -1 AS pos, field, v, kind FROM top UNION ALL SELECT feed, file_seq, line_no, id, scope, pos, field, v, {_KIND.format('v')} FROM i WHERE json_type(v) <> 'NULL'),
m AS (SELECT feed, file_seq, scope, field, CASE bit_and(CASE kind {_BITS} ELSE {BOTTOM} END) {_TYPES} END AS kind FROM vals GROUP BY feed, file_seq, scope, field)"""
_LEAF = """list_distinct(list_transform(flatten(list_transform(list_filter(regexp_extract_all({0}::VARCHAR, '"(?:[^"\\\\]|\\\\.)*"\\s*:?|-?\\d[\\d.eE+-]*|true|false'), lambda x: NOT ends_with(x, ':')), lambda x: string_split(regexp_replace(x, '^"|"$', '', 'g'), ', '))),
  lambda y: CASE WHEN y = 'true' THEN 'yes' WHEN y = 'false' THEN 'no' WHEN regexp_full_match(y, '[0-9]{{13}}') THEN strftime(make_timestamp(CASE WHEN regexp_full_match(y, '[0-9]{{13}}') THEN y::BIGINT ELSE 0 END * 1000), '%Y-%m-%dT%H:%M:%SZ') ELSE y END))"""


def _compared(p: str, scopes: str) -> str:
    """SQL: CTEs of the fields of both sides (b) and the renames (q) of steps with scopes so and sn; best pairs of three rounds."""
    order = "alike DESC, same DESC, records DESC, levenshtein(old, new), old, new"
    best = lambda r: f"SELECT * FROM {r} QUALIFY row_number() OVER (PARTITION BY feed, file_seq, so, old ORDER BY {order}) = 1 AND row_number() OVER (PARTITION BY feed, file_seq, so, new ORDER BY {order}) = 1"
    left = lambda r, q: f"SELECT * FROM {r} WHERE (feed, file_seq, so, old) NOT IN (SELECT feed, file_seq, so, old FROM {q}) AND (feed, file_seq, so, new) NOT IN (SELECT feed, file_seq, so, new FROM {q})"
    side = lambda mine, seq, scope, other: f"""SELECT b.feed, b.file_seq, b.so, v.id, v.pos, b.field, b.{mine} AS kind, arg_max({_LEAF.format('v.v')}, v.line_no) AS x FROM {p}b b
  JOIN vals v ON v.feed = b.feed AND v.file_seq = b.{seq} AND v.scope = b.{scope} AND v.field = b.field WHERE b.{other} IS NULL AND v.id IS NOT NULL GROUP BY ALL"""  # noqa: E731
    bare = "lower(regexp_replace({0}, '[_-]', '', 'g'))"
    pairs = " OR ".join(f"(ko = '{x}' AND kn = '{y}') OR (ko = '{y}' AND kn = '{x}')" for x, y in PASSES)
    return f"""{p}b AS (SELECT feed, file_seq, before, so, sn, field, max(ko) AS ko, max(kn) AS kn, max(io) AS io, max(inn) AS inn FROM (
  SELECT s.feed, s.file_seq, before, so, sn, field, kind AS ko, NULL AS kn, 1 AS io, NULL AS inn FROM {scopes} s JOIN m ON m.feed = s.feed AND m.file_seq = before AND scope = so
  UNION ALL SELECT s.feed, s.file_seq, before, so, sn, field, NULL, kind, NULL, 1 FROM {scopes} s JOIN m ON m.feed = s.feed AND m.file_seq = s.file_seq AND scope = sn) GROUP BY ALL),
{p}o AS ({side('ko', 'before', 'so', 'inn')}), {p}n AS ({side('kn', 'file_seq', 'sn', 'io')}),
{p}r AS (SELECT feed, file_seq, so, o.field AS old, n.field AS new, o.kind AS ko, n.kind AS kn, sum(len(list_intersect(o.x, n.x))) / greatest(sum(least(len(o.x), len(n.x))), 1) AS same, count(*) AS records, {bare.format('o.field')} = {bare.format('n.field')} AS alike
  FROM {p}o o JOIN {p}n n USING (feed, file_seq, so, id, pos) GROUP BY ALL HAVING (ko IS NULL OR kn IS NULL OR ko = kn OR {pairs}) AND (same >= {SAME_CONTENT} OR alike AND same >= {SAME_CONTENT_ALIKE})),
{p}q1 AS ({best(p + 'r')}), {p}r2 AS ({left(p + 'r', p + 'q1')}), {p}q2 AS ({best(p + 'r2')}), {p}r3 AS ({left(p + 'r2', p + 'q2')}), {p}q3 AS ({best(p + 'r3')}),
{p}q AS (SELECT * FROM {p}q1 UNION ALL SELECT * FROM {p}q2 UNION ALL SELECT * FROM {p}q3)"""


def _reported(p: str) -> str:
    name = lambda scope, f: f"CASE WHEN {scope} = '' THEN {f} ELSE {scope} || '.' || {f} END"
    free = lambda f: f"(feed, file_seq, so, field) NOT IN (SELECT feed, file_seq, so, {f} FROM {p}q)"
    return f"""SELECT feed, file_seq, 'removed' AS change_kind, {name('so', 'field')} AS old_field, '' AS new_field FROM {p}b WHERE inn IS NULL AND {free('old')}
UNION ALL SELECT feed, file_seq, 'added', '', {name('sn', 'field')} FROM {p}b WHERE io IS NULL AND {free('new')}
UNION ALL SELECT feed, file_seq, 'retyped', {name('so', 'field')}, {name('sn', 'field')} FROM {p}b WHERE io = 1 AND inn = 1 AND ko <> kn
UNION ALL SELECT q.feed, q.file_seq, unnest(CASE WHEN q.ko <> q.kn THEN ['renamed', 'retyped'] ELSE ['renamed'] END), {name('q.so', 'old')}, {name('s.sn', 'new')} FROM {p}q q JOIN (SELECT DISTINCT feed, file_seq, so, sn FROM {p}b) s USING (feed, file_seq, so)"""


ORACLE = _nested_sql() | {
    "p5_found": f"""WITH {_VALUES},
steps AS (SELECT *, '' AS so, '' AS sn FROM (SELECT feed, file_seq, lag(file_seq) OVER (PARTITION BY feed ORDER BY file_seq) AS before FROM (SELECT DISTINCT feed, file_seq FROM collection_files)) WHERE before IS NOT NULL),
{_compared('a', 'steps')},
lists AS (SELECT s.feed, s.file_seq, s.before, x.old AS so, x.new AS sn FROM steps s JOIN (SELECT feed, file_seq, field AS old, field AS new, ko, kn FROM ab WHERE io = 1 AND inn = 1 UNION ALL SELECT feed, file_seq, old, new, ko, kn FROM aq) x USING (feed, file_seq) WHERE ko = 'list of objects' AND kn = 'list of objects'),
{_compared('b', 'lists')}
{_reported('a')} UNION ALL {_reported('b')}""",
    "p5_schemas": f"""
WITH l AS (SELECT feed, file_seq, CASE WHEN json_valid(body) THEN body END AS b FROM collection_files),
t AS (SELECT feed, file_seq, k AS field, json_extract(b, '$."' || k || '"') AS v FROM (SELECT feed, file_seq, b, unnest(json_keys(b)) AS k FROM l WHERE json_type(b) = 'OBJECT')),
top AS (SELECT feed, file_seq, field, v, {_KIND.format('v')} AS kind FROM t WHERE json_type(v) <> 'NULL'),
o AS (SELECT feed, file_seq, field AS scope, unnest(json_extract(v, '$[*]')) AS e FROM top WHERE kind = 'list of objects'),
i AS (SELECT feed, file_seq, scope, k AS field, json_extract(e, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(e)) AS k FROM o WHERE json_type(e) = 'OBJECT')),
r AS (SELECT feed, file_seq, '' AS scope, field, kind FROM top UNION ALL SELECT feed, file_seq, scope, field, {_KIND.format('v')} FROM i WHERE json_type(v) <> 'NULL'),
m AS (SELECT feed, file_seq, scope, field, bit_and(CASE kind {_BITS} ELSE {BOTTOM} END) AS mask FROM r GROUP BY ALL)
SELECT feed, file_seq, scope, field, CASE mask {_TYPES} END AS kind FROM m""",
    "p1_found": f"""{_TREES}
SELECT u.tree, a.label AS ancestor_key, n.label AS node_key FROM up u
JOIN label a ON a.tree = u.tree AND a.k = u.p JOIN label n ON n.tree = u.tree AND n.k = u.c""",
    "p1_statements": f"""{_TREES.replace('UNION SELECT a.k, s.k', 'UNION ALL SELECT a.k, s.k')}
SELECT c AS key, count(*) AS statements, count(DISTINCT p) AS teachers, min(p) AS kept, count(DISTINCT p) - 1 AS not_followed FROM said GROUP BY c""",
    "p1_paths": f"""{_TREES},
ring AS (SELECT tree, c AS k, min(p) AS ring_id FROM up WHERE (tree, c) IN (SELECT tree, c FROM up WHERE c = p) GROUP BY tree, c),
path AS (SELECT tree, k, k AS path, 0 AS depth, k AS root FROM label WHERE (tree, k) NOT IN (SELECT tree, c FROM edge) OR (tree, k) IN (SELECT tree, k FROM ring)
  UNION ALL SELECT e.tree, e.c, path || ' > ' || e.c, depth + 1, root FROM path JOIN edge e ON e.tree = path.tree AND e.p = path.k WHERE (e.tree, e.c) NOT IN (SELECT tree, k FROM ring))
SELECT path.tree, path.k AS key, path, depth::INT AS depth, root, (SELECT count(*) FROM up WHERE up.tree = path.tree AND up.p = path.k) AS n_descendants, ring_id FROM path LEFT JOIN ring ON ring.tree = path.tree AND ring.k = root""",
    "p4_found": """
WITH c AS (SELECT * FROM collections QUALIFY row_number() OVER (PARTITION BY id ORDER BY modifiedUtc DESC NULLS LAST, row_no) = 1),
p AS (SELECT id, x, i - 1 AS i FROM (SELECT id, unnest(passages) AS x, unnest(range(1, len(passages) + 1)) AS i FROM c) WHERE x IS NOT NULL),
k AS (SELECT id, x, i - 1 AS i FROM (SELECT id, unnest(concepts) AS x, unnest(range(1, len(concepts) + 1)) AS i FROM c) WHERE x IS NOT NULL),
a AS (SELECT id, i, x, j - 1 AS j FROM (SELECT id, i, unnest(x.apparatus) AS x, unnest(range(1, len(x.apparatus) + 1)) AS j FROM p) WHERE x IS NOT NULL),
r AS (
SELECT 'passage' AS entity, id, i AS i0, -1 AS i1, -1 AS i2 FROM p
UNION ALL SELECT 'passage_tag', id, i, j - 1, -1 FROM (SELECT id, i, unnest(x.tags) AS y, unnest(range(1, len(x.tags) + 1)) AS j FROM p) WHERE y IS NOT NULL
UNION ALL SELECT 'passage_master', id, i, j - 1, -1 FROM (SELECT id, i, unnest(x.masterNames) AS y, unnest(range(1, len(x.masterNames) + 1)) AS j FROM p) WHERE y IS NOT NULL
UNION ALL SELECT 'linked_text', id, i, j - 1, -1 FROM (SELECT id, i, unnest(x.linkedTexts) AS y, unnest(range(1, len(x.linkedTexts) + 1)) AS j FROM p) WHERE y IS NOT NULL
UNION ALL SELECT 'passage_app', id, i, j, -1 FROM a
UNION ALL SELECT 'passage_reading', id, i, j, l - 1 FROM (SELECT id, i, j, unnest(x.readings) AS y, unnest(range(1, len(x.readings) + 1)) AS l FROM a) WHERE y IS NOT NULL
UNION ALL SELECT 'concept', id, i, -1, -1 FROM k
UNION ALL SELECT 'concept_tag', id, i, j - 1, -1 FROM (SELECT id, i, unnest(x.tags) AS y, unnest(range(1, len(x.tags) + 1)) AS j FROM k) WHERE y IS NOT NULL
UNION ALL SELECT 'link', id, i - 1, -1, -1 FROM (SELECT id, unnest(links) AS y, unnest(range(1, len(links) + 1)) AS i FROM c) WHERE y IS NOT NULL
UNION ALL SELECT 'extra_master', id, i - 1, -1, -1 FROM (SELECT id, unnest(ExtraMasters) AS y, unnest(range(1, len(ExtraMasters) + 1)) AS i FROM c) WHERE y IS NOT NULL)
SELECT entity, id AS collection_id, i0::INT AS i0, i1::INT AS i1, i2::INT AS i2 FROM r""",
    "p4_counts": """
WITH c AS (SELECT * FROM collections QUALIFY row_number() OVER (PARTITION BY id ORDER BY modifiedUtc DESC NULLS LAST, row_no) = 1),
p AS (SELECT unnest(passages) AS x FROM c), k AS (SELECT unnest(concepts) AS x FROM c), a AS (SELECT unnest(x.apparatus) AS x FROM p),
e AS (SELECT 'passages' AS entity, count(x) AS n, count(DISTINCT x) AS m FROM p
UNION ALL SELECT 'concepts', count(x), count(DISTINCT x) FROM k
UNION ALL SELECT 'links', count(x), count(DISTINCT x) FROM (SELECT unnest(links) AS x FROM c)
UNION ALL SELECT 'ExtraMasters', count(x), count(DISTINCT x) FROM (SELECT unnest(ExtraMasters) AS x FROM c)
UNION ALL SELECT 'passages.tags', count(x), count(DISTINCT x) FROM (SELECT unnest(x.tags) AS x FROM p)
UNION ALL SELECT 'passages.masterNames', count(x), count(DISTINCT x) FROM (SELECT unnest(x.masterNames) AS x FROM p)
UNION ALL SELECT 'passages.linkedTexts', count(x), count(DISTINCT x) FROM (SELECT unnest(x.linkedTexts) AS x FROM p)
UNION ALL SELECT 'passages.apparatus', count(x), count(DISTINCT x) FROM a
UNION ALL SELECT 'passages.apparatus.readings', count(x), count(DISTINCT x) FROM (SELECT unnest(x.readings) AS x FROM a)
UNION ALL SELECT 'concepts.tags', count(x), count(DISTINCT x) FROM (SELECT unnest(x.tags) AS x FROM k))
SELECT entity, n AS occurrences, m AS objects FROM e WHERE n > 0""",
}

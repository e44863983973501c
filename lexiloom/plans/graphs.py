"""Registered queries over collections, lineages, lists and events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.text import iso_day, line_range, safe_color, stars
from lexiloom.operators import align, graph, lists
from lexiloom.plans import pages
from lexiloom.operators.hierarchy import collection_links, latest_state, person_links
from lexiloom.session import materialise, own_dir, table
from lexiloom.streaming.jsonl import drained, json_stream

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_FOLD = "lower(trim(translate({}, '_-', '  ')))"
_PEOPLE = f"""rows AS (SELECT {_FOLD.format('names[1]')} AS k, * FROM masters WHERE names[1] IS NOT NULL),
alias AS (SELECT {_FOLD.format('n')} AS a, min(k) AS k FROM (SELECT k, unnest(names) AS n FROM rows) GROUP BY 1),
said AS (SELECT r.k AS c, a.k AS p FROM rows r JOIN alias a ON {_FOLD.format('r.teacher')} = a.a UNION SELECT a.k, s.k FROM (SELECT k, unnest(students) AS n FROM rows) s JOIN alias a ON {_FOLD.format('s.n')} = a.a),
link AS (SELECT p.k AS key, min(s.p) AS parent FROM (SELECT DISTINCT k FROM rows) p LEFT JOIN said s ON s.c = p.k GROUP BY p.k)"""


@query(f"WITH {_PEOPLE} SELECT key, parent FROM link WHERE parent IS NOT NULL")
def lineage_edges(s: SparkSession, d: str) -> DataFrame:
    return person_links(table(s, d, "masters")).filter("parent is not null").select("key", "parent")


_LAYERS = f"""{_PEOPLE}, step AS (SELECT key, 0 AS layer FROM link WHERE parent IS NULL UNION ALL SELECT l.key, s.layer + 1 FROM link l JOIN step s ON l.parent = s.key),
lay AS (SELECT l.key, coalesce(s.layer, -1) AS layer FROM link l LEFT JOIN step s USING (key))"""


@query(f"WITH RECURSIVE {_LAYERS} SELECT key, layer FROM lay")
def lineage_layers(s: SparkSession, d: str) -> DataFrame:
    return graph.lineage_layers(person_links(table(s, d, "masters")))


@query("""WITH m AS (SELECT *, coalesce(floruit, 0) AS f, coalesce(death, 0) AS e FROM masters)
SELECT row_no, coalesce(names[1], 'Person ' || row_no) AS key, coalesce(school, '') AS school, coalesce(attestation, '') AS attestation, (CASE WHEN e <> 0 THEN e WHEN f <> 0 THEN f ELSE 800 END)::INT AS year,
CASE WHEN f <> 0 AND e <> 0 THEN f || '–' || e WHEN f <> 0 THEN 'fl. ' || f WHEN e <> 0 THEN 'd. ' || e ELSE '' END AS dates FROM m""")
def lineage_nodes(s: SparkSession, d: str) -> DataFrame:
    return graph.lineage_nodes(table(s, d, "masters"))


def _placed(s: SparkSession, d: str, aside: tuple[str, ...]) -> DataFrame:
    m = table(s, d, "masters")
    links = person_links(m)
    first = align.first_of(graph.lineage_nodes(m).withColumn("k", F.lower(F.trim(F.translate("key", "_-", "  ")))), ["k"], [F.col("row_no")])
    return graph.tree_layout(first.withColumn("key", F.col("k")).drop("k"), graph.lineage_layers(links), aside)


_NODES = """one AS (SELECT *, lower(trim(translate(names[1], '_-', '  '))) AS key, (CASE WHEN coalesce(death, 0) <> 0 THEN death WHEN coalesce(floruit, 0) <> 0 THEN floruit ELSE 800 END) AS year FROM masters WHERE names[1] IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY lower(trim(translate(names[1], '_-', '  '))) ORDER BY row_no) = 1),
al AS (SELECT one.key, layer, row_no, year, (SELECT min(year) FROM one WHERE year > 0) AS first FROM one JOIN lay USING (key)),
tr AS (SELECT *, layer * 160 + 60.0 AS x, (year - first) * 3.0 AS y, row_number() OVER (PARTITION BY layer ORDER BY year, row_no) - 1 AS i FROM al WHERE layer >= 0),
pl AS (SELECT key, layer, x::DOUBLE AS x, (i * 44 + max(y - i * 44) OVER (PARTITION BY layer ORDER BY year, row_no))::DOUBLE AS y FROM tr),
gr AS (SELECT key, layer, row_number() OVER (ORDER BY row_no) - 1 AS i FROM al WHERE layer < 0),
pic AS (SELECT * FROM pl UNION ALL SELECT key, layer, (i % 8 * 150 + 60)::DOUBLE, ((SELECT coalesce(max(y), 0) FROM pl) + 120 + i // 8 * 54)::DOUBLE FROM gr)"""


@query(f"WITH RECURSIVE {_LAYERS}, {_NODES} SELECT key, layer, x, y FROM pic")
def lineage_layout(s: SparkSession, d: str) -> DataFrame:
    return _placed(s, d, ())


@query()
def lineage_layout_aside(s: SparkSession, d: str) -> DataFrame:
    """The same with one school set to the right of what is near it; pushed box by box, so without SQL."""
    return _placed(s, d, ("Reed Gate",))


@query(f"WITH RECURSIVE {_LAYERS}, {_NODES} SELECT layer, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, count(*) AS n FROM pic GROUP BY layer HAVING count(*) >= 2")
def layout_bounds(s: SparkSession, d: str) -> DataFrame:
    return graph.bounds(_placed(s, d, ()), ["layer"], least=2)


@query(f"WITH {_PEOPLE}, f AS (SELECT min(key) AS k FROM link WHERE parent IS NOT NULL) SELECT parent AS key, 'teacher' AS role FROM link JOIN f ON key = k UNION ALL SELECT key, 'student' FROM link JOIN f ON parent = k")
def direct_lineage(s: SparkSession, d: str) -> DataFrame:
    links = materialise(person_links(table(s, d, "masters")), "people")
    focus = links.filter("parent is not null").agg(F.min("key")).first()[0] or ""
    return graph.direct_lineage(links, focus)


@query("SELECT CASE WHEN upper(left(coalesce(attestation, ''), 1)) IN ('D', 'C', 'B') THEN upper(left(attestation, 1)) ELSE 'other' END AS class, count(*) AS n FROM masters GROUP BY 1")
def attestation_classes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "masters").groupBy(graph.attestation_class(F.col("attestation")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


# Collections

_NOW = "c AS (SELECT * FROM collections WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY modifiedUtc DESC NULLS LAST, row_no) = 1)"
_GRAPH = f"""{_NOW}, p AS (SELECT id AS cid, unnest(passages) AS p, generate_subscripts(passages, 1) AS i FROM c),
k AS (SELECT id AS cid, unnest(concepts) AS k, generate_subscripts(concepts, 1) AS i FROM c),
nn AS (SELECT cid, p.id AS nid, CASE WHEN lower(coalesce(p.annotationType, '')) = 'book' THEN 5 ELSE 0 END AS type, coalesce(nullif(p.summary, ''), nullif(substr(coalesce(p.zhText, ''), 1, 30), ''), nullif(regexp_replace(regexp_replace(coalesce(p.sourceRelPath, ''), '^.*/', ''), '(?i)\\.xml$', ''), ''), p.id) AS label, NULL AS status, 0 AS r, -i AS i FROM p WHERE p.id <> ''
UNION ALL SELECT cid, k.id, 1, coalesce(nullif(k.name, ''), '?'), k.status, -1, -i FROM k WHERE k.id <> ''
UNION ALL SELECT cid, 'person:' || m, 2, m, NULL, 1, i * 100000 + j FROM (SELECT cid, i, unnest(p.masterNames) AS m, generate_subscripts(p.masterNames, 1) AS j FROM p) WHERE m IS NOT NULL
UNION ALL SELECT id, 'person:' || m, 2, m, NULL, 2, i FROM (SELECT id, unnest(ExtraMasters) AS m, generate_subscripts(ExtraMasters, 1) AS i FROM c) WHERE m IS NOT NULL
UNION ALL SELECT a.id, b.id, 4, coalesce(nullif(b.name, ''), 'Sub-collection'), NULL, 3, b.row_no FROM c b JOIN c a ON lower(trim(b.parentCollectionId)) = lower(trim(a.id)) AND a.id <> b.id),
nd AS (SELECT cid, nid, type, label, status FROM nn QUALIFY row_number() OVER (PARTITION BY cid, nid ORDER BY r, i, label) = 1),
sl AS (SELECT id AS cid, unnest(links) AS l FROM c),
st AS (SELECT cid, l.fromPassageId AS f, l.toPassageId AS t, coalesce(l.relationType, '') AS rel, CASE WHEN coalesce(l.weight, 0) = 0 THEN 1.0 ELSE l.weight END AS w, coalesce(l.colorHex, '') AS col, false AS auto FROM sl WHERE l IS NOT NULL
  AND (cid, l.fromPassageId) IN (SELECT cid, nid FROM nd) AND (cid, l.toPassageId) IN (SELECT cid, nid FROM nd)),
au AS (SELECT cid, p.id AS f, 'person:' || m AS t FROM (SELECT cid, p, unnest(p.masterNames) AS m FROM p WHERE p.id <> '' AND lower(coalesce(p.annotationType, '')) <> 'book') WHERE m IS NOT NULL),
eg AS (SELECT * FROM st UNION ALL SELECT cid, f, t, 'attributed-to', 0.5, '', true FROM au WHERE (cid, f, t) NOT IN (SELECT cid, f, t FROM st) AND (cid, t, f) NOT IN (SELECT cid, f, t FROM st))"""


@query(f"WITH {_GRAPH} SELECT cid AS collection_id, nid AS node_id, type::INT AS type, label, status::INT AS status FROM nd")
def graph_nodes(s: SparkSession, d: str) -> DataFrame:
    return graph.graph_nodes(table(s, d, "collections"))


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(s, d, "collections")
    nodes = materialise(graph.graph_nodes(rows), "nodes")
    return nodes, graph.graph_edges(rows, nodes)


@query(f"WITH {_GRAPH} SELECT cid AS collection_id, f AS from_id, t AS to_id, rel AS relation_type, w::DOUBLE AS weight, col AS color, auto AS is_auto FROM eg")
def graph_edges(s: SparkSession, d: str) -> DataFrame:
    return _graph(s, d)[1]


@query(f"""WITH {_GRAPH}, en AS (SELECT cid, f AS n, 1 AS c FROM eg UNION ALL SELECT cid, t, (f <> t)::INT FROM eg), dg AS (SELECT cid, n, count(*) AS degree, sum(c)::BIGINT AS connections FROM en GROUP BY cid, n)
SELECT cid AS collection_id, n AS node_id, degree, connections, (list_value(10, 12, 14, 12, 14, 14, 12)[type + 1] + least(degree * list_value(2, 2, 1.5, 1.5, 2, 2, 1.5)[type + 1], list_value(12, 14, 10, 10, 12, 12, 10)[type + 1]))::DOUBLE AS radius FROM dg JOIN nd ON nd.cid = dg.cid AND nd.nid = dg.n""".replace("SELECT cid AS collection_id, n AS node_id, degree", "SELECT dg.cid AS collection_id, n AS node_id, degree"))
def node_degrees(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(s, d)
    return graph.degrees(edges).join(nodes.select("collection_id", "node_id", "type"), ["collection_id", "node_id"]).select("collection_id", "node_id", "degree", "connections", graph.node_radius(F.col("type"), F.col("degree")).alias("radius"))


@query(f"WITH {_GRAPH}, en AS (SELECT DISTINCT cid, f, t FROM (SELECT cid, f, t FROM eg UNION ALL SELECT cid, t, f FROM eg)) SELECT cid AS collection_id, f AS node_id, string_agg(t, '|' ORDER BY t) AS neighbours FROM en GROUP BY cid, f")
def graph_adjacency(s: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(_graph(s, d)[1]).select("collection_id", "node_id", F.array_join("neighbours", "|").alias("neighbours"))


@query(f"WITH {_GRAPH}, fo AS (SELECT cid, min(nid) AS n FROM nd GROUP BY cid) SELECT eg.cid AS collection_id, f AS from_id, t AS to_id, rel AS relation_type FROM eg JOIN fo ON fo.cid = eg.cid AND (f = n OR t = n)")
def ego_network(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(s, d)
    focus = nodes.groupBy("collection_id").agg(F.min("node_id").alias("node_id"))
    return graph.ego(edges, focus).select("collection_id", "from_id", "to_id", "relation_type")


@query(f"""WITH {_GRAPH} SELECT cid AS collection_id, f AS from_id, t AS to_id, regexp_replace(rel, '^custom-', '') AS name, CASE WHEN rel IN ('parallels', 'opposes', 'contrasts-with', 'complements') THEN 'undirected' ELSE 'directed' END AS direction,
CASE WHEN col <> '' THEN col WHEN rel = 'answers' THEN '#112233' WHEN rel = 'echoes' THEN '#445566' ELSE '#9E9E9E' END AS shown_color FROM eg""")
def edge_styles(s: SparkSession, d: str) -> DataFrame:
    colors = s.createDataFrame([("answers", "#112233"), ("echoes", "#445566")], "relation_type string, type_color string")
    rows = graph.edge_color(F.col("color"), F.col("relation_type"), colors, _graph(s, d)[1], "#9E9E9E")
    return rows.select("collection_id", "from_id", "to_id", graph.relation_name(F.col("relation_type")).alias("name"), graph.edge_direction(F.col("relation_type")).alias("direction"), "shown_color")


@query()
def graph_layout(s: SparkSession, d: str) -> DataFrame:
    """Force layout of every collection's graph; iterative, so without SQL."""
    return graph.force_layout(*_graph(s, d))


@query(f"WITH {_GRAPH} SELECT cid AS collection_id, count(*) AS nodes, true AS placed, true AS apart FROM nd GROUP BY cid")
def graph_layout_kept(s: SparkSession, d: str) -> DataFrame:
    """By graph how many nodes the layout places, and whether each has a place of its own."""
    at = graph.force_layout(*_graph(s, d))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e9)
    each = at.groupBy("collection_id").agg(F.count(F.lit(1)).alias("nodes"), F.bool_and(finite("x") & finite("y")).alias("placed"), F.count_distinct("x", "y").alias("places"))
    return each.select("collection_id", "nodes", "placed", (F.col("nodes") == F.col("places")).alias("apart"))


@query(f"""WITH {_GRAPH}, m AS (SELECT lower(n) AS k, min(row_no) AS row_no FROM (SELECT row_no, unnest(names) AS n FROM masters) WHERE n IS NOT NULL GROUP BY 1),
h AS (SELECT cid, nid, type, status, label, row_no AS person_no FROM nd LEFT JOIN m ON type = 2 AND k = lower(substr(nid, 8)))
SELECT cid AS collection_id, nid AS node_id, coalesce(names[1], label) AS label, person_no, CASE WHEN p.row_no IS NULL THEN NULL WHEN coalesce(floruit, 0) <> 0 AND coalesce(death, 0) <> 0 THEN floruit || '–' || death WHEN coalesce(floruit, 0) <> 0 THEN 'fl. ' || floruit WHEN coalesce(death, 0) <> 0 THEN 'd. ' || death ELSE '' END AS dates,
CASE WHEN type = 1 AND status = 1 THEN '#666' ELSE ['#a', '#b', '#c', '#d', '#e', '#f', '#g'][type + 1] END AS color FROM h LEFT JOIN masters p ON p.row_no = person_no""")
def graph_people(s: SparkSession, d: str) -> DataFrame:
    """Nodes with the persons they are, and their colour."""
    rows = graph.with_people(graph.graph_nodes(table(s, d, "collections")).withColumnRenamed("type", "kind"), table(s, d, "masters"))
    color = graph.node_color(F.col("kind"), F.col("status"), F.lit(None).cast("string"), ["#a", "#b", "#c", "#d", "#e", "#f", "#g"])
    return rows.select("collection_id", "node_id", "label", "person_no", "dates", color.alias("color"))


@query(f"WITH {_GRAPH} SELECT cid AS collection_id, nid AS node_id, label FROM nd WHERE contains(lower(label), 'no')")
def node_search(s: SparkSession, d: str) -> DataFrame:
    return pages.labelled(graph.graph_nodes(table(s, d, "collections")), "no").select("collection_id", "node_id", "label")


@query()
def graph_positions(s: SparkSession, d: str) -> DataFrame:
    """Places of nodes: saved ones of the first collection's graph, those of the layout elsewhere."""
    nodes, edges = _graph(s, d)
    saved = nodes.join(nodes.agg(F.min("collection_id").alias("collection_id")), "collection_id").select("collection_id", "node_id", F.length("label").cast("double").alias("x"), F.lit(1.0).alias("y"))
    return pages.placed(nodes.select("collection_id", "node_id"), saved, graph.force_layout(nodes, edges))


@query(f"""WITH {_NOW}, l AS (SELECT id, lower(trim(id)) AS k, lower(trim(parentCollectionId)) AS p FROM c)
SELECT a.id, CASE WHEN b.id IS NULL THEN '' ELSE a.p END AS parent, (SELECT count(*) FROM l x WHERE x.p = a.k) AS children FROM l a LEFT JOIN l b ON a.p = b.k""")
def collection_tree(s: SparkSession, d: str) -> DataFrame:
    """Collections with the parent that exists, and the number of children."""
    links = collection_links(table(s, d, "collections"))
    known = links.select(F.col("key").alias("parent"), F.lit(True).alias("known"))
    kids = links.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("children"))
    rows = links.join(known, "parent", "left").join(kids, "key", "left")
    return rows.select(F.col("label").alias("id"), F.when(F.col("known"), F.col("parent")).otherwise(F.lit("")).alias("parent"), F.coalesce("children", F.lit(0)).cast("long").alias("children"))


@query(f"""WITH {_NOW} SELECT user_name, arg_min(name, row_no) AS first_name, count(*) AS collections, sum(len(coalesce(passages, [])))::BIGINT AS passages, sum(len(coalesce(concepts, [])))::BIGINT AS concepts FROM c GROUP BY user_name ORDER BY collections DESC, user_name LIMIT 5""")
def user_cards(s: SparkSession, d: str) -> DataFrame:
    now = latest_state(table(s, d, "collections")).filter("id is not null")
    n = lambda c: F.sum(F.coalesce(F.array_size(c), F.lit(0))).cast("long").alias(c)
    return now.groupBy("user_name").agg(F.min_by("name", "row_no").alias("first_name"), F.count(F.lit(1)).alias("collections"), n("passages"), n("concepts")).orderBy(F.col("collections").desc(), "user_name").limit(5)


@query(f"""WITH {_NOW}, p AS (SELECT id, unnest(passages) AS p, generate_subscripts(passages, 1) AS i FROM c), q AS (SELECT * FROM p WHERE p IS NOT NULL)
SELECT id AS collection_id, row_number() OVER w::INT AS i, count(*) OVER (PARTITION BY id) AS n, lag(p.id) OVER w AS previous, lead(p.id) OVER w AS next,
CASE WHEN coalesce(p.fromLb, '') = '' THEN '' WHEN coalesce(p.toLb, '') NOT IN ('', p.fromLb) THEN p.fromLb || ' – ' || p.toLb ELSE p.fromLb END AS lines, repeat('★', greatest(0, least(5, coalesce(p.importance, 0)))) AS stars FROM q WINDOW w AS (PARTITION BY id ORDER BY i)""")
def prev_next(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = latest_state(table(s, d, "collections")).filter("id is not null").select(F.col("id").alias("collection_id"), F.posexplode("passages").alias("k", "p")).filter("p is not null")
    w = Window.partitionBy("collection_id").orderBy("k")
    return rows.select("collection_id", F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("collection_id")).alias("n"), F.lag("p.id").over(w).alias("previous"), F.lead("p.id").over(w).alias("next"),
                       line_range(F.col("p.fromLb"), F.col("p.toLb")).alias("lines"), stars(F.col("p.importance")).alias("stars"))


@query(f"""WITH {_NOW}, t AS (SELECT id, unnest(tags) AS tag FROM c), v(id, name, color, seq) AS (VALUES ('debt', 'Debts', '#aa1100', 0), ('debt', 'Twice', '#000', 1), ('tools', 'Tools', 'red', 2))
SELECT t.id AS collection_id, tag, coalesce(v.name, tag) AS label, CASE WHEN regexp_matches(v.color, '^#[0-9A-Fa-f]{{3,8}}$') THEN v.color ELSE '#888888' END AS color FROM t LEFT JOIN (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1) v ON v.id = tag WHERE tag IS NOT NULL""")
def tag_labels(s: SparkSession, d: str) -> DataFrame:
    vocabulary = s.createDataFrame([("debt", "Debts", "#aa1100", 0), ("debt", "Twice", "#000", 1), ("tools", "Tools", "red", 2)], "id string, name string, color string, seq int")
    rows = latest_state(table(s, d, "collections")).filter("id is not null").select(F.col("id").alias("collection_id"), F.explode("tags").alias("tag")).filter("tag is not null")
    return align.with_labels(rows, vocabulary, "tag", "#888888").select("collection_id", "tag", "label", "color")


@query(f"WITH {_NOW}, l AS (SELECT unnest(links) AS l FROM c) SELECT l.relationType AS relation, count(*) AS n, count(CASE WHEN regexp_matches(l.colorHex, '^#[0-9A-Fa-f]{{3,8}}$') THEN 1 END) AS colored FROM l WHERE l IS NOT NULL GROUP BY 1")
def relation_counts(s: SparkSession, d: str) -> DataFrame:
    rows = latest_state(table(s, d, "collections")).filter("id is not null").select(F.explode("links").alias("l")).filter("l is not null")
    return rows.groupBy(F.col("l.relationType").alias("relation")).agg(F.count(F.lit(1)).alias("n"), F.count(safe_color(F.col("l.colorHex"))).alias("colored"))


@query("SELECT id, user_name, name, schemaVersion, row_no FROM collections WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY modifiedUtc DESC NULLS LAST, row_no) = 1")
def latest_collections(s: SparkSession, d: str) -> DataFrame:
    return latest_state(table(s, d, "collections")).filter("id is not null").select("id", "user_name", "name", "schemaVersion", "row_no")


@query("SELECT id, row_no, strftime(modifiedUtc, '%b %-d, %Y') AS day FROM collections")
def shown_dates(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "collections").select("id", "row_no", iso_day(F.date_format("modifiedUtc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("day"))


# Lists and events

@query("""WITH s AS (SELECT doc_id % 5 AS list, file_id, max(doc_id) AS doc_id FROM documents WHERE file_id <> '' AND source <> 'crawl' GROUP BY 1, 2), n AS (SELECT doc_id % 5 AS list, file_id, max(doc_id) AS doc_id FROM documents WHERE file_id <> '' AND source = 'crawl' GROUP BY 1, 2)
SELECT * FROM s WHERE (list, file_id) NOT IN (SELECT list, file_id FROM n) UNION ALL SELECT * FROM n""")
def list_upsert(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").filter("file_id <> ''").select((F.col("doc_id") % 5).alias("list"), "file_id", "doc_id", "source")
    part = lambda c: rows.filter(c).groupBy("list", "file_id").agg(F.max("doc_id").alias("doc_id"))
    return lists.upsert(part("source <> 'crawl'"), part("source = 'crawl'"), ["list", "file_id"])


@query("SELECT event_id, user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 2 HOUR, true) AS shown FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def cooldown(s: SparkSession, d: str) -> DataFrame:
    return lists.cooled_down(table(s, d, "events"), "user_id", "ts", 7_200, "event_id").select("event_id", "user_id", "ts", "shown")


@query("SELECT user_id, event_type, value, event_id FROM events WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1")
def argmax(s: SparkSession, d: str) -> DataFrame:
    return align.best(table(s, d, "events"), ["user_id", "event_type"], "value", "event_id").select("user_id", "event_type", "value", "event_id")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_write(s: SparkSession, d: str) -> DataFrame:
    return lists.last_write(table(s, d, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


_ACTION = "CASE WHEN event_type = 'purchase' THEN 'clear' WHEN event_id % 5 = 0 THEN 'resume' ELSE 'set' END"


@query(f"""WITH e AS (SELECT user_id, event_id, {_ACTION} AS action FROM events), c AS (SELECT user_id, max(event_id) AS cleared FROM e WHERE action = 'clear' GROUP BY user_id),
r AS (SELECT e.user_id, min(event_id) AS resumed FROM e JOIN c USING (user_id) WHERE action = 'resume' AND event_id > cleared GROUP BY e.user_id)
SELECT user_id, max(event_id) AS event_id FROM e LEFT JOIN c USING (user_id) LEFT JOIN r USING (user_id) WHERE action = 'set' AND (cleared IS NULL OR event_id > resumed) GROUP BY user_id""")
def last_read(s: SparkSession, d: str) -> DataFrame:
    """Readers' last positions, where clearing suppresses them until it is resumed."""
    events = table(s, d, "events").select("user_id", "event_id", F.expr(_ACTION).alias("action"))
    return lists.last_read(events, ["user_id"], "event_id").select("user_id", "event_id")


@query("""SELECT event_id, user_id FROM (SELECT *, sum(length(coalesce(props, '')) * 2) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS size FROM events) WHERE size <= 400""")
def cache_budget(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").withColumn("size", F.length(F.coalesce("props", F.lit(""))) * 2)
    return lists.within_budget(rows, "user_id", "ts", "size", 400, "event_id").select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE epoch_ms(ts) + 86400000 >= (SELECT max(epoch_ms(ts)) FROM events)")
def cache_expiry(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").withColumn("at", F.unix_millis(F.col("ts").cast("timestamp"))).withColumn("ttl", F.lit(86_400_000).cast("long"))
    return lists.unexpired(rows, "at", "ttl", rows.agg(F.max("at")).first()[0] or 0).select("event_id")


@query("""WITH a AS (SELECT vec_id AS id, label AS v FROM embeddings), b AS (SELECT doc_id AS id, n_chars::INT AS v FROM documents)
SELECT id, v, choice::INT AS choice FROM (SELECT id, v, 0 AS choice FROM a UNION ALL SELECT id, v, 1 FROM b) QUALIFY row_number() OVER (PARTITION BY id ORDER BY choice) = 1""")
def fallback_chain(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("v"))
    b = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("int").alias("v"))
    return align.first_available([a, b], "id").select("id", "v", "choice")


@query("SELECT feed, file_seq, line_no, body->>'$.id' AS id, coalesce(body->>'$.name', body->>'$.Name') AS name FROM collection_files WHERE json_valid(body) AND trim(body) <> '' AND json_type(body) = 'OBJECT'")
def json_dual_case(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "collection_files").withColumn("v", F.try_parse_json("body")).filter("schema_of_variant(v) LIKE 'OBJECT%'")
    return rows.selectExpr("feed", "file_seq", "line_no", "try_variant_get(v, '$.id', 'string') AS id", "coalesce(try_variant_get(v, '$.name', 'string'), try_variant_get(v, '$.Name', 'string')) AS name")


@query("SELECT body->>'$.id' AS id, body->>'$.studyNotes' AS studyNotes FROM collection_files WHERE json_valid(body) AND trim(body) <> ''")
def stream_jsonl(s: SparkSession, d: str) -> DataFrame:
    """Exported lines written as text files and read as a stream, to the end."""
    base = f"{own_dir(s)}/stream-{uuid.uuid4().hex}"
    table(s, d, "collection_files").filter("body is not null").select("body").write.text(base + "/in")
    rows = json_stream(s, base + "/in", T.StructType([T.StructField("id", T.StringType()), T.StructField("studyNotes", T.StringType())]))
    drained(rows, base + "/checkpoint", lambda batch, _: batch.write.mode("append").parquet(base + "/out"))
    return s.read.schema(rows.schema).parquet(base + "/out")

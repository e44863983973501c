"""Property graphs of collections, and the lineage of persons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.ids import stem_of_path
from lexiloom.functions.text import life_dates, text_or_empty
from lexiloom.operators.hierarchy import hierarchy, latest_state
from lexiloom.operators.lines import with_ordinal

#: Pairs of nodes that a layout holds at a time.
LAYOUT_CELLS = 4_000_000

# Radius, growth by degree and its cap by node type, and types of relation without direction.
RADIUS = ((10, 12, 14, 12, 14, 14, 12), (2, 2, 1.5, 1.5, 2, 2, 1.5), (12, 14, 10, 10, 12, 12, 10))
UNDIRECTED = (
    "parallels", "is-variant-of", "opposes", "related-to", "complements", "same-school", "contemporary-of", "rivaled", "synonym-of", "antonym-of", "term-related-to",
    "variant-of", "often-confused-with", "cross-ref", "complements-collection", "contrasts-with", "related-book", "edition-of", "related-link", "mirror-of", "same-topic-as")
PASSAGE, CONCEPT, PERSON, TERM, COLLECTION, BOOK, LINK = range(7)


def graph_nodes(collections: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """collection_id, node_id, type, label, status of every collection's graph.

    Passages (type 5 if annotated as book), concepts, the persons of passages, further
    persons, and the collections below. The first node of an id stays, but a later passage or
    concept takes the place of an earlier. ``suppressed`` (collection_id, node_id) removes
    nodes that were made without being asked for: persons and collections.
    """
    now = latest_state(collections).filter("id is not null").withColumnRenamed("id", "collection_id")
    kind = lambda k, rank, rows: rows.withColumn("rank", F.lit(rank)).select("collection_id", "node_id", k.alias("type"), "label", "status", "rank", "i")
    p = now.select("collection_id", F.posexplode("passages").alias("i", "p")).filter("p is not null")
    zh = F.substring(text_or_empty("p.zhText"), 1, 30)
    label = F.coalesce(F.nullif("p.summary", F.lit("")), F.nullif(zh, F.lit("")), F.nullif(stem_of_path(F.col("p.sourceRelPath")), F.lit("")), F.col("p.id"))
    none = F.lit(None).cast("int").alias("status")
    book = F.lower(text_or_empty("p.annotationType")) == "book"
    passages = kind(F.when(book, F.lit(BOOK)).otherwise(F.lit(PASSAGE)), 0, p.filter("p.id <> ''").select("collection_id", F.col("p.id").alias("node_id"), label.alias("label"), none, (-F.col("i")).alias("i"), "p"))
    c = now.select("collection_id", F.posexplode("concepts").alias("i", "c")).filter("c.id <> ''")
    concepts = kind(F.lit(CONCEPT), -1, c.select("collection_id", F.col("c.id").alias("node_id"), F.coalesce(F.nullif("c.name", F.lit("")), F.lit("?")).alias("label"), F.col("c.status").alias("status"), (-F.col("i")).alias("i")))
    named = p.select("collection_id", "i", F.posexplode("p.masterNames").alias("j", "label")).filter("label is not null")
    person = lambda d, rank, i: kind(F.lit(PERSON), rank, d.select("collection_id", F.concat(F.lit("person:"), F.col("label")).alias("node_id"), "label", none, i.alias("i")))
    persons = person(named, 1, F.col("i") * 100_000 + F.col("j"))
    extra = now.select("collection_id", F.posexplode("ExtraMasters").alias("i", "label")).filter("label is not null")
    below = now.select(F.lower(F.trim("parentCollectionId")).alias("k"), F.col("collection_id").alias("node_id"), F.coalesce(F.nullif("name", F.lit("")), F.lit("Sub-collection")).alias("label"), F.col("row_no").alias("i"))
    below = below.join(now.select(F.lower(F.trim("collection_id")).alias("k"), "collection_id"), "k").filter("collection_id <> node_id")
    made = persons.unionByName(person(extra, 2, F.col("i"))).unionByName(kind(F.lit(COLLECTION), 3, below.select("collection_id", "node_id", "label", none, "i")))
    if suppressed is not None:
        made = made.join(suppressed, ["collection_id", "node_id"], "left_anti")
    every = passages.unionByName(concepts).unionByName(made)
    w = Window.partitionBy("collection_id", "node_id").orderBy("rank", "i", "label")
    return every.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "rank", "i")


def graph_edges(collections: DataFrame, nodes: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """collection_id, from_id, to_id, relation_type, weight, color, is_auto.

    Links whose ends are nodes, weight 1 where none or zero is given; and, for passages that
    are no books, an edge of weight 0.5 to every person they name, unless the two are linked
    already, in either direction, or the pair is in ``suppressed`` (collection_id, from_id, to_id).
    A person named twice in a passage is linked twice.
    """
    now = latest_state(collections).filter("id is not null").withColumnRenamed("id", "collection_id")
    ids = nodes.select("collection_id", "node_id")
    both = lambda d: d.join(ids.withColumnRenamed("node_id", "from_id"), ["collection_id", "from_id"], "left_semi").join(ids.withColumnRenamed("node_id", "to_id"), ["collection_id", "to_id"], "left_semi")
    link = now.select("collection_id", F.explode("links").alias("l")).filter("l is not null")
    weight = F.when(F.coalesce("l.weight", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("l.weight"))
    stated = both(link.select("collection_id", F.col("l.fromPassageId").alias("from_id"), F.col("l.toPassageId").alias("to_id"), text_or_empty("l.relationType").alias("relation_type"),
                              weight.alias("weight"), text_or_empty("l.colorHex").alias("color")))
    p = now.select("collection_id", F.explode("passages").alias("p")).filter((F.col("p.id") != "") & (F.lower(text_or_empty("p.annotationType")) != "book"))
    auto = p.select("collection_id", F.col("p.id").alias("from_id"), F.explode("p.masterNames").alias("name")).filter("name is not null")
    auto = both(auto.select("collection_id", "from_id", F.concat(F.lit("person:"), F.col("name")).alias("to_id")))
    pair = stated.select("collection_id", "from_id", "to_id")
    turned = stated.select("collection_id", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    key = ["collection_id", "from_id", "to_id"]
    auto = auto.join(pair.unionByName(turned), key, "left_anti")
    if suppressed is not None:
        auto = auto.join(suppressed, key, "left_anti")
    auto = auto.select(*key, F.lit("attributed-to").alias("relation_type"), F.lit(0.5).alias("weight"), F.lit("").alias("color"))
    return stated.select(*key, "relation_type", "weight", "color", F.lit(False).alias("is_auto")).unionByName(auto.withColumn("is_auto", F.lit(True)))


def degrees(edges: DataFrame) -> DataFrame:
    """collection_id, node_id, degree (a loop counts twice), connections (a loop counts once)."""
    ends = edges.select("collection_id", F.explode(F.array(F.struct(F.col("from_id").alias("node_id"), F.lit(1).alias("c")), F.struct(F.col("to_id").alias("node_id"), (F.col("from_id") != F.col("to_id")).cast("int").alias("c")))).alias("e"))
    return ends.groupBy("collection_id", F.col("e.node_id").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("e.c").alias("connections"))


def adjacency(edges: DataFrame) -> DataFrame:
    """collection_id, node_id, neighbours in order, both directions."""
    ends = edges.select("collection_id", "from_id", "to_id").unionByName(edges.select("collection_id", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
    return ends.distinct().groupBy("collection_id", F.col("from_id").alias("node_id")).agg(F.array_sort(F.collect_list("to_id")).alias("neighbours"))


def ego(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """Edges at the focus nodes (collection_id, node_id)."""
    a = edges.join(focus.withColumnRenamed("node_id", "from_id"), ["collection_id", "from_id"], "left_semi")
    b = edges.join(focus.withColumnRenamed("node_id", "to_id"), ["collection_id", "to_id"], "left_semi")
    return a.unionByName(b.join(focus.withColumnRenamed("node_id", "from_id"), ["collection_id", "from_id"], "left_anti"))


def node_radius(kind: Column, degree: Column) -> Column:
    base, scale, cap = (F.element_at(F.array(*[F.lit(float(x)) for x in t]), kind + 1) for t in RADIUS)
    return base + F.least(degree * scale, cap)


def edge_direction(relation: Column) -> Column:
    return F.when(relation.isin(*UNDIRECTED), F.lit("undirected")).otherwise(F.lit("directed"))


def edge_color(color: Column, relation: Column, table: DataFrame, edges: DataFrame, default: str) -> DataFrame:
    """Edges with ``shown_color``: their own, else that of their type in the table (relation_type, type_color), else the default."""
    return edges.join(table, "relation_type", "left").withColumn("shown_color", F.coalesce(F.nullif(color, F.lit("")), "type_color", F.lit(default))).drop("type_color")


def relation_name(relation: Column) -> Column:
    """A relation's name without the mark of user-made ones."""
    return F.regexp_replace(relation, "^custom-", "")


def bounds(nodes: DataFrame, by: list[str], x: str = "x", y: str = "y", least: int = 1) -> DataFrame:
    """Bounding box of each group of at least ``least`` nodes."""
    box = nodes.groupBy(*by).agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"), F.count(F.lit(1)).alias("n"))
    return box.filter(F.col("n") >= least)


def pushed_down(rows: DataFrame, by: list[str], y: str, order: str, gap: float, span: int = 1 << 14) -> DataFrame:
    """Rows with ``placed``: y, pushed down where less than ``gap`` below the row before of the same group.

    Closed form of the running push, i * gap + max(y - i * gap) over the rows so far. Place and
    maximum are first taken within parts of a group (equal y, near in ``order``), then carried
    over the parts, so that no task holds a whole group.
    """
    part = [*by, y, "_part"]
    rows = rows.withColumn("_part", F.floor(F.col(order) / span))
    inside = Window.partitionBy(*part).orderBy(order)
    over = Window.partitionBy(*by).orderBy(y, "_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(over), F.lit(0)))
    # Within a part y is the same, so that its first row has the greatest y - i * gap.
    parts = parts.withColumn("_before", F.max(F.col(y) - F.col("_base") * gap).over(over)).drop("_n")
    rows = rows.withColumn("_in", F.row_number().over(inside) - 1).join(parts, part)
    placed = (F.col("_base") + F.col("_in")) * gap + F.greatest(F.coalesce("_before", F.col(y) - F.col("_base") * gap), F.col(y) - F.col("_base") * gap)
    return rows.withColumn("placed", placed).drop("_part", "_in", "_base", "_before")


def force_layout(nodes: DataFrame, edges: DataFrame, rounds: int = 150) -> DataFrame:
    """collection_id, node_id, x, y by repulsion, attraction and gravity from a circle; the same at each run.

    One graph is laid out in one task, as a picture of it must be: all pairs repel each other.
    """
    ends = edges.groupBy("collection_id").agg(F.sort_array(F.collect_list(F.struct("from_id", "to_id"))).alias("e"))
    graphs = nodes.groupBy("collection_id").agg(F.sort_array(F.collect_list("node_id")).alias("ids")).join(ends, "collection_id", "left")

    def place(batches):
        for pdf in batches:
            out = []
            for cid, ids, e in zip(pdf["collection_id"], pdf["ids"], pdf["e"]):
                ids = list(ids)
                at = {k: i for i, k in enumerate(ids)}
                pairs = [] if e is None else [(at[a["from_id"]], at[a["to_id"]]) for a in e if a["from_id"] in at and a["to_id"] in at]
                out += [(cid, k, float(x), float(y)) for k, (x, y) in zip(ids, _spring(len(ids), pairs, rounds))]
            yield pd.DataFrame(out, columns=["collection_id", "node_id", "x", "y"])

    return graphs.mapInPandas(place, "collection_id string, node_id string, x double, y double")


def _spring(n: int, pairs: list[tuple[int, int]], rounds: int) -> np.ndarray:
    radius = np.sqrt(n) * 80
    angle = 2 * np.pi * np.arange(n) / n
    at = radius * np.column_stack([np.cos(angle), np.sin(angle)])
    k, heat = np.sqrt(radius * radius * 4 / n), radius / 5
    some = max(1, LAYOUT_CELLS // n)
    a, b = (np.array(x, int) for x in zip(*pairs)) if pairs else (np.zeros(0, int),) * 2
    for _ in range(rounds):
        move = np.empty_like(at)
        for i in range(0, n, some):  # some nodes against all at a time
            apart = at[i: i + some, None, :] - at[None, :, :]
            far = np.hypot(apart[..., 0], apart[..., 1])
            far[far == 0] = 0.01
            move[i: i + some] = (apart * (k * k / far ** 2)[..., None]).sum(1)
        pull = at[a] - at[b]
        length = np.hypot(pull[:, 0], pull[:, 1])
        length[length == 0] = 0.01
        force = pull * (length / k)[:, None]
        np.subtract.at(move, a, force)
        np.add.at(move, b, force)
        move -= at * 0.01
        size = np.hypot(move[:, 0], move[:, 1])
        size[size == 0] = 0.01
        step = np.minimum(size, heat)
        at = at + move * (step / size)[:, None]
        heat *= 0.95
        if step.max(initial=0) < 0.5:
            break
    return at


def lineage_nodes(persons: DataFrame) -> DataFrame:
    """row_no, key, school, year (death, else floruit, else 800), dates."""
    f, d = F.coalesce("floruit", F.lit(0)), F.coalesce("death", F.lit(0))
    return persons.select(
        "row_no", F.coalesce(F.get("names", F.lit(0)), F.concat(F.lit("Person "), F.col("row_no"))).alias("key"), text_or_empty("school").alias("school"), text_or_empty("attestation").alias("attestation"),
        F.when(d != 0, d).when(f != 0, f).otherwise(F.lit(800)).alias("year"), life_dates(F.col("floruit"), F.col("death")).alias("dates"))


def lineage_layers(links: DataFrame) -> DataFrame:
    """key, layer: steps from the root; -1 on a ring and below it."""
    return hierarchy(links).paths.select("key", F.when(F.col("ring_id").isNull(), F.col("depth")).otherwise(F.lit(-1)).alias("layer"))


def tree_layout(nodes: DataFrame, layers: DataFrame, aside: tuple[str, ...] = (), gap_x: float = 160, year_px: float = 3, gap_y: float = 44) -> DataFrame:
    """key, layer, x, y of a lineage: x by layer, y by year, pushed apart within layers; those without layer in a grid below.

    ``aside`` are schools that stand to the right of what is near them.
    """
    all_ = nodes.join(layers, "key").withColumn("apart", F.col("school").isin(*aside) if aside else F.lit(False))
    first = all_.agg(F.min(F.when(F.col("year") > 0, F.col("year"))).alias("first"))
    tree = all_.filter("layer >= 0").join(F.broadcast(first)).withColumn("x", F.col("layer") * gap_x + 60.0).withColumn("y", (F.col("year") - F.col("first")) * float(year_px))
    main = pushed_down(tree.filter("NOT apart"), ["layer"], "y", "row_no", gap_y).select("row_no", "key", "layer", "x", F.col("placed").alias("y"))
    done = main
    if aside:
        reach = 38 * 15
        side = tree.filter("apart").select("row_no", "key", "layer", "x", "y")
        # Band join on buckets of the reach: a row meets its own bucket and the two beside.
        cell = main.groupBy(F.floor(F.col("y") / reach).alias("cell"), "y").agg(F.max("x").alias("near_x")).withColumnRenamed("y", "near_y")
        asked = side.withColumn("cell", F.explode(F.array(*[F.floor(F.col("y") / reach) + k for k in (-1, 0, 1)])))
        near = asked.join(cell, "cell").filter(F.abs(F.col("y") - F.col("near_y")) < reach).groupBy("row_no").agg(F.max("near_x").alias("near_x"))
        side = side.join(near, "row_no", "left").withColumn("x", F.greatest("x", F.coalesce("near_x", F.lit(0.0)) + 330)).drop("near_x")
        done = main.unionByName(side.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_pushed_right, side.schema))
    deepest = done.agg(F.coalesce(F.max("y"), F.lit(0.0)).alias("deepest"))
    rest = with_ordinal(all_.filter("layer < 0"), "layer", "row_no", "i").join(F.broadcast(deepest))
    grid = rest.select("row_no", "key", "layer", (F.col("i") % 8 * 150 + 60.0).alias("x"), (F.col("deepest") + 120 + F.floor(F.col("i") / 8) * 54).alias("y"))
    return done.unionByName(grid).select("key", "layer", "x", "y")


def _pushed_right(pdf: pd.DataFrame) -> pd.DataFrame:
    """Boxes of one school that overlap, moved right of the one before."""
    pdf = pdf.sort_values(["x", "y", "row_no"]).reset_index(drop=True)
    x, y = pdf["x"].to_numpy().copy(), pdf["y"].to_numpy()
    for i in range(len(x)):
        over = (np.abs(x[i + 1:] - x[i]) < 140) & (np.abs(y[i + 1:] - y[i]) < 44)
        x[i + 1:][over] = x[i] + 150
    return pdf.assign(x=x).drop(columns="_all")


def direct_lineage(links: DataFrame, focus: str) -> DataFrame:
    """The teacher and the students of one key."""
    up = links.filter((F.col("key") == focus) & F.col("parent").isNotNull()).select(F.col("parent").alias("key"), F.lit("teacher").alias("role"))
    return up.unionByName(links.filter(F.col("parent") == focus).select("key", F.lit("student").alias("role")))


def attestation_class(c: Column) -> Column:
    """D, C or B by the first letter, else other."""
    first = F.upper(F.substring(F.coalesce(c, F.lit("")), 1, 1))
    return F.when(first.isin("D", "C", "B"), first).otherwise(F.lit("other"))


def node_color(kind: Column, status: Column, color: Column, palette: list[str], deprecated: str = "#666") -> Column:
    """Colour of a node: of a concept its own, or grey where deprecated (status 1); else that of its kind in the palette."""
    own = F.element_at(F.array(*[F.lit(c) for c in palette]), F.coalesce(kind, F.lit(0)) + 1)
    return F.when((kind == CONCEPT) & (status == 1), F.lit(deprecated)).when((kind == CONCEPT) & (F.coalesce(color, F.lit("")) != ""), color).otherwise(own)


def with_people(nodes: DataFrame, persons: DataFrame) -> DataFrame:
    """Nodes with person_no, and with the first name and the dates of the first person one of whose names a person node has, whatever its case."""
    alias = persons.select("row_no", F.explode("names").alias("_n")).filter("_n is not null").groupBy(F.lower("_n").alias("_k")).agg(F.min("row_no").alias("person_no"))
    facts = persons.groupBy(F.col("row_no").alias("person_no")).agg(F.first(F.struct(F.get("names", F.lit(0)).alias("name"), life_dates(F.col("floruit"), F.col("death")).alias("dates"))).alias("_p"))
    named = nodes.withColumn("_k", F.when(F.col("kind") == PERSON, F.lower(F.regexp_replace("node_id", "^person:", ""))))
    rows = named.join(alias, "_k", "left").join(facts, "person_no", "left")
    return rows.select(*[c for c in nodes.columns if c != "label"], F.coalesce(F.col("_p.name"), F.col("label")).alias("label"), "person_no", F.col("_p.dates").alias("dates"))

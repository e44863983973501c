"""Parent-child links to full hierarchies.

Method: rake and compress. Every round sets childless nodes aside (each hangs by one
link from a node that stays), spreads the rest over fragments, a partition each, follows
the parent chains inside each partition up to the first node outside it (the fragment's
exit), and keeps only the exits as a smaller quotient forest. The quotient is solved by
the same step; once it fits one fragment the recursion ends. Then paths are expanded
back, round by round, by one equi-join each. A ring inside a fragment shows as a chain
that returns; a ring across fragments shrinks with the quotient until it lies in one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import materialise

#: Nodes that one task holds while it follows chains.
FRAGMENT_ROWS = 50_000
#: Siblings that move together: those of a parent with more are spread by salt, and only the first part stays with it.
TOGETHER = 1_000

_CHAIN = "key string, exit string, seg array<string>, ring_id string, ring array<string>"


def _followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chains of one fragment, a partition: for every node the exit, the keys below it, and its ring if it is on one."""
    parts = list(batches)
    if not parts:
        return
    pdf = pd.concat(parts, ignore_index=True)
    keys, parents, segs = pdf["key"].tolist(), pdf["parent"].tolist(), [list(s) for s in pdf["seg"]]
    at = {k: i for i, k in enumerate(keys)}
    n = len(keys)
    up = [at.get(p, -1) if p is not None else -1 for p in parents]
    state, exits, out = [0] * n, [None] * n, [None] * n
    ring_id, ring = [None] * n, [None] * n
    for start in range(n):
        if state[start]:
            continue
        walk, v = [], start
        while v >= 0 and state[v] == 0:
            state[v] = 1
            walk.append(v)
            v = up[v]
        if v >= 0 and state[v] == 1:  # the walk came back to itself
            members = walk[walk.index(v):]
            name = min(k for m in members for k in segs[m])
            for m in members:
                out[m], ring_id[m], ring[m], state[m] = [keys[m]], name, segs[m], 2
            walk = walk[: len(walk) - len(members)]
        for v in reversed(walk):
            p = up[v]
            if p < 0:
                exits[v], out[v] = parents[v], segs[v]
            else:
                exits[v], out[v] = exits[p], out[p] + segs[v]
            state[v] = 2
    yield pd.DataFrame({"key": keys, "exit": exits, "seg": out, "ring_id": ring_id, "ring": ring}, dtype=object)


@dataclass
class Hierarchy:
    """``paths``: key, path, depth, root, ring_id. ``rings``: ring_id, key."""

    paths: DataFrame
    rings: DataFrame

    def pairs(self) -> DataFrame:
        """(ancestor, key), one row for each node and each of its ancestors.

        Each member of a ring is an ancestor of all its members, itself included, and of
        every node below.
        """
        above = self.paths.select(
            F.explode(F.when(F.col("ring_id").isNull(), F.slice("path", 1, F.size("path") - 1)).otherwise(
                F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0))))).alias("ancestor"),
            "key",
        )
        below = self.paths.filter("ring_id is not null").select("ring_id", "key")
        return above.unionByName(below.join(self.rings.select("ring_id", F.col("key").alias("ancestor")), "ring_id").select("ancestor", "key"))

    def summary(self) -> DataFrame:
        """paths plus ``n_descendants`` (distinct nodes below; a ring member counts itself)."""
        n = self.pairs().groupBy(F.col("ancestor").alias("key")).agg(F.count(F.lit(1)).alias("n_descendants"))
        return self.paths.join(n, "key", "left").withColumn("n_descendants", F.coalesce("n_descendants", F.lit(0)))


def _solve(nodes: DataFrame, fragment_rows: int, rings: list[DataFrame], level: int) -> DataFrame:
    """nodes: key, parent (null at a root), seg. Returns key, path. A fragment has ``fragment_rows`` nodes on average."""
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("kids"))
    inner = materialise(nodes.join(kids, "key"), f"inner{level}")
    leaves = nodes.join(kids, "key", "left_anti")
    whole = max(1, -(-inner.count() // fragment_rows))
    # The links as given are always cut, one fragment a core at least; only a quotient may fit one.
    fragments = max(whole, nodes.sparkSession.sparkContext.defaultParallelism) if level == 0 else whole
    # A coin per node and round: children of a "centre" that are none themselves share its fragment.
    centre = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(2)) == 0
    broods = inner.select(F.col("key").alias("parent"), (F.floor((F.col("kids") - 1) / TOGETHER) + 1).alias("broods"))
    salt = F.pmod(F.xxhash64("key", F.lit(-1 - level)), F.col("broods"))
    own = F.when(centre(F.col("parent")) & ~centre(F.col("key")), F.when(salt > 0, F.concat_ws("#", "parent", salt)).otherwise(F.col("parent"))).otherwise(F.col("key"))
    split = inner.join(broods, "parent", "left").select(F.pmod(F.xxhash64(own), F.lit(fragments)).cast("int").alias("fragment"), "key", "parent", "seg")
    chains = materialise(split.repartitionById(fragments, "fragment").mapInPandas(_followed, _CHAIN), f"chains{level}")
    rings.append(chains.filter("ring is not null").select("ring_id", F.explode("ring").alias("key")))
    if fragments == 1:
        solved = chains.select("key", F.col("seg").alias("path"))
    else:
        exits = chains.filter("exit is not null").select(F.col("exit").alias("key")).distinct()
        quotient = chains.join(exits, "key", "left_semi").select("key", F.col("exit").alias("parent"), "seg")
        top = _solve(materialise(quotient, f"quotient{level}"), fragment_rows, rings, level + 1)
        hung = chains.join(exits, "key", "left_anti")
        solved = (
            top.unionByName(hung.filter("exit is null").select("key", F.col("seg").alias("path")))
            .unionByName(hung.join(top.select(F.col("key").alias("exit"), "path"), "exit").select("key", F.concat("path", "seg").alias("path")))
        )
        solved = materialise(solved, f"solved{level}")
    hanging = leaves.filter("parent is not null").join(solved.select(F.col("key").alias("parent"), "path"), "parent")
    return (
        solved.unionByName(leaves.filter("parent is null").select("key", F.col("seg").alias("path")))
        .unionByName(hanging.select("key", F.concat("path", "seg").alias("path")))
    )


def hierarchy(nodes: DataFrame, key: str = "key", parent: str = "parent", fragment_rows: int = FRAGMENT_ROWS) -> Hierarchy:
    """Full hierarchy of a parent-child table of unknown depth.

    nodes: one or more rows per ``key`` (other columns are ignored). Rows without key are
    no nodes; repeated rows count once; if a key states several parents the smallest counts
    (``conflicts`` lists the others); a parent that is no key is no link; a node that names itself is a ring of one. An empty
    table gives an empty hierarchy.

    Returns path (array, root first, the node itself last), depth (0 at a root), root and
    ``ring_id``. On a ring there is no root: its members have themselves as path and depth 0,
    nodes below start from the member they hang from, and ``ring_id`` (the smallest member)
    tells both.
    """
    links = nodes.select(F.col(key).cast("string").alias("key"), F.col(parent).cast("string").alias("parent")).filter("key is not null")
    links = links.groupBy("key").agg(F.min("parent").alias("parent"))
    known = links.select(F.col("key").alias("parent"), F.lit(True).alias("known"))
    links = links.join(known, "parent", "left").select("key", F.when(F.col("known"), F.col("parent")).alias("parent"), F.array("key").alias("seg"))
    rings: list[DataFrame] = []
    paths = materialise(_solve(materialise(links, "links"), fragment_rows, rings, 0), "paths")
    ring = rings[0]
    for more in rings[1:]:
        ring = ring.unionByName(more)
    ring = materialise(ring, "rings")
    # Below a ring that spanned fragments a path may run along the ring first: cut it at the last member.
    paths = paths.withColumn("root", F.element_at("path", 1)).join(ring.select(F.col("key").alias("root"), "ring_id"), "root", "left")
    looped = paths.filter("ring_id is not null").select("key", "path", F.posexplode("path").alias("i", "member"))
    last = looped.join(ring.select(F.col("key").alias("member")), "member").groupBy("key").agg(F.max("i").alias("i"))
    paths = paths.join(last, "key", "left").withColumn("path", F.when(F.col("i").isNull(), F.col("path")).otherwise(F.expr("slice(path, i + 1, size(path))")))
    paths = paths.select("key", "path", (F.size("path") - 1).alias("depth"), F.element_at("path", 1).alias("root"), "ring_id")
    return Hierarchy(paths, ring)


def plain_name(c):
    """Form in which two spellings of a name are equal: trimmed, lower case, ``_`` and ``-`` as blanks."""
    return F.lower(F.regexp_replace(F.translate(c, "_-", "  "), r"(?U)^\s+|\s+$", ""))


def conflicts(statements: DataFrame, key: str = "key", parent: str = "parent") -> DataFrame:
    """key, kept, parent: every stated parent that a hierarchy does not follow, and the one it follows instead.

    Repeated statements count once; a key with one parent, or none, gives no row.
    """
    said = statements.select(F.col(key).alias("key"), F.col(parent).alias("parent")).filter("key is not null and parent is not null").distinct()
    kept = said.groupBy("key").agg(F.min("parent").alias("kept"), F.max("parent").alias("last")).filter("kept < last").drop("last")
    return said.join(kept, "key").filter("parent > kept").select("key", "kept", "parent")


def person_statements(persons: DataFrame) -> DataFrame:
    """key, parent (both plain names): every statement of a teacher or student in any row of a persons table.

    ``names[0]`` is the person; teacher and students may use any alias, of several persons
    with it the first counts. Statements of students are turned round. Names of no row are no link.
    """
    rows = persons.select("names", "teacher", "students").withColumn("key", plain_name(F.get("names", F.lit(0)))).filter("key is not null")
    alias = rows.select(F.explode(F.transform("names", plain_name)).alias("alias"), "key").filter("alias is not null").groupBy("alias").agg(F.min("key").alias("person"))
    taught = rows.select("key", plain_name(F.col("teacher")).alias("alias"), F.lit(False).alias("turned"))
    teaches = rows.select("key", F.explode(F.transform("students", plain_name)).alias("alias"), F.lit(True).alias("turned"))
    said = taught.unionByName(teaches).filter("alias != ''").join(alias, "alias")
    return said.select(F.when(F.col("turned"), F.col("person")).otherwise(F.col("key")).alias("key"), F.when(F.col("turned"), F.col("key")).otherwise(F.col("person")).alias("parent"))


def person_links(persons: DataFrame) -> DataFrame:
    """key, parent (both plain names), label: a row a person, from all rows of a persons table.

    Of several stated parents the smallest is kept; ``conflicts(person_statements(persons))`` lists the others.
    """
    rows = persons.select("names", "row_no").withColumn("key", plain_name(F.get("names", F.lit(0)))).filter("key is not null")
    label = rows.groupBy("key").agg(F.min_by(F.get("names", F.lit(0)), "row_no").alias("label"))
    parent = person_statements(persons).groupBy("key").agg(F.min("parent").alias("parent"))
    return label.join(parent, "key", "left").select("key", "parent", "label")


def latest_state(rows: DataFrame, key: str = "id", version: str = "modifiedUtc", arrival: str = "row_no") -> DataFrame:
    """The row of each key with the latest version; ties go to the first arrival. Rows without key all stay."""
    w = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), F.col(arrival))
    keyed = rows.filter(F.col(key).isNotNull()).withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
    return keyed.unionByName(rows.filter(F.col(key).isNull()))


def collection_links(collections: DataFrame) -> DataFrame:
    """key, parent (trimmed, lower case), label, from the latest state of each collection."""
    fold = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    now = latest_state(collections.select("id", "parentCollectionId", "modifiedUtc", "row_no")).filter("id is not null")
    return now.groupBy(fold(F.col("id")).alias("key")).agg(
        F.min_by(fold(F.col("parentCollectionId")), "id").alias("parent"), F.min("id").alias("label"))


_BREAK = "\x01"


def forest(trees: dict[str, DataFrame], fragment_rows: int = FRAGMENT_ROWS) -> Hierarchy:
    """The hierarchy of several tables of links (key, parent) at once; its keys have the tree's name and a break before them."""
    tagged = [t.select(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(name + _BREAK), c)).alias(c) for c in ("key", "parent")]) for name, t in trees.items()]
    return hierarchy(reduce(DataFrame.unionByName, tagged), fragment_rows=fragment_rows)


def tree_of(c: str) -> Column:
    """The tree's name in a key of a forest."""
    return F.substring_index(c, _BREAK, 1)


def bare_key(c: str | Column) -> Column:
    """A key of a forest without the tree's name."""
    return F.substr(c, F.instr(c, _BREAK) + 1)


def labelled_pairs(trees: dict[str, DataFrame], fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """tree, ancestor_key, node_key with the labels of ``trees`` (key, parent, label; unique keys) in place of the folded keys."""
    trees = {name: materialise(t, "labelled") for name, t in trees.items()}
    pairs = forest(trees, fragment_rows).pairs()
    names = reduce(DataFrame.unionByName, [t.select(F.concat(F.lit(name + _BREAK), "key").alias("key"), "label") for name, t in trees.items()])
    return (
        pairs.join(names.select(F.col("key"), F.col("label").alias("node_key")), "key")
        .join(names.select(F.col("key").alias("ancestor"), F.col("label").alias("ancestor_key")), "ancestor")
        .select(tree_of("key").alias("tree"), "ancestor_key", "node_key")
    )

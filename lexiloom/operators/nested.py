"""Deeply nested records to related flat tables.

Every object gets a Merkle identity: the hash of its own scalar fields, in name order,
and of its children's identities. Equal subtrees so have equal identities and are kept
once; where each of them occurs is kept in bridge rows (root, parent, ordinals).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entity of the records themselves.
ROOT = "(root)"

_ROWS = "array<struct<entity:string,ordinals:array<int>,parent_id:string,object_id:string,body:string>>"
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "allowNonNumericNumbers": "true"}
_NESTED = (T.ArrayType, T.StructType)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _by_key(a: Column, b: Column) -> Column:
    return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)


def _viewed(v: Column, kind: T.DataType, element: bool = False) -> tuple[Column, T.DataType]:
    """A value and its type as objects and lists: a map as the list of its entries in key order, a list in a list as an object with ``items``."""
    if isinstance(kind, T.VariantType):
        v, kind = F.to_json(v), T.StringType()
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        v, kind = F.array_sort(F.map_entries(v), _by_key), T.ArrayType(entry)
    if element and isinstance(kind, T.ArrayType):
        return F.when(v.isNotNull(), F.struct(v.alias("items"))), T.StructType([T.StructField("items", kind)])
    return v, kind


def _fields(kind: T.StructType) -> list[tuple[str, T.DataType]]:
    """Names and viewed types of the fields."""
    return [(f.name, _viewed(F.lit(None), f.dataType)[1]) for f in kind.fields]


def _element(kind: T.ArrayType) -> T.DataType:
    return _viewed(F.lit(None), kind.elementType, True)[1]


def _annotated(y: Column, kind: T.DataType, at: str) -> Column:
    """struct(id, body, rows) of a viewed value that is not null.

    body: JSON with the fields in name order and arrays of elements as arrays of their
    identities; id: its hash; rows: all non-null elements and objects below, places counted from here.
    Null and missing fields are the same, empty arrays are not null.
    """
    if not isinstance(kind, T.StructType):
        return _let(F.to_json(F.struct(y.alias("value")), _JSON), lambda b: F.struct(F.sha2(b, 256).alias("id"), b.alias("body"), F.array().cast(_ROWS).alias("rows")))
    views = {f.name: _viewed(y.getField(f.name), f.dataType) for f in kind.fields}
    name = {f: f"{at}.{f}" if at else f for f in views}
    nested = [f for f, (_, k) in views.items() if isinstance(k, _NESTED)]

    def child(f: str) -> Column:
        v, k = views[f]
        if isinstance(k, T.StructType):
            return F.when(v.isNotNull(), _annotated(v, k, name[f]))

        def each(z: Column) -> Column:
            e, kind_of = _viewed(z, k.elementType, True)
            return F.when(z.isNotNull(), _annotated(e, kind_of, name[f]))

        return F.transform(v, each)

    def part(f: str, kids: Column) -> Column:
        v, k = views[f]
        if isinstance(k, T.ArrayType):
            return F.transform(kids.getField(f), lambda a: a["id"]).alias(f)
        if isinstance(k, T.StructType):
            return kids.getField(f)["id"].alias(f)
        return v.alias(f)

    def below(f: str, kids: Column, own: Column) -> Column:
        def each(a: Column, i: Column | None) -> Column:
            here = F.array().cast("array<int>") if i is None else F.array(i)
            row = F.struct(F.lit(name[f]).alias("entity"), here.alias("ordinals"), own.alias("parent_id"), a["id"].alias("object_id"), a["body"].alias("body"))
            deeper = F.transform(a["rows"], lambda r: F.struct(r["entity"].alias("entity"), (r["ordinals"] if i is None else F.concat(here, r["ordinals"])).alias("ordinals"), r["parent_id"].alias("parent_id"), r["object_id"].alias("object_id"), r["body"].alias("body")))
            return F.when(a.isNotNull(), F.concat(F.array(row), deeper)).otherwise(F.array().cast(_ROWS))

        if isinstance(views[f][1], T.StructType):
            return each(kids.getField(f), None)
        return F.coalesce(F.flatten(F.transform(kids.getField(f), each)), F.array().cast(_ROWS))

    def whole(kids: Column) -> Column:
        body = F.to_json(F.struct(*[part(f, kids) for f in sorted(views)] or [F.lit(None).alias("none")]), _JSON)
        return _let(body, lambda b: _let(F.sha2(b, 256), lambda own: F.struct(
            own.alias("id"), b.alias("body"), (F.concat(*[below(f, kids, own) for f in nested]) if nested else F.array().cast(_ROWS)).alias("rows"))))

    return _let(F.struct(*[child(f).alias(f) for f in nested] or [F.lit(0).alias("none")]), whole)


@dataclass
class FlatTables:
    """bridge: root_key, entity, ordinals, parent_id, object_id. objects: entity, object_id, body."""

    occurrences: DataFrame
    kinds: dict[str, T.DataType]

    @property
    def bridge(self) -> DataFrame:
        """One row per occurrence of a non-null element or object, and per record (entity ROOT, no parent), repeated ones included."""
        return self.occurrences.drop("body")

    @property
    def objects(self) -> DataFrame:
        """Each distinct object once. ``body`` holds scalar fields and the children's identities."""
        return self.occurrences.groupBy("entity", "object_id").agg(F.first("body").alias("body"))

    def table(self, entity: str) -> DataFrame:
        """The flat table of one entity: an occurrence a row, typed scalar columns, and the way back to its parent."""
        kind = self.kinds[entity]
        if isinstance(kind, T.StructType):
            own = T.StructType([T.StructField(f, k) for f, k in _fields(kind) if not isinstance(k, _NESTED)])
        else:
            own = T.StructType([T.StructField("value", kind)])
        rows = self.occurrences.filter(F.col("entity") == entity)
        cols = [F.col("_v").getField(f.name).alias(f"field_{f.name}" if f.name in ("root_key", "ordinals", "parent_id", "object_id") else f.name) for f in own.fields]
        return rows.withColumn("_v", F.from_json("body", own, _JSON)).select("root_key", "ordinals", "parent_id", "object_id", *cols)


def flatten_nested(rows: DataFrame, key: str) -> FlatTables:
    """Flat tables of all arrays, maps and objects of ``rows``, at any depth, as the schema has them.

    Entities are named by path (``passages.tags``); the records themselves are entity ROOT,
    whose rows have no parent. ``ordinals`` are the positions from 0, outer array first; an
    object that is no element has those of what it lies in. Entries of a map are objects of
    ``key`` and ``value``, placed in key order; an array in an array is an object whose
    ``items`` are elements below it; a variant is its JSON text. Null elements keep their
    position and give no row; null and empty arrays and null objects give none. Rows with a
    null key stay, with a null ``root_key``. A table without rows gives empty tables, one
    without arrays only records. One pass over the rows, without shuffle.
    """
    kinds: dict[str, T.DataType] = {ROOT: rows.schema}

    def collect(kind: T.StructType, at: str) -> None:
        for f, k in _fields(kind):
            if isinstance(k, _NESTED):
                name = f"{at}.{f}" if at else f
                kinds[name] = _element(k) if isinstance(k, T.ArrayType) else k
                if isinstance(kinds[name], T.StructType):
                    collect(kinds[name], name)

    collect(rows.schema, "")
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])

    def every(a: Column) -> Column:
        record = F.struct(F.lit(ROOT).alias("entity"), F.array().cast("array<int>").alias("ordinals"), F.lit(None).cast("string").alias("parent_id"), a["id"].alias("object_id"), a["body"].alias("body"))
        return F.concat(F.array(record), a["rows"])

    found = F.explode(_let(_annotated(whole, rows.schema, ""), every)).alias("o")
    occurrences = rows.select(F.col(f"`{key}`").cast("string").alias("root_key"), found).select("root_key", "o.*")
    return FlatTables(occurrences, kinds)

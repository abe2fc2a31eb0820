"""Mutations: each gives a new snapshot, the old one stays as it is."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.snapshot import Snapshot, body_type, end_columns
from ..plans.types import (
    EDGE_ENDS, EXTRA, Aborted, EdgeBodyError, EdgeType, GraphSchema, IntegrityError, Kind, NotFound, SchemaError, TransactionError, ValidationError,
)


def check_fields(group: GraphSchema, data: Mapping, error: type[Exception]) -> dict:
    """The row of declared fields and JSON extras; raises where a mandatory field is missing."""
    if not isinstance(data, Mapping):
        raise ValidationError(f"{group.name}: data is a map of fields, not {type(data).__name__}")
    if hidden := [k for k in data if k.startswith("_")]:
        raise ValidationError(f"{group.name}: names that start with _ are reserved: {hidden}")
    names = group.field_names()
    if missing := [f.name for f in group.fields if not f.nullable and data.get(f.name) is None]:
        raise error(f"{group.name}: missing fields: {missing}")
    extra = {k: v for k, v in data.items() if k not in names}
    if extra and not group.is_dynamic:
        raise ValidationError(f"{group.name}: undeclared fields: {sorted(extra)}")
    row = {n: data.get(n) for n in names}
    return row | ({EXTRA: json.dumps(extra) if extra else None} if group.is_dynamic else {})


def _one_row(snapshot: Snapshot, fields: list[T.StructField], row: Mapping) -> DataFrame:
    return snapshot.spark.createDataFrame([tuple(row.get(f.name) for f in fields)], T.StructType(fields))


def has_vertex(snapshot: Snapshot, group: str, key) -> bool:
    found = snapshot.catalog.need(group, Kind.VERTEX)
    return snapshot.vertices[found.name].where(F.col(found.key) == F.lit(key)).limit(1).count() > 0


def new_vertex(snapshot: Snapshot, group, data: Mapping) -> tuple[Snapshot, object]:
    """The snapshot with one vertex more, and its key."""
    found = snapshot.catalog.need(group, Kind.VERTEX)
    row = check_fields(found, data, ValidationError)
    if found.key_field:
        if has_vertex(snapshot, found.name, row[found.key]):
            raise ValidationError(f"{found.name}: there is a vertex {row[found.key]!r}")
    else:
        row["_id"] = uuid.uuid4().hex
    old = snapshot.vertices[found.name]
    made = _one_row(snapshot, list(old.schema.fields), row)
    return snapshot.with_vertices(found.name, old.unionByName(made)), row[found.key]


def new_vertices(snapshot: Snapshot, group, rows: DataFrame) -> Snapshot:
    """Many vertices at once; keys that are there already, or repeat, raise."""
    found = snapshot.catalog.need(group, Kind.VERTEX)
    old, key = snapshot.vertices[found.name], found.key
    keys = old.select(key).unionAll(rows.select(key))
    if keys.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).limit(1).count():
        raise ValidationError(f"{found.name}: null or repeated keys")
    return snapshot.with_vertices(found.name, old.unionByName(rows, allowMissingColumns=True))


def read_vertex(snapshot: Snapshot, group, key) -> dict | None:
    """A vertex's fields, undeclared ones among them; None when it isn't there."""
    found = snapshot.catalog.need(group, Kind.VERTEX)
    got = snapshot.vertices[found.name].where(F.col(found.key) == F.lit(key)).limit(1).collect()
    return flat(got[0].asDict()) if got else None


def flat(row: dict) -> dict:
    extra = row.pop(EXTRA, None)
    return row | (json.loads(extra) if extra else {})


def update_vertex(snapshot: Snapshot, group, key, change: Callable[[dict], Mapping | None]) -> Snapshot:
    """The vertex as ``change`` gives it; aborts when it is missing or ``change`` gives None."""
    found = snapshot.catalog.need(group, Kind.VERTEX)
    before = read_vertex(snapshot, found.name, key)
    after = change(dict(before)) if before is not None else None
    if after is None:
        raise Aborted(f"{found.name}: no update of {key!r}")
    after = {k: v for k, v in after.items() if k != "_id"}
    if found.key_field and after.get(found.key) != before[found.key]:
        raise ValidationError(f"{found.name}: the key of {key!r} can't change")
    row = check_fields(found, after, ValidationError)
    old = snapshot.vertices[found.name]
    this = F.col(found.key) == F.lit(key)
    kinds = {f.name: f.dataType for f in old.schema.fields}
    changed = {n: F.when(this, F.lit(v).cast(kinds[n])).otherwise(F.col(n)) for n, v in row.items() if v != before.get(n) or n == EXTRA}
    return snapshot.with_vertices(found.name, old.withColumns(changed))


def update_vertices(snapshot: Snapshot, group, where: Column, changes: Mapping[str, Column]) -> Snapshot:
    """Set columns where a condition holds, in one pass and without Python."""
    found = snapshot.catalog.need(group, Kind.VERTEX)
    if found.key in changes:
        raise ValidationError(f"{found.name}: keys can't change")
    old = snapshot.vertices[found.name]
    hit = F.coalesce(where, F.lit(False))
    return snapshot.with_vertices(found.name, old.withColumns({n: F.when(hit, c).otherwise(F.col(n)) for n, c in changes.items()}))


def remove_vertices(snapshot: Snapshot, group, keys: list | DataFrame) -> Snapshot:
    """Vertices and all edges that touch them, whichever groups the edges belong to."""
    found = snapshot.catalog.need(group, Kind.VERTEX)

    def without(df: DataFrame, column: str, schema: str | None = None) -> DataFrame:
        mine = F.lit(True) if schema is None else F.col(schema) == found.name
        if isinstance(keys, list):
            return df.where(~F.coalesce(mine & F.col(column).isin(keys), F.lit(False)))
        gone = keys.select(F.col(keys.columns[0]).alias("_gone")).distinct()
        return df.join(gone, mine & (F.col(column) == F.col("_gone")), "left_anti")

    out = snapshot.with_vertices(found.name, without(snapshot.vertices[found.name], found.key))
    for name, df in snapshot.edges.items():
        a, b = snapshot.ends.get(name, (frozenset(), frozenset()))
        if found.name in a:
            df = without(df, "a_key", "a_schema")
        if found.name in b:
            df = without(df, "b_key", "b_schema")
        out = out.with_edges(name, df)
    return out


def remove_vertex(snapshot: Snapshot, group, key) -> Snapshot:
    if not has_vertex(snapshot, group, key):
        raise NotFound(f"no vertex {key!r}")
    return remove_vertices(snapshot, group, [key])


def _edge_group(snapshot: Snapshot, group) -> GraphSchema:
    return snapshot.catalog.need(group, Kind.EDGE)


def _fit_ends(df: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both frames with keys of one type; a group without rows yet takes the new keys' types."""
    for c in ("a_key", "b_key"):
        x, y = dict(df.dtypes)[c], dict(made.dtypes)[c]
        if x != y:
            kind = y if x == "void" else x if y in ("int", "bigint", "smallint") and x in ("int", "bigint", "smallint") else "string"
            df, made = df.withColumn(c, F.col(c).cast(kind)), made.withColumn(c, F.col(c).cast(kind))
    return df, made


def link(snapshot: Snapshot, source: tuple, group, target: tuple, body: Mapping | None = None) -> Snapshot:
    """One edge more from ``source`` to ``target``, each (vertex group, key).

    A group with bodies needs one and another must not have one (a rule of the graph); a body
    without its mandatory fields fails the transaction.
    """
    found = _edge_group(snapshot, group)
    if found.edge.has_body and body is None:
        raise EdgeBodyError(f"{found.name}: an edge of this group has a body")
    if not found.edge.has_body and body is not None:
        raise EdgeBodyError(f"{found.name}: an edge of this group has no body")
    row = check_fields(found, body, TransactionError) if body is not None else {}
    for name, key in (source, target):
        if not has_vertex(snapshot, name, key):
            raise NotFound(f"no vertex {key!r} in {name}")
    ends = dict(zip(EDGE_ENDS, (*source, *target), strict=True))
    kinds = [snapshot.vertices[n].schema[snapshot.catalog.need(n).key].dataType for n, _ in (source, target)]
    made = _one_row(snapshot, end_columns(*kinds) + list(body_type(found).fields), ends | row)
    old, made = _fit_ends(snapshot.edges[found.name], made)
    return snapshot.with_edges(found.name, old.unionByName(made), frozenset((source[0],)), frozenset((target[0],)))


def link_many(snapshot: Snapshot, group, rows: DataFrame, check: bool = True) -> Snapshot:
    """Many edges at once: rows of the four end columns and the body's. Missing ends raise."""
    found = _edge_group(snapshot, group)
    ends = []
    for x in ("a", "b"):
        names = [r[0] for r in rows.select(f"{x}_schema").distinct().collect()]  # names of groups
        ends.append(frozenset(names))
        for name in names if check else ():
            g = snapshot.catalog.need(name, Kind.VERTEX)
            known = snapshot.vertices[g.name].select(F.col(g.key).alias("_known"))
            lost = rows.where(F.col(f"{x}_schema") == name).join(known, F.col(f"{x}_key") == F.col("_known"), "left_anti")
            if lost.limit(1).count():
                raise IntegrityError(f"{found.name}: an end isn't in {name}")
    if need := [f.name for f in found.fields if not f.nullable]:
        if rows.where(reduce(lambda p, q: p | q, [F.col(n).isNull() for n in need])).limit(1).count():
            raise TransactionError(f"{found.name}: missing fields among {need}")
    old, made = _fit_ends(snapshot.edges[found.name], rows)
    return snapshot.with_edges(found.name, old.unionByName(made, allowMissingColumns=True), *ends)


def remove_edges(snapshot: Snapshot, group, where: Column) -> Snapshot:
    """Every edge for which a condition over the edge's columns holds."""
    found = _edge_group(snapshot, group)
    return snapshot.with_edges(found.name, snapshot.edges[found.name].where(~F.coalesce(where, F.lit(False))))


def remove_edge(snapshot: Snapshot, group, source: tuple, target: tuple, body: Mapping | None = None, every: bool = False) -> Snapshot:
    """One of the equal edges between two vertices, or every one; raises when there is none.

    Ends of an undirected edge may be named in either order. ``body`` narrows the choice.
    """
    found = _edge_group(snapshot, group)
    df = snapshot.edges[found.name]

    def between(p: tuple, q: tuple) -> Column:
        return (F.col("a_schema") == p[0]) & (F.col("a_key") == F.lit(p[1])) & (F.col("b_schema") == q[0]) & (F.col("b_key") == F.lit(q[1]))

    hit = between(source, target)
    if found.edge.edge_type is EdgeType.UNDIRECTED:
        hit = hit | between(target, source)
    for name, value in (body or {}).items():
        if name not in df.columns:
            raise SchemaError(f"{found.name}: no field {name}")
        hit = hit & F.col(name).eqNullSafe(F.lit(value))
    hit = F.coalesce(hit, F.lit(False))
    mine = df.where(hit)
    if not mine.limit(1).count():
        raise NotFound(f"{found.name}: no such edge")
    rest = df.where(~hit)
    if not every:  # the window only sees the equal edges
        order = Window.partitionBy(F.lit(0)).orderBy(*df.columns)
        rest = rest.unionByName(mine.withColumn("_rn", F.row_number().over(order)).where("_rn > 1").drop("_rn"))
    return snapshot.with_edges(found.name, rest)


def update_edges(snapshot: Snapshot, group, where: Column, changes: Mapping[str, Column]) -> Snapshot:
    found = _edge_group(snapshot, group)
    if set(changes) & set(EDGE_ENDS):
        raise ValidationError(f"{found.name}: the ends of an edge can't change")
    hit = F.coalesce(where, F.lit(False))
    df = snapshot.edges[found.name]
    return snapshot.with_edges(found.name, df.withColumns({n: F.when(hit, c).otherwise(F.col(n)) for n, c in changes.items()}))

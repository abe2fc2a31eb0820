"""Traversal over whole frames of anchors: edges, neighbourhoods, degree.

Every operator is one join with the incidence of an edge group; the reads of one pointer after
another that a single vertex would need are the one-row case. Nothing is deduplicated: edges
are a bag.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.filters import Cell, compile_filter
from ..plans.snapshot import Snapshot, body_type
from ..plans.types import EDGE_ENDS, Direction, EdgeType, GraphSchema, IntegrityError, Kind, SchemaError


class Keys(NamedTuple):
    """Anchors that are known by key: they become a filter, which reaches the files of the edges."""

    schema: str
    keys: tuple

    def frame(self, snapshot: Snapshot) -> DataFrame:
        group = snapshot.catalog.need(self.schema, Kind.VERTEX)
        kind = snapshot.vertices[group.name].schema[group.key].dataType
        rows = [(group.name, k) for k in self.keys]
        return snapshot.spark.createDataFrame(rows, T.StructType([T.StructField("v_schema", T.StringType()), T.StructField("v_key", kind)]))


def _edge_struct(group: GraphSchema, df: DataFrame) -> tuple[Column, list[str]]:
    """The body with its hidden ends, or null for an edge without a body."""
    if not group.edge.has_body:
        return F.lit(None).cast("string"), []
    ends = ("_inbound", "_outbound") if group.edge.edge_type is EdgeType.DIRECTED else ("_vertex_a", "_vertex_b")
    names = [c for c in df.columns if c not in EDGE_ENDS]
    return F.struct(F.col("a_key").alias(ends[0]), F.col("b_key").alias(ends[1]), *names), [*ends, *names]


def incidence(snapshot: Snapshot, group: GraphSchema, direction: Direction, anchors: DataFrame | Keys | None = None) -> tuple[DataFrame, list[str]]:
    """(v_schema, v_key, o_schema, o_key, a_*, b_*, edge), and the fields of ``edge``.

    A direction that doesn't fit the group gives no rows. An undirected edge is incident to
    both of its ends, a self-loop twice; without a body it is read from the vertex asked for.
    Only of ``anchors`` known by key are the edges not read as dealt out.
    """
    df = snapshot.edges[group.name]
    if group.name in snapshot.dealt and not isinstance(anchors, Keys):
        df = snapshot.dealt[group.name]()
    edge, names = _edge_struct(group, df)
    directed = group.edge.edge_type is EdgeType.DIRECTED
    if directed != (direction is not Direction.UNDIRECTED):
        df = df.where(F.lit(False))

    def seen(v: str, o: str) -> DataFrame:
        ends = [F.col(c) for c in EDGE_ENDS]
        if not directed and not group.edge.has_body:
            ends = [F.col(f"{x}_{c}").alias(f"{y}_{c}") for x, y in ((v, "a"), (o, "b")) for c in ("schema", "key")]
        return df.select(F.col(f"{v}_schema").alias("v_schema"), F.col(f"{v}_key").alias("v_key"), F.col(f"{o}_schema").alias("o_schema"), F.col(f"{o}_key").alias("o_key"), *ends, edge.alias("edge"))

    if not directed:
        return seen("a", "b").unionAll(seen("b", "a")), names
    return (seen("a", "b") if direction is Direction.OUTBOUND else seen("b", "a")), names


def _empty(snapshot: Snapshot) -> DataFrame:
    return snapshot.spark.createDataFrame([], "v_schema string, v_key string, o_schema string, o_key string, a_schema string, a_key string, b_schema string, b_key string, edge string")


def _edge_group(snapshot: Snapshot, group, strict: bool) -> GraphSchema | None:
    found = snapshot.catalog.find(group)
    if found is None or found.kind is not Kind.EDGE:
        if strict:
            snapshot.catalog.need(group, Kind.EDGE)
        return None
    return found


def _join_anchors(rows: DataFrame, anchors: DataFrame | Keys | None) -> DataFrame:
    if anchors is None:
        return rows
    if isinstance(anchors, Keys):
        key = F.col("v_key") == F.lit(anchors.keys[0]) if len(anchors.keys) == 1 else F.col("v_key").isin(*anchors.keys)
        return rows.where((F.col("v_schema") == F.lit(anchors.schema)) & key)
    keys = anchors.select(F.col("v_schema").alias("_schema"), F.col("v_key").alias("_key"))
    return rows.join(keys, (F.col("v_schema") == F.col("_schema")) & (F.col("v_key") == F.col("_key"))).drop("_schema", "_key")


def edges(snapshot: Snapshot, anchors: DataFrame | Keys | None, group, direction: Direction, where=None, strict: bool = False) -> DataFrame:
    """The edges of every anchor (v_schema, v_key); of all vertices when ``anchors`` is None.

    An unknown group has no edges unless ``strict``. The filter sees ``edge`` only.
    """
    found = _edge_group(snapshot, group, strict)
    if found is None:
        compile_filter(where, {"edge": Cell(None, [])})
        return _empty(snapshot)
    rows, names = incidence(snapshot, found, direction, anchors)
    keep = compile_filter(where, {"edge": Cell(F.col("edge") if names else None, names)})
    return _join_anchors(rows, anchors).where(keep)


def vertex_frame(snapshot: Snapshot, groups: list[str]) -> tuple[DataFrame, list[str]]:
    """(schema, key, vertex) of several groups; a field that a group lacks is null."""
    frames = []
    for name in groups:
        df, key = snapshot.vertices[name], snapshot.catalog.need(name).key
        frames.append(df.select(F.lit(name).alias("_o_schema"), F.col(key).alias("_o_key"), *[F.col(c).alias(f"f_{c}") for c in df.columns]))
    all_rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
    names = [c[2:] for c in all_rows.columns if c.startswith("f_")]
    return all_rows.select("_o_schema", "_o_key", F.struct(*[F.col(f"f_{c}").alias(c) for c in names]).alias("vertex")), names


def neighbourhoods(snapshot: Snapshot, anchors: DataFrame | Keys | None, group, direction: Direction, where=None, strict: bool = False) -> DataFrame:
    """``edges`` with the vertex at the other end, which is what the filter's ``vertex`` means.

    A pointer to a vertex that isn't there drops its row, or raises when ``strict``.
    """
    found = _edge_group(snapshot, group, strict)
    if found is None:
        compile_filter(where, {"edge": Cell(None, []), "vertex": Cell(None, [])})
        return _empty(snapshot).withColumn("vertex", F.lit(None).cast("string"))
    rows, names = incidence(snapshot, found, direction, anchors)
    rows = _join_anchors(rows, anchors)
    a, b = snapshot.ends.get(found.name, (frozenset(), frozenset()))
    ends = {Direction.OUTBOUND: b, Direction.INBOUND: a, Direction.UNDIRECTED: a | b}[direction]
    known = sorted(n for n in ends or snapshot.vertices if n in snapshot.vertices)
    if not known:
        return rows.where(F.lit(False)).withColumn("vertex", F.lit(None).cast("string"))
    right, fields = vertex_frame(snapshot, known)
    on = F.col("o_key") == F.col("_o_key")
    # one group at the other end: its name is a constant and needn't be joined on
    on = on if len(known) == 1 and known == sorted(ends) else on & (F.col("o_schema") == F.col("_o_schema"))
    if strict and rows.join(right, on, "left_anti").limit(1).count():
        raise IntegrityError(f"{found.name}: an edge leads to a vertex that isn't there")
    keep = compile_filter(where, {"edge": Cell(F.col("edge") if names else None, names), "vertex": Cell(F.col("vertex"), fields)})
    return rows.join(right, on).drop("_o_schema", "_o_key").where(keep)


def _dealt_ends(snapshot: Snapshot, group: GraphSchema, direction: Direction) -> DataFrame | None:
    """(v_schema, v_key, o_key) of both ends of an undirected group that is dealt out, which is done once for both.

    None for other groups, and where the keys of the ends differ in type.
    """
    if group.name not in snapshot.dealt or direction is not Direction.UNDIRECTED or group.edge.edge_type is EdgeType.DIRECTED:
        return None
    kinds = snapshot.edges[group.name].schema
    if kinds["a_key"].dataType != kinds["b_key"].dataType:
        return None
    ends = F.stack(F.lit(2), "a_schema", "a_key", "b_key", "b_schema", "b_key", "a_key")
    return snapshot.dealt[group.name]().select(ends.alias("v_schema", "v_key", "o_key"))


def degree(snapshot: Snapshot, anchors: DataFrame | Keys, group, direction: Direction) -> DataFrame:
    """(v_schema, v_key, degree) of every anchor; 0 for one without edges.

    The incidence is counted before it meets a frame of anchors, so a vertex of very many edges
    is summed where its edges lie; of anchors known by key only their own edges are counted.
    The group must be one of edges.
    """
    found = snapshot.catalog.need(group, Kind.EDGE)
    rows = None if isinstance(anchors, Keys) else _dealt_ends(snapshot, found, direction)
    if rows is None:
        rows, _ = incidence(snapshot, found, direction, anchors)
    if isinstance(anchors, Keys):
        rows, anchors = _join_anchors(rows, anchors), anchors.frame(snapshot)
    counts = rows.groupBy(F.col("v_schema").alias("_schema"), F.col("v_key").alias("_key")).agg(F.count("o_key").alias("n"))
    both = anchors.join(counts, (F.col("v_schema") == F.col("_schema")) & (F.col("v_key") == F.col("_key")), "left")
    return both.select("v_schema", "v_key", F.coalesce("n", F.lit(0).cast("long")).alias("degree"))


def opposite(rows: DataFrame) -> Column:
    """The other end of an edge seen from ``v_key``; null when neither end is the anchor."""
    is_a = (F.col("a_key") == F.col("v_key")) & (F.col("a_schema") == F.col("v_schema"))
    is_b = (F.col("b_key") == F.col("v_key")) & (F.col("b_schema") == F.col("v_schema"))
    return F.when(is_a, F.col("b_key")).when(is_b, F.col("a_key"))


def cell_types(snapshot: Snapshot, anchors: DataFrame | Keys | None, direction: Direction, groups: list | None = None) -> DataFrame:
    """(v_schema, v_key, direction, edge_schema): the groups in which an anchor has edges.

    Anchors known by key only read their own edges. A frame of anchors meets the vertices that
    have edges, each once; an anchor that repeats is listed once.
    """
    out = None
    for g in snapshot.catalog.groups if groups is None else [snapshot.catalog.need(g, Kind.EDGE) for g in groups]:
        if g.kind is not Kind.EDGE or (g.edge.edge_type is EdgeType.UNDIRECTED) != (direction is Direction.UNDIRECTED):
            continue
        rows = incidence(snapshot, g, direction, anchors)[0].select("v_schema", "v_key")
        rows = _join_anchors(rows, anchors).distinct() if isinstance(anchors, Keys) else _join_anchors(rows.distinct(), anchors)
        rows = rows.select("v_schema", "v_key", F.lit(direction.value).alias("direction"), F.lit(g.name).alias("edge_schema"))
        out = rows if out is None else out.unionAll(rows)
    if out is None:
        raise SchemaError(f"no edge group for {direction.value}")
    return out.distinct()


def select_vertices(snapshot: Snapshot, group, where=None) -> DataFrame:
    """The vertices of a group that a filter over ``vertex`` keeps, in the group's own columns."""
    found = snapshot.catalog.need(group, Kind.VERTEX)
    df = snapshot.vertices[found.name]

    class Columns(Cell):
        def __init__(self):
            super().__init__({c: F.col(c) for c in df.columns}, df.columns)

    return df.where(compile_filter(where, {"vertex": Columns()}))


def body_columns(group: GraphSchema) -> list[str]:
    return [f.name for f in body_type(group)]

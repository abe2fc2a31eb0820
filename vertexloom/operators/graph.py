"""The graph: one current snapshot, changed by transactions that apply whole or not at all."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.catalog import Catalog
from ..plans.snapshot import Snapshot, body_type, end_columns
from ..plans.types import Aborted, Direction, EdgeAttributes, GraphSchema, Kind, NotFound, TransactionError
from . import mutate, traversal


#: Keys of anchors that a filter holds; more are joined.
FILTER_KEYS = 1000


class VertexId(NamedTuple):
    schema: str
    key: object


class Vertex(dict):
    """A vertex's fields by name, with its id."""

    def __init__(self, id: VertexId, fields: Mapping):
        super().__init__(fields)
        self.id = id


class GraphView:
    """What can be read and staged; shared by the graph and its transactions."""

    snapshot: Snapshot

    def _set(self, snapshot: Snapshot) -> None:
        self.snapshot = snapshot

    # ids and anchors
    def id_of(self, vertex) -> VertexId:
        return vertex.id if isinstance(vertex, Vertex) else VertexId(*vertex)

    def anchors(self, vertices) -> DataFrame:
        """(v_schema, v_key) of a Vertex, an id, a group's name, (group, [keys]) or a frame."""
        if isinstance(vertices, DataFrame):
            return vertices.select("v_schema", "v_key")
        if isinstance(vertices, str):
            g = self.snapshot.catalog.need(vertices, Kind.VERTEX)
            return self.snapshot.vertices[g.name].select(F.lit(g.name).alias("v_schema"), F.col(g.key).alias("v_key"))
        return self._keys(vertices).frame(self.snapshot)

    def _keys(self, vertices) -> traversal.Keys:
        name, keys = self.id_of(vertices)
        return traversal.Keys(self.snapshot.catalog.need(name, Kind.VERTEX).name, tuple(keys) if isinstance(keys, list) else (keys,))

    def _anchors(self, vertices) -> DataFrame | traversal.Keys:
        """``anchors``, but vertices named by key stay keys: so few that a filter can hold them, each once."""
        if isinstance(vertices, (str, DataFrame)):
            return self.anchors(vertices)
        keys = self._keys(vertices)
        plain = 0 < len(keys.keys) <= FILTER_KEYS and None not in keys.keys and len(set(keys.keys)) == len(keys.keys)
        return keys if plain else keys.frame(self.snapshot)

    # schemas
    def new_vertex_group(self, schema: GraphSchema) -> int:
        catalog, made = self.snapshot.catalog.add(schema, Kind.VERTEX)
        empty = self.snapshot.spark.createDataFrame([], body_type(made))
        self._set(self.snapshot.with_catalog(catalog).with_vertices(made.name, empty))
        return made.id

    def new_edge_group(self, schema: GraphSchema, attributes: EdgeAttributes) -> int:
        catalog, made = self.snapshot.catalog.add(schema, Kind.EDGE, attributes)
        empty = self.snapshot.spark.createDataFrame([], T.StructType(end_columns(T.NullType(), T.NullType()) + list(body_type(made).fields)))
        self._set(self.snapshot.with_catalog(catalog).with_edges(made.name, empty))
        return made.id

    def group_schema(self, group) -> T.StructType | None:
        """The columns that a group's own fields are stored in; None for an unknown group."""
        found = self.snapshot.catalog.find(group)
        return None if found is None else body_type(found)

    def subscribe(self, tell: Callable[[str, GraphSchema], None]) -> None:
        """``tell("added" or "deleted", group)`` from now on, whenever a group comes or goes."""
        self._set(self.snapshot.with_catalog(self.snapshot.catalog.subscribe(tell)))

    def drop_group(self, group) -> None:
        name = self.snapshot.catalog.need(group).name
        self._set(self.snapshot.with_catalog(self.snapshot.catalog.drop(group)).without(name))

    # vertices
    def new_vertex(self, group, data: Mapping) -> Vertex:
        snapshot, key = mutate.new_vertex(self.snapshot, group, data)
        self._set(snapshot)
        return Vertex(VertexId(snapshot.catalog.need(group).name, key), dict(data))

    def new_vertices(self, group, rows: DataFrame) -> None:
        self._set(mutate.new_vertices(self.snapshot, group, rows))

    def vertex_by(self, vertex) -> Vertex | None:
        return self.vertex_by_key(*self.id_of(vertex))

    def vertex_by_key(self, group, key) -> Vertex | None:
        found = mutate.read_vertex(self.snapshot, group, key)
        return None if found is None else Vertex(VertexId(self.snapshot.catalog.need(group).name, key), found)

    def vertices(self, group, where=None, keys: list | DataFrame | None = None) -> DataFrame:
        """A group's vertices: all, those a filter keeps, those of some keys."""
        df, key = traversal.select_vertices(self.snapshot, group, where), self.snapshot.catalog.need(group).key
        if isinstance(keys, list):
            return df.where(F.col(key).isin(keys))
        if keys is not None:
            return df.join(keys.select(F.col(keys.columns[0]).alias(key)), key, "left_semi")
        return df

    def update_vertex(self, vertex, change: Callable[[dict], Mapping | None]) -> None:
        self.update_vertex_by_key(*self.id_of(vertex), change)

    def update_vertex_by_key(self, group, key, change: Callable[[dict], Mapping | None]) -> None:
        self._set(mutate.update_vertex(self.snapshot, group, key, change))

    def update_vertices(self, group, where, changes: Mapping) -> None:
        self._set(mutate.update_vertices(self.snapshot, group, where, changes))

    def remove_vertex(self, vertex) -> None:
        self.remove_vertex_by_key(*self.id_of(vertex))

    def remove_vertex_by_key(self, group, key) -> None:
        self._set(mutate.remove_vertex(self.snapshot, group, key))

    def remove_vertices(self, group, keys: list | DataFrame) -> None:
        self._set(mutate.remove_vertices(self.snapshot, group, keys))

    # edges
    def link(self, source, group, target, body: Mapping | None = None) -> None:
        self._set(mutate.link(self.snapshot, self.id_of(source), group, self.id_of(target), body))

    def link_many(self, group, rows: DataFrame, check: bool = True) -> None:
        self._set(mutate.link_many(self.snapshot, group, rows, check))

    def remove_edge(self, group, source, target, body: Mapping | None = None, every: bool = False) -> None:
        self._set(mutate.remove_edge(self.snapshot, group, self.id_of(source), self.id_of(target), body, every))

    def remove_edges(self, group, where) -> None:
        self._set(mutate.remove_edges(self.snapshot, group, where))

    def update_edges(self, group, where, changes: Mapping) -> None:
        self._set(mutate.update_edges(self.snapshot, group, where, changes))

    # traversal
    def _checked(self, vertices, strict: bool) -> DataFrame | traversal.Keys | None:
        if vertices is None:
            return None
        if strict and not isinstance(vertices, (str, DataFrame)):
            name, key = self.id_of(vertices)
            if not isinstance(key, list) and not mutate.has_vertex(self.snapshot, name, key):
                raise NotFound(f"no vertex {key!r} in {name}")
        return self._anchors(vertices)

    def edges(self, vertices, group, direction: Direction, where=None, strict: bool = False) -> DataFrame:
        return traversal.edges(self.snapshot, self._checked(vertices, strict), group, direction, where, strict)

    def neighbourhoods(self, vertices, group, direction: Direction, where=None, strict: bool = False) -> DataFrame:
        return traversal.neighbourhoods(self.snapshot, self._checked(vertices, strict), group, direction, where, strict)

    def degrees(self, vertices, group, direction: Direction) -> DataFrame:
        return traversal.degree(self.snapshot, self._anchors(vertices), group, direction)

    def degree(self, vertex, group, direction: Direction) -> int:
        """The degree of one vertex, which must be there."""
        self.snapshot.catalog.need(group, Kind.EDGE)
        self._checked(vertex, True)
        return self.degrees(vertex, group, direction).first()["degree"]

    def cell_types(self, vertices, direction: Direction, groups: list | None = None) -> DataFrame:
        return traversal.cell_types(self.snapshot, None if vertices is None else self._anchors(vertices), direction, groups)


class Transaction(GraphView):
    """Staged changes; nothing of them is seen outside before the commit."""

    def __init__(self, snapshot: Snapshot):
        self.snapshot = snapshot

    def abort(self, why: str = "aborted") -> None:
        raise Aborted(why)


class Graph(GraphView):
    """A graph over a Spark session, changed by one driver.

    Of transactions that overlap the first to commit wins: the others find their base changed
    and raise, so that none overwrites what it hasn't seen.
    """

    def __init__(self, spark: SparkSession, snapshot: Snapshot | None = None):
        self.snapshot = snapshot or Snapshot(spark, Catalog())

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """Commits when the block ends; any error keeps the graph as it was. Aborts and conflicts raise TransactionError."""
        base = self.snapshot
        txn = Transaction(base)
        try:
            yield txn
        except Aborted as e:
            raise TransactionError(str(e)) from e
        if self.snapshot is not base:
            raise TransactionError("the graph has changed since the transaction began")
        self.snapshot = txn.snapshot

    def graph_transaction(self, body: Callable[[Transaction], object]) -> object:
        with self.transaction() as txn:
            return body(txn)

    def compact(self, path: str) -> None:
        """Write the graph to a shared folder and read it again: long chains of changes are cut."""
        from ..sources.store import load, save

        save(self.snapshot, path)
        self.snapshot = load(self.snapshot.spark, path)

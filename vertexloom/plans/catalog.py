"""The registry of vertex and edge groups: an immutable value on the driver."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from .types import (
    DIRECTED_TEMPLATE, UNDIRECTED_TEMPLATE, VERTEX_TEMPLATE, EdgeAttributes, EdgeType, Field, GraphSchema, Kind, SchemaError,
)

#: Ids that are never given to a group.
RESERVED_IDS = frozenset((100, 150))


@dataclass(frozen=True)
class Catalog:
    """Groups by name. ``add`` and ``drop`` give a new catalog and tell the subscribers."""

    groups: tuple[GraphSchema, ...] = ()
    last_id: int = 0
    subscribers: tuple[Callable[[str, GraphSchema], None], ...] = field(default=(), compare=False)

    def add(self, schema: GraphSchema, kind: Kind, edge: EdgeAttributes | None = None) -> tuple[Catalog, GraphSchema]:
        if kind is Kind.UNSPECIFIED:
            raise SchemaError(f"{schema.name}: a group is of vertices or of edges")
        if edge and not edge.has_body and schema.fields:
            raise SchemaError(f"{schema.name}: edges without a body have no fields")
        if self.find(schema.name):
            raise SchemaError(f"{schema.name}: the group is there already")
        if schema.key_field and kind is Kind.VERTEX and schema.key_field not in schema.field_names():
            raise SchemaError(f"{schema.name}: the key {schema.key_field} isn't a field")
        new_id = self.last_id + 1
        while new_id in RESERVED_IDS:
            new_id += 1
        made = replace(schema, id=new_id, kind=kind, edge=edge)
        for tell in self.subscribers:
            tell("added", made)
        return replace(self, groups=(*self.groups, made), last_id=new_id), made

    def drop(self, group: str | int | GraphSchema) -> Catalog:
        gone = self.need(group)
        for tell in self.subscribers:
            tell("deleted", gone)
        return replace(self, groups=tuple(g for g in self.groups if g.id != gone.id))

    def subscribe(self, tell: Callable[[str, GraphSchema], None]) -> Catalog:
        return replace(self, subscribers=(*self.subscribers, tell))

    def find(self, group: str | int | GraphSchema) -> GraphSchema | None:
        """A group by name, id or schema; None when unknown."""
        if isinstance(group, GraphSchema):
            group = group.name
        return next((g for g in self.groups if group in (g.name, g.id)), None)

    def need(self, group: str | int | GraphSchema, kind: Kind | None = None) -> GraphSchema:
        found = self.find(group)
        if found is None:
            raise SchemaError(f"no group {group}")
        if kind and found.kind is not kind:
            raise SchemaError(f"{found.name} is a group of {found.kind.value}s, not of {kind.value}s")
        return found

    def schema_type(self, group: str | int | GraphSchema) -> Kind | None:
        found = self.find(group)
        return found.kind if found else None

    def id_of(self, group: str | int | GraphSchema) -> int:
        """The id of a group; 0 for an unknown one."""
        found = self.find(group)
        return found.id if found else 0

    def cell_fields(self, group: str | int | GraphSchema) -> list[str]:
        """Hidden template fields, then the declared ones."""
        g = self.need(group)
        if g.kind is Kind.VERTEX:
            hidden = VERTEX_TEMPLATE
        else:
            hidden = () if not g.edge.has_body else DIRECTED_TEMPLATE if g.edge.edge_type is EdgeType.DIRECTED else UNDIRECTED_TEMPLATE
        return [*hidden, *g.field_names()]

    def count(self) -> int:
        return len(self.groups)

    def frame(self, spark: SparkSession) -> DataFrame:
        """All groups as rows."""
        rows = [(g.id, g.name, g.kind.value, g.edge.edge_type.value if g.edge else None, g.edge.has_body if g.edge else None, g.key_field, g.field_names(), g.is_dynamic) for g in self.groups]
        return spark.createDataFrame(rows, "id int, name string, kind string, edge_type string, has_body boolean, key_field string, fields array<string>, is_dynamic boolean")

    def to_json(self) -> str:
        def plain(f: Field) -> dict:
            kind = f.type if isinstance(f.type, str) else f.type.simpleString()
            return {"name": f.name, "type": kind, "nullable": f.nullable, "is_array": f.is_array, "fields": [plain(x) for x in f.fields]}

        groups = [{"id": g.id, "name": g.name, "kind": g.kind.value, "key_field": g.key_field, "is_dynamic": g.is_dynamic, "fields": [plain(f) for f in g.fields],
                   "edge": g.edge and [g.edge.edge_type.value, g.edge.has_body]} for g in self.groups]
        return json.dumps({"last_id": self.last_id, "groups": groups})

    @staticmethod
    def from_json(text: str) -> Catalog:
        def field_of(d: dict) -> Field:
            return Field(d["name"], d["type"], d["nullable"], d["is_array"], tuple(field_of(x) for x in d["fields"]))

        data = json.loads(text)
        groups = tuple(
            GraphSchema(g["name"], g["key_field"], tuple(field_of(f) for f in g["fields"]), g["is_dynamic"], g["id"], Kind(g["kind"]),
                        EdgeAttributes(EdgeType(g["edge"][0]), g["edge"][1]) if g["edge"] else None)
            for g in data["groups"])
        return Catalog(groups, data["last_id"])

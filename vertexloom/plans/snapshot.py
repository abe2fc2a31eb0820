"""An immutable graph: the catalog, a frame for each group, and where edges lead."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .catalog import Catalog
from .types import EDGE_ENDS, EXTRA, GraphSchema, Kind


@dataclass(frozen=True)
class Snapshot:
    """``vertices`` and ``edges`` hold a frame by group name.

    A vertex frame has the key, the declared columns and, for dynamic groups, ``_extra``. An
    edge frame has the four columns ``EDGE_ENDS``, where a is the source and b the destination of a directed
    edge, then the body. ``ends`` has, by edge group, the vertex groups at a and at b. ``dealt`` makes,
    of some edge groups, the same rows dealt out in pieces, for reads of the whole group.
    """

    spark: SparkSession = field(compare=False)
    catalog: Catalog = Catalog()
    vertices: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)
    ends: dict[str, tuple[frozenset[str], frozenset[str]]] = field(default_factory=dict)
    dealt: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def with_catalog(self, catalog: Catalog) -> Snapshot:
        return replace(self, catalog=catalog)

    def with_vertices(self, name: str, df: DataFrame) -> Snapshot:
        return replace(self, vertices={**self.vertices, name: df})

    def with_edges(self, name: str, df: DataFrame, a: frozenset[str] = frozenset(), b: frozenset[str] = frozenset(), dealt: Callable[[], DataFrame] | None = None) -> Snapshot:
        old = self.ends.get(name, (frozenset(), frozenset()))
        pieces = {k: v for k, v in {**self.dealt, name: dealt}.items() if v is not None}
        return replace(self, edges={**self.edges, name: df}, ends={**self.ends, name: (old[0] | a, old[1] | b)}, dealt=pieces)

    def without(self, name: str) -> Snapshot:
        drop = lambda d: {k: v for k, v in d.items() if k != name}
        return replace(self, vertices=drop(self.vertices), edges=drop(self.edges), ends=drop(self.ends), dealt=drop(self.dealt))


def body_type(group: GraphSchema) -> T.StructType:
    """Columns of a group's own fields."""
    fields = [f.spark() for f in group.fields]
    if group.kind is Kind.VERTEX and not group.key_field:
        fields.insert(0, T.StructField("_id", T.StringType()))
    if group.is_dynamic:
        fields.append(T.StructField(EXTRA, T.StringType()))
    return T.StructType(fields)


def end_columns(a: T.DataType, b: T.DataType) -> list[T.StructField]:
    kinds = (T.StringType(), a, T.StringType(), b)
    return [T.StructField(n, k) for n, k in zip(EDGE_ENDS, kinds, strict=True)]

"""Kinds of groups, fields and schemas, and the errors of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T


class GraphError(Exception):
    """A rule of the graph is broken."""


class SchemaError(GraphError):
    """A group is unknown, of the wrong kind or badly declared."""


class ValidationError(GraphError):
    """Data doesn't fit its group."""


class EdgeBodyError(GraphError):
    """An edge needs a body and has none, or has one and must not."""


class IntegrityError(GraphError):
    """An edge points to a vertex that isn't there."""


class FilterError(GraphError):
    """A filter can't be parsed or compiled."""


class NotFound(GraphError):
    """A vertex or edge isn't there."""


class Aborted(GraphError):
    """The transaction's own code gave up."""


class TransactionError(Exception):
    """A transaction could not be carried out; nothing of it is stored."""


class EdgeType(Enum):
    DIRECTED = "directed"
    UNDIRECTED = "undirected"


class Direction(Enum):
    INBOUND = "inbound"
    OUTBOUND = "outbound"
    UNDIRECTED = "undirected"


class Kind(Enum):
    UNSPECIFIED = "unspecified"
    VERTEX = "vertex"
    EDGE = "edge"


#: Reference type names and the Spark types that hold them; any other name is Spark DDL.
TYPE_NAMES = {"u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0), "i32": T.IntegerType(), "i64": T.LongType(), "f64": T.DoubleType(), "id": T.StringType()}


def spark_type(name: str | T.DataType) -> T.DataType:
    if isinstance(name, T.DataType):
        return name
    return TYPE_NAMES.get(name) or T._parse_datatype_string(name)


@dataclass(frozen=True)
class Field:
    name: str
    type: str | T.DataType = "string"
    nullable: bool = False
    is_array: bool = False
    fields: tuple[Field, ...] = ()

    def spark(self) -> T.StructField:
        kind = T.StructType([f.spark() for f in self.fields]) if self.fields else spark_type(self.type)
        return T.StructField(self.name, T.ArrayType(kind) if self.is_array else kind, True)


@dataclass(frozen=True)
class EdgeAttributes:
    edge_type: EdgeType
    has_body: bool


@dataclass(frozen=True)
class GraphSchema:
    """A group: its name, key field, declared fields, and whether it takes undeclared ones.

    The id is 0 and the kind unspecified until the catalog registers it.
    """

    name: str
    key_field: str | tuple[str, ...] | None = None
    fields: tuple[Field, ...] = field(default=())
    is_dynamic: bool = False
    id: int = 0
    kind: Kind = Kind.UNSPECIFIED
    edge: EdgeAttributes | None = None

    def __post_init__(self):
        if isinstance(self.key_field, (list, tuple)):
            if len(self.key_field) > 1:
                raise SchemaError(f"{self.name}: a key is one field, not {list(self.key_field)}")
            object.__setattr__(self, "key_field", self.key_field[0] if self.key_field else None)
        object.__setattr__(self, "fields", tuple(self.fields))
        for f in self.fields:
            if f.name.startswith("_"):
                raise SchemaError(f"{self.name}: names that start with _ are reserved: {f.name}")

    @property
    def key(self) -> str:
        """The column of the key; a group without one numbers its vertices in ``_id``."""
        return self.key_field or "_id"

    def field_names(self) -> list[str]:
        return [f.name for f in self.fields]


#: Hidden fields of the three templates, by kind of cell.
VERTEX_TEMPLATE = ("_outbound", "_inbound", "_undirected")
DIRECTED_TEMPLATE = ("_inbound", "_outbound")
UNDIRECTED_TEMPLATE = ("_vertex_a", "_vertex_b")
#: The column of undeclared fields, as JSON text.
EXTRA = "_extra"
EDGE_ENDS = ("a_schema", "a_key", "b_schema", "b_key")

"""Plain tables bound to a graph: columns are renamed where they lie, nothing is copied."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import Graph
from ..plans.snapshot import Snapshot
from ..plans.types import EXTRA, EdgeAttributes, EdgeType, Field, GraphSchema, Kind


def schema_of_table(name: str, schema: T.StructType, key: str | None = None) -> GraphSchema | None:
    """A stored table's schema as a group's: every column a field; None if there are no columns.

    Names that start with ``_`` are the engine's own: of them ``_extra`` makes the group dynamic
    and the others are left out.
    """
    if not schema.fields:
        return None
    fields = tuple(Field(c.name, c.dataType, c.name != key) for c in schema.fields if not c.name.startswith("_"))
    return GraphSchema(name, key, fields, EXTRA in schema.names)


def bind_vertices(snapshot: Snapshot, name: str, df: DataFrame, key: str) -> Snapshot:
    """A table as a vertex group: its columns are the fields, one of them the key."""
    catalog, _ = snapshot.catalog.add(schema_of_table(name, df.schema, key), Kind.VERTEX)
    return snapshot.with_catalog(catalog).with_vertices(name, df)


def bind_edges(snapshot: Snapshot, name: str, df: DataFrame, kind: EdgeType, a: tuple[str, str | Column], b: tuple[str, str | Column],
               body: list[str] | None = None, extra: str | None = None, dealt: Callable[[], DataFrame] | None = None) -> Snapshot:
    """A table as an edge group: (vertex group, key column) of either end, and the body's columns.

    ``extra`` is a column of JSON text with undeclared fields. The groups of the ends are
    constants of the plan, and keys keep their types, so filters on keys reach the files. ``dealt``
    makes the rows of ``df`` in pieces, for reads of the whole group.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    kept = [c for c in (body or []) if c != extra]
    fields = tuple(Field(c, df.schema[c].dataType, True) for c in kept)
    catalog, _ = snapshot.catalog.add(GraphSchema(name, None, fields, extra is not None), Kind.EDGE, EdgeAttributes(kind, body is not None))
    cols = [F.lit(a[0]).alias("a_schema"), col(a[1]).alias("a_key"), F.lit(b[0]).alias("b_schema"), col(b[1]).alias("b_key"),
            *kept, *([F.col(extra).alias(EXTRA)] if extra else [])]
    pieces = None if dealt is None else lambda: dealt().select(*cols)
    return snapshot.with_catalog(catalog).with_edges(name, df.select(*cols), frozenset((a[0],)), frozenset((b[0],)), pieces)


#: Rows of a piece: of two keys, some 120 MB of hash tables.
PIECE = 250_000


def distinct_in_pieces(df: DataFrame) -> DataFrame:
    """``distinct``, so that no task keeps more than about a piece of the rows in hash tables.

    ``distinct`` alone keeps in them what a file split and then a shuffled partition hold,
    and the latter are joined up to 64 MB of compressed rows. Here the number of pieces grows with
    the rows, which are counted first; of Parquet that reads footers only. Splits aren't made
    distinct before: rows that hardly repeat only cost memory there.
    """
    return df.repartition(max(1, -(-df.count() // PIECE)), *df.columns).distinct()


#: Vertex groups of the sales tables and their keys.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}


def sales_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The sales tables as a graph; only the tables that a query touches are read."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    s = Snapshot(spark)
    for name, key in KEYS.items():
        s = bind_vertices(s, name, table(name), key)
    events, lines, nations = table("events"), table("lineitem"), table("nation")
    s = bind_vertices(s, "event_type", events.select("event_type").distinct(), "event_type")
    directed, undirected = EdgeType.DIRECTED, EdgeType.UNDIRECTED
    s = bind_edges(s, "in_region", nations, directed, ("nation", "n_nationkey"), ("region", "n_regionkey"))
    s = bind_edges(s, "lives_in", table("customer"), directed, ("customer", "c_custkey"), ("nation", "c_nationkey"))
    s = bind_edges(s, "based_in", table("supplier"), directed, ("supplier", "s_suppkey"), ("nation", "s_nationkey"))
    s = bind_edges(s, "placed", table("orders"), directed, ("customer", "o_custkey"), ("orders", "o_orderkey"))
    body = [c for c in lines.columns if c not in ("l_orderkey", "l_partkey")]
    s = bind_edges(s, "contains", lines, directed, ("orders", "l_orderkey"), ("part", "l_partkey"), body)
    body = [c for c in lines.columns if c not in ("l_suppkey", "l_partkey")]
    s = bind_edges(s, "traded", lines, undirected, ("supplier", "l_suppkey"), ("part", "l_partkey"), body)
    pairs = lines.select("l_suppkey", "l_partkey")
    s = bind_edges(s, "supplies", pairs.distinct(), undirected, ("supplier", "l_suppkey"), ("part", "l_partkey"), dealt=lambda: distinct_in_pieces(pairs))
    x, y = nations.alias("x"), nations.alias("y")
    near = x.join(y, (F.col("x.n_regionkey") == F.col("y.n_regionkey")) & (F.col("x.n_nationkey") <= F.col("y.n_nationkey")))
    s = bind_edges(s, "neighbour", near.select(F.col("x.n_nationkey").alias("a"), F.col("y.n_nationkey").alias("b")), undirected, ("nation", "a"), ("nation", "b"))
    s = bind_edges(s, "performed", events, directed, ("customer", "user_id"), ("event_type", "event_type"), ["event_id", "ts", "value"], "props")
    return Graph(spark, s)

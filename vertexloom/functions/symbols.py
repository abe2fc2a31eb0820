"""Statements as s-expressions: insert, select, update and delete of vertices, edges and cells.

``(insert-vertex "people" (hashmap name "Ann"))``, ``(select-vertex "people" "Ann")``,
``(select-vertex "people" (> vertex.age 30))``, ``(update-vertex "people" "Ann" (hashmap age 4))``,
``(delete-vertex "people" "Ann")``; edges name both ends:
``(insert-edge "knows" (id "people" "Ann") (id "people" "Bob") (hashmap since 2001))``,
``(select-edge "knows" (id "people" "Ann") outbound (= edge.since 2001))``. A cell is a vertex
or an edge, whichever its group holds. Arguments aren't evaluated before the form sees them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.types import Direction, FilterError, Kind
from .filters import Cell, Symbol, compile_filter, parse


def _is(form, name: str) -> bool:
    return isinstance(form, list) and bool(form) and form[0] == Symbol(name)


def _map(form) -> dict:
    if not _is(form, "hashmap") or len(form) % 2 == 0:
        raise FilterError("(hashmap key value ...)")
    name = lambda k: k.name if isinstance(k, Symbol) else k
    return {name(k): v for k, v in zip(form[1::2], form[2::2], strict=True)}


def _id(form) -> tuple:
    if not _is(form, "id") or len(form) != 3:
        raise FilterError("(id group key)")
    return form[1], form[2]


def insert_vertex(graph, group, data):
    return graph.new_vertex(group, _map(data))


def select_vertex(graph, group, what=None):
    key = F.col(graph.snapshot.catalog.need(group).key)
    if _is(what, "hashmap"):
        df = graph.vertices(group)
        fields = Cell({c: F.col(c) for c in df.columns}, df.columns)
        for name, value in _map(what).items():
            df = df.where(compile_filter([Symbol("="), [Symbol("get"), Symbol("vertex"), name], value], {"vertex": fields}))
        return df
    if isinstance(what, list):
        return graph.vertices(group, what)
    return graph.vertices(group) if what is None else graph.vertices(group).where(key == F.lit(what))


def update_vertex(graph, group, key, data):
    graph.update_vertex_by_key(group, key, lambda v: v | _map(data))


def delete_vertex(graph, group, key):
    graph.remove_vertex_by_key(group, key)


def insert_edge(graph, group, source, target, body=None):
    graph.link(_id(source), group, _id(target), None if body is None else _map(body))


def select_edge(graph, group, anchor=None, direction=None, where=None):
    way = Direction(direction.name) if direction else None
    if way is None:
        way = Direction.UNDIRECTED if graph.snapshot.catalog.need(group).edge.edge_type.value == "undirected" else Direction.OUTBOUND
    return graph.edges(None if anchor is None else _id(anchor), group, way, where)


def _between(source, target):
    (p, k), (q, m) = _id(source), _id(target)
    return (F.col("a_schema") == p) & (F.col("a_key") == F.lit(k)) & (F.col("b_schema") == q) & (F.col("b_key") == F.lit(m))


def update_edge(graph, group, source, target, data):
    graph.update_edges(group, _between(source, target), {k: F.lit(v) for k, v in _map(data).items()})


def delete_edge(graph, group, source, target):
    graph.remove_edge(group, _id(source), _id(target))


def _cell(of_vertex, of_edge):
    def form(graph, group, *args):
        return (of_vertex if graph.snapshot.catalog.need(group).kind is Kind.VERTEX else of_edge)(graph, group, *args)

    return form


#: Every statement by name; ``register`` adds more.
SYMBOLS = {
    "insert-vertex": insert_vertex, "select-vertex": select_vertex, "update-vertex": update_vertex, "delete-vertex": delete_vertex,
    "insert-edge": insert_edge, "select-edge": select_edge, "update-edge": update_edge, "delete-edge": delete_edge,
    "insert-cell": _cell(insert_vertex, insert_edge), "select-cell": _cell(select_vertex, select_edge),
    "update-cell": _cell(update_vertex, update_edge), "delete-cell": _cell(delete_vertex, delete_edge),
}


def register(name: str, form) -> None:
    SYMBOLS[name] = form


def execute(graph, text: str):
    """Carry out every statement of a text in one transaction; the last one's result."""
    out = None
    with graph.transaction() as txn:
        for form in parse(text):
            if not isinstance(form, list) or not form or not isinstance(form[0], Symbol) or form[0].name not in SYMBOLS:
                raise FilterError(f"no statement: {form}")
            try:
                out = SYMBOLS[form[0].name](txn, *form[1:])
            except TypeError as e:
                raise FilterError(f"{form[0].name}: {e}") from e
    return out

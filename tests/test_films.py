"""The films graph: the end-to-end behaviour of groups, links, degrees and errors."""

from __future__ import annotations

import pytest

from vertexloom.operators.graph import Graph
from vertexloom.plans.types import (
    Direction, EdgeAttributes, EdgeBodyError, EdgeType, Field, GraphSchema, NotFound, SchemaError, TransactionError, ValidationError,
)

OUT, IN, BOTH = Direction.OUTBOUND, Direction.INBOUND, Direction.UNDIRECTED
MORGAN, JEANETTE = ("people", "Morgan Freeman"), ("people", "Jeanette Adair Bradshaw")


@pytest.fixture(scope="module")
def films(spark):
    g = Graph(spark)
    ids = [
        g.new_vertex_group(GraphSchema("people", "name", (Field("name"),), True)),
        g.new_vertex_group(GraphSchema("movie", "name", (Field("name"), Field("year", "u32")), True)),
        g.new_edge_group(GraphSchema("acted-in", None, (Field("role"),), True), EdgeAttributes(EdgeType.DIRECTED, True)),
        g.new_edge_group(GraphSchema("spouse"), EdgeAttributes(EdgeType.UNDIRECTED, False)),
    ]
    assert ids == [1, 2, 3, 4]
    g.new_vertex("people", {"name": "Morgan Freeman", "age": 80})
    g.new_vertex("people", {"name": "Jeanette Adair Bradshaw"})
    for name, year in (("Batman Begins", 2005), ("The Dark Knight", 2008), ("The Dark Knight Rises", 2012), ("Oblivion", 2010)):
        g.new_vertex("movie", {"name": name, "year": year})
    return g


def test_relationship(films):
    g = films
    for group, key in (MORGAN, JEANETTE, ("movie", "Batman Begins"), ("movie", "Oblivion")):
        assert g.vertex_by_key(group, key)["name"] == key
    assert g.vertex_by_key(*MORGAN)["age"] == 80
    assert g.vertex_by_key("people", "nobody") is None
    assert g.degree(MORGAN, "acted-in", OUT) == 0
    assert g.edges(MORGAN, "acted-in", OUT).count() == 0
    g.link(MORGAN, "acted-in", ("movie", "Batman Begins"), {"role": "Lucius Fox", "works_for": "Bruce Wayne"})
    g.link(MORGAN, "acted-in", ("movie", "The Dark Knight"), {"role": "Lucius Fox"})
    g.link(MORGAN, "acted-in", ("movie", "The Dark Knight Rises"), {"role": "Lucius Fox"})
    assert g.edges(MORGAN, "acted-in", OUT).count() == 3
    assert g.degree(MORGAN, "acted-in", OUT) == 3
    with pytest.raises(TransactionError):
        g.link(MORGAN, "acted-in", ("movie", "Oblivion"), {})
    assert g.neighbourhoods(MORGAN, "acted-in", OUT).count() == 3
    g.link(MORGAN, "acted-in", ("movie", "Oblivion"), {"role": "Beech"})
    assert g.degree(MORGAN, "acted-in", OUT) == 4
    with pytest.raises(EdgeBodyError):
        g.link(MORGAN, "spouse", JEANETTE, {"role": "Sister"})
    with pytest.raises(EdgeBodyError):
        g.link(MORGAN, "acted-in", ("movie", "Oblivion"))
    assert g.degree(MORGAN, "spouse", BOTH) == 0
    g.link(MORGAN, "spouse", JEANETTE)
    assert g.degree(MORGAN, "spouse", OUT) == 0
    assert g.degree(MORGAN, "acted-in", OUT) == 4
    assert [g.degree(v, "spouse", BOTH) for v in (MORGAN, JEANETTE)] == [1, 1]
    row = g.neighbourhoods(JEANETTE, "spouse", BOTH).first()
    assert row["vertex"]["name"] == "Morgan Freeman" and row["a_key"] == JEANETTE[1] and row["edge"] is None
    found = g.neighbourhoods(MORGAN, "acted-in", OUT, '(and (= edge.works_for "Bruce Wayne") (< vertex.year 2008))')
    assert [r["vertex"]["name"] for r in found.collect()] == ["Batman Begins"]
    assert g.vertices("people", "(> vertex.age 70)").count() == 1
    assert {r["edge_schema"] for r in g.cell_types(MORGAN, OUT).collect()} == {"acted-in"}


def test_errors_and_rollback(films):
    g = films
    before = g.snapshot
    with pytest.raises(SchemaError):
        g.new_vertex("acted-in", {"role": "x"})
    with pytest.raises(SchemaError):
        g.new_vertex("nowhere", {})
    with pytest.raises(ValidationError):
        g.new_vertex("people", {"name": "Morgan Freeman"})
    with pytest.raises(ValidationError):
        g.new_vertex("movie", {"name": "no year"})
    with pytest.raises(ValidationError):
        g.new_vertex("people", {"name": "x", "_outbound": 1})
    with pytest.raises(NotFound):
        g.link(MORGAN, "spouse", ("people", "nobody"))
    with pytest.raises(SchemaError):
        g.degree(MORGAN, "nowhere", OUT)
    with pytest.raises(SchemaError):
        g.degree(MORGAN, "people", OUT)
    with pytest.raises(NotFound):
        g.degree(("people", "nobody"), "spouse", BOTH)
    assert g.edges(MORGAN, "nowhere", OUT).count() == 0
    with pytest.raises(SchemaError):
        g.edges(MORGAN, "nowhere", OUT, strict=True)
    with pytest.raises(TransactionError):
        g.graph_transaction(lambda txn: txn.update_vertex(MORGAN, lambda v: None))
    with pytest.raises(ValidationError):
        g.update_vertex(MORGAN, lambda v: v | {"name": "another"})
    with pytest.raises(TransactionError), g.transaction() as txn:
        txn.remove_vertex(JEANETTE)
        txn.abort()
    assert g.snapshot is before


def test_update_remove_and_store(films, tmp_path):
    g = Graph(films.snapshot.spark, films.snapshot)
    g.update_vertex(JEANETTE, lambda v: v | {"age": 70})
    assert g.vertex_by_key(*JEANETTE)["age"] == 70
    g.remove_vertex(("movie", "Oblivion"))
    assert g.vertices("movie").count() == 3
    g.remove_vertex(JEANETTE)
    assert g.vertex_by_key(*JEANETTE) is None and g.degrees(MORGAN, "spouse", BOTH).first()["degree"] == 0
    with pytest.raises(NotFound):
        g.remove_vertex(JEANETTE)
    g.compact(f"file://{tmp_path}/graph")
    assert g.vertex_by_key(*MORGAN)["age"] == 80 and g.snapshot.catalog.id_of("spouse") == 4
    assert films.vertex_by_key(*JEANETTE) is not None


def test_schemas(spark):
    g = Graph(spark)
    with pytest.raises(SchemaError):
        g.new_edge_group(GraphSchema("e", None, (Field("test_field", "u32"),)), EdgeAttributes(EdgeType.DIRECTED, False))
    assert g.new_edge_group(GraphSchema("e", None, (Field("test_field", "u32"),)), EdgeAttributes(EdgeType.DIRECTED, True)) == 1
    assert g.new_vertex_group(GraphSchema("v", None, (Field("test_field", "u32"),))) == 2
    made = g.new_vertex("v", {"test_field": 1})
    assert g.vertex_by(made)["test_field"] == 1
    with pytest.raises(SchemaError):
        g.new_vertex("e", {"test_field": 1})
    with pytest.raises(SchemaError):
        g.new_vertex_group(GraphSchema("v"))
    with pytest.raises(SchemaError):
        GraphSchema("w", ("a", "b"))
    with pytest.raises(SchemaError):
        GraphSchema("w", None, (Field("_hidden"),))
    catalog = g.snapshot.catalog
    assert catalog.id_of("nothing") == 0 and catalog.find("nothing") is None and catalog.count() == 2
    assert catalog.cell_fields("e") == ["_inbound", "_outbound", "test_field"]
    assert type(catalog).from_json(catalog.to_json()).to_json() == catalog.to_json()
    told = []
    g._set(g.snapshot.with_catalog(catalog.subscribe(lambda what, s: told.append((what, s.name)))))
    g.drop_group("v")
    assert told == [("deleted", "v")] and g.snapshot.catalog.find(2) is None and "v" not in g.snapshot.vertices

"""Bags, self-loops, orientation, dangling ends, filters, statements, streams and settings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vertexloom.functions.filters import Symbol, parse
from vertexloom.functions.symbols import execute
from vertexloom.operators.graph import Graph
from vertexloom.operators.traversal import opposite
from vertexloom.plans.snapshot import Snapshot
from vertexloom.plans.types import Direction, EdgeType, FilterError, IntegrityError, NotFound
from vertexloom.sources.store import options_from_text
from vertexloom.sources.tables import bind_edges, bind_vertices
from vertexloom.streaming.ingest import degree_stream, link_stream

OUT, IN, BOTH = Direction.OUTBOUND, Direction.INBOUND, Direction.UNDIRECTED


def graph(spark, edges, kind, body=False):
    s = bind_vertices(Snapshot(spark), "p", spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "z")], "k int, name string"), "k")
    df = spark.createDataFrame([(a, b, 10 * a + b) for a, b in edges], "a int, b int, w int")
    return Graph(spark, bind_edges(s, "e", df, kind, ("p", "a"), ("p", "b"), ["w"] if body else None))


def degrees(g, direction):
    return {r["v_key"]: r["degree"] for r in g.degrees("p", "e", direction).collect()}


def test_self_loops(spark):
    g = graph(spark, [(1, 1), (1, 2)], EdgeType.UNDIRECTED)
    assert degrees(g, BOTH) == {1: 3, 2: 1, 3: 0, 4: 0}
    assert g.neighbourhoods(("p", 1), "e", BOTH).count() == 3
    g = graph(spark, [(1, 1)], EdgeType.DIRECTED)
    assert degrees(g, OUT)[1] == degrees(g, IN)[1] == 1 and degrees(g, BOTH)[1] == 0


def test_orientation(spark):
    simple, body = graph(spark, [(1, 2)], EdgeType.UNDIRECTED), graph(spark, [(1, 2)], EdgeType.UNDIRECTED, True)
    assert [(r["a_key"], r["b_key"]) for r in simple.edges(("p", 2), "e", BOTH).collect()] == [(2, 1)]
    row = body.edges(("p", 2), "e", BOTH).first()
    assert (row["a_key"], row["b_key"], row["edge"]["w"], row["edge"]["_vertex_a"]) == (1, 2, 12, 1)
    rows = body.edges(None, "e", BOTH)
    assert sorted((r[0], r[1]) for r in rows.select("v_key", opposite(rows)).collect()) == [(1, 2), (2, 1)]


def test_remove_one_of_equal_edges(spark):
    g = graph(spark, [(1, 2), (1, 2), (3, 4)], EdgeType.DIRECTED)
    g.remove_edge("e", ("p", 1), ("p", 2))
    assert degrees(g, OUT) == {1: 1, 2: 0, 3: 1, 4: 0}
    g.remove_edge("e", ("p", 1), ("p", 2), every=True)
    assert degrees(g, OUT)[1] == 0
    with pytest.raises(NotFound):
        g.remove_edge("e", ("p", 1), ("p", 2))


def test_dangling_ends(spark):
    g = graph(spark, [(1, 2), (1, 9)], EdgeType.DIRECTED)
    assert g.neighbourhoods(("p", 1), "e", OUT).count() == 1
    with pytest.raises(IntegrityError):
        g.neighbourhoods(("p", 1), "e", OUT, strict=True)
    with pytest.raises(IntegrityError):
        g.link_many("e", spark.createDataFrame([("p", 1, "p", 8)], "a_schema string, a_key int, b_schema string, b_key int"))


def test_remove_vertices(spark):
    g = graph(spark, [(1, 1), (1, 2), (2, 3)], EdgeType.UNDIRECTED, True)
    g.remove_vertex(("p", 1))
    g.remove_vertex(("p", 4))
    assert degrees(g, BOTH) == {2: 1, 3: 1}
    g.remove_vertices("p", spark.createDataFrame([(3,)], "k int"))
    assert degrees(g, BOTH) == {2: 0}


def test_filters(spark):
    g = graph(spark, [(1, 2), (2, 3), (3, 4)], EdgeType.DIRECTED, True)
    count = lambda f: g.neighbourhoods(None, "e", OUT, f).count()
    assert count(None) == 3
    assert count("(nil? vertex.name)") == 1
    assert count('(in vertex.name "y" "z")') == 2
    assert count("(not (< edge.w 20))") == 2
    assert count("(if (= edge._inbound 1) true (= (+ edge.w 1) 35))") == 2
    assert count("(or (<= 12 edge.w 12) (!= (/ (- edge.w 4) 3) 10))") == 2
    assert count('(= vertex.name "q")') == 0
    assert count(F.col("edge.w") > 20) == 2
    for bad in ("(", ")", "(= 1", "(foo 1)", "vertex", "(= vertex.nothing 1)", "(not 1 2)", "1 2", "(get vertex)"):
        with pytest.raises(FilterError):
            count(bad)
    with pytest.raises(FilterError):
        g.edges(None, "e", OUT, "(= vertex.name 1)")
    assert parse('(a "b\\"c" 1 2.5 true nil) ; note') == [[Symbol("a"), 'b"c', 1, 2.5, True, None]]


def test_filter_reaches_the_files(spark):
    from vertexloom.sources.tables import sales_graph

    g = sales_graph(spark, "/root/testdata/sf0.001")
    plan = g.neighbourhoods(None, "contains", OUT, "(and (> vertex.p_size 45) (> edge.l_quantity 40))")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_size,45)" in text and "GreaterThan(l_quantity,40" in text and "Python" not in text
    text = g.edges(("orders", 7), "contains", OUT)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in text and "Window" not in text


def test_statements(spark):
    g = graph(spark, [(1, 2)], EdgeType.DIRECTED, True)
    execute(g, '(insert-vertex "p" (hashmap k 5 name "new")) (insert-cell "e" (id "p" 1) (id "p" 5) (hashmap w 7))')
    assert degrees(g, OUT)[1] == 2
    execute(g, '(update-cell "p" 5 (hashmap name "newer"))')
    assert execute(g, '(select-cell "p" 5)').first()["name"] == "newer"
    assert execute(g, '(select-vertex "p" (hashmap name "newer"))').count() == 1
    execute(g, '(update-edge "e" (id "p" 1) (id "p" 5) (hashmap w 8))')
    assert execute(g, '(select-edge "e" (id "p" 1) outbound (= edge.w 8))').count() == 1
    execute(g, '(delete-edge "e" (id "p" 1) (id "p" 5)) (delete-vertex "p" 2)')
    assert degrees(g, OUT) == {1: 0, 3: 0, 4: 0, 5: 0}
    before = g.snapshot
    with pytest.raises(FilterError):
        execute(g, '(delete-vertex "p" 3) (drop-everything)')
    assert g.snapshot is before


def test_streams(spark, tmp_path):
    g = graph(spark, [(1, 2)], EdgeType.DIRECTED)
    kind = "a_schema string, a_key int, b_schema string, b_key int"
    spark.createDataFrame([("p", 1, "p", 3), ("p", 1, "p", 4), ("p", 2, "p", 4)], kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
    q = degree_stream(g, "e", stream, OUT).writeStream.outputMode("complete").format("memory").queryName("degrees").start()
    q.processAllAvailable()
    q.stop()
    assert {r["v_key"]: r["degree"] for r in spark.table("degrees").collect()} == {1: 2, 2: 1}
    q = link_stream(g, "e", stream, f"{tmp_path}/state").start()
    q.processAllAvailable()
    q.stop()
    assert degrees(g, OUT) == {1: 3, 2: 1, 3: 0, 4: 0}


def test_settings():
    text = "# server\nserver:\n  memory_size: 8\n  chunk_count: 8\n  index: true\n  wal: null\n  name: 'a b' # why\n"
    assert options_from_text(text) == {"server": {"memory_size": 8 << 20, "chunk_count": 8, "index": True, "wal": None, "name": "a b"}}


def test_every_graph_query_has_a_contract():
    import __spark_entry__ as entry

    assert {"deg_out", "nbr_filter_both", "mut_rollback"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_point_traversals_reach_the_files(spark):
    """Anchors known by key are a filter of the scan, and nothing of the edge table is shuffled."""
    from vertexloom.sources.tables import sales_graph

    g = sales_graph(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (g.edges(("orders", 7), "contains", OUT), g.neighbourhoods(("orders", 7), "contains", OUT), g.degrees(("orders", 7), "contains", OUT), g.cell_types(("orders", 7), OUT, ["contains"])):
        assert "EqualTo(l_orderkey,7)" in plan(df)
    assert "Exchange" not in plan(g.edges(("orders", 7), "contains", OUT))
    assert "In(l_orderkey, [7,8])" in plan(g.edges(("orders", [7, 8]), "contains", OUT))
    assert g.edges(("orders", [7, 7]), "contains", OUT).count() == 2 * g.edges(("orders", 7), "contains", OUT).count()
    assert g.edges(("orders", []), "contains", OUT).count() == 0


def test_settings_open_a_graph(spark, tmp_path):
    from vertexloom.sources.store import open_graph, save

    old = spark.conf.get("spark.sql.shuffle.partitions")
    options = options_from_text(f"storage: file://{tmp_path}/g\nspark:\n  sql.shuffle.partitions: 3\n")
    assert open_graph(spark, options).snapshot.catalog.count() == 0 and spark.conf.get("spark.sql.shuffle.partitions") == "3"
    spark.conf.set("spark.sql.shuffle.partitions", old)
    save(graph(spark, [(1, 2)], EdgeType.DIRECTED).snapshot, options["storage"])
    assert degrees(open_graph(spark, {"storage": options["storage"]}), OUT)[1] == 1


def test_overlapping_transactions(spark):
    from vertexloom.plans.types import TransactionError

    g = graph(spark, [(1, 2)], EdgeType.DIRECTED)
    with pytest.raises(TransactionError), g.transaction() as late:
        late.link(("p", 3), "e", ("p", 4))
        with g.transaction() as first:
            first.link(("p", 2), "e", ("p", 3))
    assert degrees(g, OUT) == {1: 1, 2: 1, 3: 0, 4: 0}


def test_main_program(spark, tmp_path, capsys):
    from vertexloom.__main__ import main
    from vertexloom.sources.store import load, save

    save(graph(spark, [(1, 2)], EdgeType.DIRECTED).snapshot, f"file://{tmp_path}/g")
    settings = tmp_path / "settings.yaml"
    settings.write_text(f"storage: file://{tmp_path}/g\nsave: file://{tmp_path}/after\n")
    assert main([]) == 2
    assert main([str(settings), '(insert-edge "e" (id "p" 2) (id "p" 3)) (select-vertex "p" 2)']) == 0
    assert "|2  |y   |" in capsys.readouterr().out
    assert load(spark, f"file://{tmp_path}/after").edges["e"].count() == 2


def test_schemas_of_tables(spark):
    from pyspark.sql import types as T

    from vertexloom.sources.tables import schema_of_table

    made = schema_of_table("p", spark.createDataFrame([], "k int, name string, _id string, _extra string").schema, "k")
    assert made.field_names() == ["k", "name"] and made.is_dynamic and made.key_field == "k"
    assert [f.nullable for f in made.fields] == [False, True] and schema_of_table("p", T.StructType([])) is None

"""Registered graph queries over the sales tables, and their DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.symbols import execute
from .operators.graph import Graph
from .operators.traversal import opposite
from .plans.types import Aborted, Direction, EdgeAttributes, EdgeType, Field, GraphSchema, TransactionError
from .sources.tables import bind_edges, bind_vertices, sales_graph
from .streaming.ingest import degree_stream, link_stream

OUT, IN, BOTH = Direction.OUTBOUND, Direction.INBOUND, Direction.UNDIRECTED
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
    """Register a function of the sales graph under its name."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(sales_graph(spark, sf_dir))
    return f


def _key(df: DataFrame, *more) -> DataFrame:
    return df.select(F.col("v_key").alias("id"), *more)


@query
def v_by_key(g):
    return g.vertices("customer", keys=[42])


@query
def v_by_keys(g):
    return g.vertices("part", keys=[3, 5, 8, 13, 999999999]).select("p_partkey", "p_name", "p_size")


@query
def v_filter(g):
    return g.vertices("part", '(and (> vertex.p_size 40) (= vertex.p_type "PROMO"))').select("p_partkey", "p_brand", "p_size")


@query
def deg_out(g):
    return _key(g.degrees("orders", "contains", OUT), "degree")


@query
def deg_in(g):
    return _key(g.degrees("part", "contains", IN), "degree")


@query
def deg_wrong_direction(g):
    return _key(g.degrees("orders", "contains", BOTH), "degree")


def _both_sides(g, group):
    anchors = g.anchors("supplier").unionAll(g.anchors("part"))
    return g.degrees(anchors, group, BOTH).select(F.col("v_schema").alias("vschema"), F.col("v_key").alias("id"), "degree")


@query
def deg_undirected_simple(g):
    return _both_sides(g, "supplies")


@query
def deg_undirected_body(g):
    return _both_sides(g, "traded")


@query
def deg_self_loop(g):
    return _key(g.degrees("nation", "neighbour", BOTH), "degree")


def _ends(df: DataFrame, *more) -> DataFrame:
    return df.select(F.col("a_key").alias("src_key"), F.col("b_key").alias("dst_key"), *more)


def _edge(*names: str):
    return [F.col(f"edge.{n}").alias(n) for n in names]


@query
def edges_out(g):
    return _ends(g.edges(("orders", 7), "contains", OUT), *_edge("l_linenumber", "l_quantity", "l_returnflag"))


@query
def edges_in(g):
    return _ends(g.edges(("part", 5), "contains", IN), *_edge("l_linenumber", "l_quantity"))


@query
def edges_filter(g):
    found = g.edges(None, "contains", OUT, '(and (> edge.l_quantity 45) (= (get edge "l_returnflag") "R"))')
    return _ends(found, *_edge("l_quantity", "l_returnflag"))


@query
def edges_simple_body_null(g):
    return _ends(g.edges(("customer", 42), "placed", OUT), F.col("edge").alias("body"))


@query
def edges_undirected_simple_orientation(g):
    return g.edges(("part", 5), "supplies", BOTH).select("a_key", "b_key", "a_schema", "b_schema")


@query
def edges_undirected_body_orientation(g):
    return g.edges(("part", 5), "traded", BOTH).select("a_key", "b_key", *_edge("l_quantity"), "a_schema", "b_schema")


@query
def opposite_vertex(g):
    rows = g.edges(None, "contains", IN).where(F.col("v_key") < 50)
    return rows.select(F.col("v_key").alias("anchor"), opposite(rows).alias("opposite"))


def _near(df: DataFrame, vertex: tuple[str, ...], edge: tuple[str, ...] = ()) -> DataFrame:
    return df.select(F.col("v_key").alias("anchor"), *[F.col(f"vertex.{n}").alias(n) for n in vertex], *_edge(*edge))


@query
def nbr_out(g):
    return _near(g.neighbourhoods(("orders", 7), "contains", OUT), ("p_partkey", "p_name"), ("l_quantity",))


@query
def nbr_in(g):
    return _near(g.neighbourhoods(("part", 5), "contains", IN), ("o_orderkey", "o_orderstatus"), ("l_quantity",))


@query
def nbr_undirected(g):
    return _near(g.neighbourhoods(("part", 5), "supplies", BOTH), ("s_suppkey", "s_name"))


@query
def nbr_filter_vertex(g):
    return _near(g.neighbourhoods(None, "contains", OUT, "(> vertex.p_size 45)"), ("p_partkey", "p_size"))


@query
def nbr_filter_edge(g):
    return _near(g.neighbourhoods(None, "contains", OUT, "(>= edge.l_discount 0.09)"), ("p_partkey",), ("l_discount",))


@query
def nbr_filter_both(g):
    found = g.neighbourhoods(None, "contains", OUT, "(and (> vertex.p_size 25) (> edge.l_quantity 40))")
    return _near(found, ("p_partkey", "p_brand"), ("l_quantity",))


@query
def nbr_parallel(g):
    return _ends(g.edges(None, "contains", OUT)).groupBy("src_key", "dst_key").agg(F.count("*").alias("n")).where("n > 1")


@query
def nbr_two_hop(g):
    first = g.edges(None, "placed", OUT).where(F.col("v_key") < 20)
    hop = first.select(F.col("v_key").alias("anchor"), F.col("o_schema").alias("s"), F.col("o_key").alias("k"))
    second = g.edges(None, "contains", OUT)
    rows = hop.join(second, (F.col("s") == F.col("v_schema")) & (F.col("k") == F.col("v_key")))
    return rows.select("anchor", F.col("o_key").alias("part_key"), *_edge("l_quantity"))


@query
def nbr_chain_region(g):
    first = g.edges(None, "lives_in", OUT).select(F.col("o_schema").alias("s"), F.col("o_key").alias("k"))
    second = g.neighbourhoods(None, "in_region", OUT)
    rows = first.join(second, (F.col("s") == F.col("v_schema")) & (F.col("k") == F.col("v_key")))
    return rows.groupBy(F.col("vertex.r_name").alias("r_name")).agg(F.count("*").alias("customers"))


@query
def cell_types(g):
    of_orders = g.cell_types(None, OUT, ["contains"]).unionAll(g.cell_types(None, IN, ["placed"]))
    return of_orders.select(F.col("v_key").alias("id"), "direction", "edge_schema")


def _extra(name: str, kind: str):
    return F.try_variant_get(F.parse_json(F.col("edge._extra")), f"$.{name}", kind).alias(name)


@query
def dyn_field(g):
    return _ends(g.edges(None, "performed", OUT), *_edge("event_id"), _extra("k", "int"))


@query
def dyn_field_filter(g):
    found = g.edges(None, "performed", OUT, '(and (> edge.k 90) (= edge._outbound "purchase"))')
    return found.select(*_edge("event_id"), F.col("a_key").alias("src_key"), *_edge("value"))


@query
def mut_new_vertex(g):
    g.new_vertex("part", {"p_partkey": 900000001, "p_name": "new part"})
    return g.vertices("part").select("p_partkey", "p_name")


@query
def mut_link(g):
    with g.transaction() as txn:
        for _ in range(2):
            txn.link(("orders", 7), "contains", ("part", 5), {})
    return g.edges(None, "contains", OUT).groupBy(F.col("v_key").alias("id")).agg(F.count("*").alias("degree"))


@query
def mut_update(g):
    g.update_vertex_by_key("customer", 42, lambda v: v | {"c_mktsegment": "UPDATED"})
    return g.vertices("customer").select("c_custkey", "c_mktsegment")


@query
def mut_remove_edge(g):
    g.remove_edges("contains", F.col("a_key") == 7)
    return _ends(g.edges(None, "contains", OUT), *_edge("l_linenumber"))


def _bag(spark: SparkSession, _: str) -> DataFrame:
    g = Graph(spark)
    s = bind_vertices(g.snapshot, "point", spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int"), "k")
    s = bind_edges(s, "line", spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "a int, b int"), EdgeType.DIRECTED, ("point", "a"), ("point", "b"))
    g = Graph(spark, s)
    g.remove_edge("line", ("point", 1), ("point", 2))
    return _ends(g.edges(None, "line", OUT))


QUERIES["mut_remove_one_of_two"] = _bag


@query
def mut_remove_vertex(g):
    g.remove_vertex(("part", 5))
    return _key(g.degrees("orders", "contains", OUT), "degree")


@query
def mut_rollback(g):
    try:
        with g.transaction() as txn:
            txn.remove_vertices("part", [5])
            raise Aborted("changed my mind")
    except TransactionError:
        pass
    return g.vertices("part").agg(F.count("*").alias("n"))


@query
def catalog_groups(g):
    return g.snapshot.catalog.frame(g.snapshot.spark)


@query
def catalog_count(g):
    return g.snapshot.spark.createDataFrame([(g.snapshot.catalog.count(),)], "n long")


@query
def form_select_vertex(g):
    return execute(g, '(select-vertex "part" (and (> vertex.p_size 40) (= vertex.p_type "PROMO")))').select("p_partkey", "p_brand", "p_size")


@query
def form_insert_vertex(g):
    execute(g, '(insert-vertex "part" (hashmap p_partkey 900000001 p_name "new part"))')
    return g.vertices("part").select("p_partkey", "p_name")


@query
def form_update_cell(g):
    execute(g, '(update-cell "customer" 42 (hashmap c_mktsegment "UPDATED"))')
    return g.vertices("customer").select("c_custkey", "c_mktsegment")


@query
def form_delete_vertex(g):
    execute(g, '(delete-vertex "part" 5)')
    return _key(g.degrees("orders", "contains", OUT), "degree")


@query
def form_select_edge(g):
    return _ends(execute(g, '(select-edge "contains" (id "orders" 7) outbound)'), *_edge("l_linenumber", "l_quantity", "l_returnflag"))


@query
def form_update_edge(g):
    execute(g, '(update-edge "contains" (id "orders" 7) (id "part" 5) (hashmap l_returnflag "X"))')
    return _ends(g.edges(("orders", 7), "contains", OUT), *_edge("l_linenumber", "l_returnflag"))


@query
def form_insert_edge(g):
    execute(g, '(insert-edge "contains" (id "orders" 7) (id "part" 5) (hashmap l_linenumber 99))')
    return _ends(g.edges(("orders", 7), "contains", OUT), *_edge("l_linenumber"))


@query
def form_delete_edge(g):
    part = g.edges(("orders", 7), "contains", OUT).agg(F.min("o_key")).first()[0]
    execute(g, f'(delete-edge "contains" (id "orders" 7) (id "part" {part}))')
    return _key(g.degrees("orders", "contains", OUT), "degree")


@query
def form_update_vertex(g):
    execute(g, '(update-vertex "customer" 42 (hashmap c_mktsegment "UPDATED"))')
    return g.vertices("customer").select("c_custkey", "c_mktsegment")


@query
def form_insert_cell(g):
    execute(g, '(insert-cell "part" (hashmap p_partkey 900000001 p_name "new part"))')
    return g.vertices("part").select("p_partkey", "p_name")


@query
def form_select_cell(g):
    return execute(g, '(select-cell "part" (hashmap p_type "PROMO" p_size 45))').select("p_partkey", "p_brand")


@query
def form_delete_cell(g):
    execute(g, '(delete-cell "part" 5)')
    return _key(g.degrees("orders", "contains", OUT), "degree")


@query
def deg_one(g):
    return _key(g.degrees(("orders", [7, 8, 999999999]), "contains", OUT), "degree")


@query
def cell_types_one(g):
    return g.cell_types(("customer", 42), OUT).select(F.col("v_key").alias("id"), "direction", "edge_schema")


@query
def txn_get_vertex(g):
    with g.transaction() as txn:
        found = txn.vertex_by_key("customer", 42)
        txn.update_vertex_by_key("customer", 43, lambda v: v | {"c_mktsegment": found["c_mktsegment"]})
    return g.vertices("customer").select("c_custkey", "c_mktsegment")


@query
def txn_conflict(g):
    """Two transactions on one base: the second is refused, the first one's change stays."""
    try:
        with g.transaction() as late:
            late.update_vertex_by_key("customer", 42, lambda v: v | {"c_mktsegment": "LATE"})
            with g.transaction() as first:
                first.update_vertex_by_key("customer", 42, lambda v: v | {"c_mktsegment": "FIRST"})
    except TransactionError:
        pass
    return g.vertices("customer").select("c_custkey", "c_mktsegment")


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, for a stream's progress; a local one on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="vertexloom-")
    return f"{root.rstrip('/')}/vertexloom/{uuid.uuid4().hex}"


def _placed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of ``placed`` as they arrive: one row for each order."""
    table = f"{sf_dir}/orders.parquet"
    files = spark.readStream.schema(spark.read.parquet(table).schema).format("parquet")
    # a single file is a folder with that file alone
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    rows = files.load(table) if folder else files.option("pathGlobFilter", "orders.parquet").load(sf_dir)
    return rows.select(F.lit("customer").alias("a_schema"), F.col("o_custkey").alias("a_key"), F.lit("orders").alias("b_schema"), F.col("o_orderkey").alias("b_key"))


def _stream_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of edges linked batch by batch on top of those that are there, then counted."""
    g = sales_graph(spark, sf_dir)
    link_stream(g, "placed", _placed_stream(spark, sf_dir), _folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return _key(g.degrees("customer", "placed", OUT), "degree")


def _stream_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running degrees over a stream of edges, as they stand when all has arrived."""
    g, folder = sales_graph(spark, sf_dir), _folder(spark)
    running = degree_stream(g, "placed", _placed_stream(spark, sf_dir), OUT)

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/counts/{n}")

    # complete mode: a batch holds the degrees of all so far, so the last one is the result
    stream = running.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    stream.awaitTermination()
    last = max((p["batchId"] for p in stream.recentProgress if p["numInputRows"]), default=None)
    if last is None:
        return spark.createDataFrame([], "id long, degree long")
    return _key(spark.read.parquet(f"{folder}/counts/{last}"), "degree")


QUERIES |= {"stream_link": _stream_link, "stream_degrees": _stream_degrees}


def _catalog_rows(g: Graph, rows: list[tuple], kind: str) -> DataFrame:
    return g.snapshot.spark.createDataFrame(rows, kind)


@query
def catalog_lookup(g):
    """Names, ids and kinds of groups found by name, by id and by schema; unknown ones too."""
    c = g.snapshot.catalog
    found = [*c.groups, *[c.find(x.id) for x in c.groups]]
    kind = lambda x: c.schema_type(x).value if c.schema_type(x) else None
    return _catalog_rows(g, [(x.name, c.id_of(x.name), kind(x.id)) for x in found] + [("nothing", c.id_of("nothing"), kind("nothing"))], "name string, id int, kind string")


@query
def catalog_fields(g):
    """The cells' fields: hidden ones first, then those declared."""
    c = g.snapshot.catalog
    return _catalog_rows(g, [(n, i, f) for n in ("region", "in_region", "contains", "traded") for i, f in enumerate(c.cell_fields(n))], "name string, place int, field string")


@query
def catalog_schema(g):
    """The columns of groups, and none for an unknown one."""
    rows = [(n, f.name, f.dataType.simpleString()) for n in ("nation", "placed") for f in g.group_schema(n)]
    return _catalog_rows(g, rows + [("nothing", str(g.group_schema("nothing")), None)], "name string, field string, type string")


@query
def catalog_changes(g):
    """Groups of either kind come, one goes, and subscribers are told; the rest is as before."""
    told = []
    g.subscribe(lambda what, schema: told.append((what, schema.name, schema.id)))
    g.new_vertex_group(GraphSchema("place", "name", (Field("name"),)))
    g.new_edge_group(GraphSchema("near", None, (Field("metres", "u32"),)), EdgeAttributes(EdgeType.UNDIRECTED, True))
    g.drop_group("performed")
    left = g.snapshot.catalog
    return _catalog_rows(g, [*told, ("count", "groups", left.count()), ("id_of", "performed", left.id_of("performed"))], "what string, name string, id int")


@query
def catalog_saved(g):
    """The catalog after a way through its JSON text."""
    c = g.snapshot.catalog
    return type(c).from_json(c.to_json()).frame(g.snapshot.spark).select("id", "name", "kind", "edge_type", "has_body")


ORACLE_SQL: dict[str, str] = {
    "v_by_key": """
        SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey = 42""",
    "v_by_keys": """
        SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey IN (3, 5, 8, 13, 999999999)""",
    "v_filter": """
        SELECT p_partkey, p_brand, p_size FROM part WHERE p_size > 40 AND p_type = 'PROMO'""",
    "deg_out": """
        SELECT o_orderkey AS id, count(l_orderkey) AS degree FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    "deg_in": """
        SELECT p_partkey AS id, count(l_partkey) AS degree FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey""",
    "deg_wrong_direction": """
        SELECT o_orderkey AS id, CAST(0 AS BIGINT) AS degree FROM orders""",
    "deg_undirected_simple": """
        WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem) SELECT 'supplier' AS vschema, s_suppkey AS id, count(e.a) AS degree FROM
        supplier LEFT JOIN e ON e.a = s_suppkey GROUP BY s_suppkey UNION ALL SELECT 'part', p_partkey, count(e.b) FROM part LEFT JOIN e ON e.b = p_partkey
        GROUP BY p_partkey""",
    "deg_undirected_body": """
        SELECT 'supplier' AS vschema, s_suppkey AS id, count(l_suppkey) AS degree FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey
        UNION ALL SELECT 'part', p_partkey, count(l_partkey) FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey""",
    "deg_self_loop": """
        WITH e AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey <=
        y.n_nationkey), i AS (SELECT a AS v FROM e UNION ALL SELECT b FROM e) SELECT v AS id, count(*) AS degree FROM i GROUP BY v""",
    "edges_out": """
        SELECT l_orderkey AS src_key, l_partkey AS dst_key, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_orderkey = 7""",
    "edges_in": """
        SELECT l_orderkey AS src_key, l_partkey AS dst_key, l_linenumber, l_quantity FROM lineitem WHERE l_partkey = 5""",
    "edges_filter": """
        SELECT l_orderkey AS src_key, l_partkey AS dst_key, l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'""",
    "edges_simple_body_null": """
        SELECT o_custkey AS src_key, o_orderkey AS dst_key, CAST(NULL AS VARCHAR) AS body FROM orders WHERE o_custkey = 42""",
    "edges_undirected_simple_orientation": """
        SELECT DISTINCT l_partkey AS a_key, l_suppkey AS b_key, 'part' AS a_schema, 'supplier' AS b_schema FROM lineitem WHERE l_partkey = 5""",
    "edges_undirected_body_orientation": """
        SELECT l_suppkey AS a_key, l_partkey AS b_key, l_quantity, 'supplier' AS a_schema, 'part' AS b_schema FROM lineitem WHERE l_partkey = 5""",
    "opposite_vertex": """
        SELECT l_partkey AS anchor, l_orderkey AS opposite FROM lineitem WHERE l_partkey < 50""",
    "nbr_out": """
        SELECT l_orderkey AS anchor, p_partkey, p_name, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = 7""",
    "nbr_in": """
        SELECT l_partkey AS anchor, o_orderkey, o_orderstatus, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = 5""",
    "nbr_undirected": """
        SELECT DISTINCT l_partkey AS anchor, s_suppkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = 5""",
    "nbr_filter_vertex": """
        SELECT l_orderkey AS anchor, p_partkey, p_size FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 45""",
    "nbr_filter_edge": """
        SELECT l_orderkey AS anchor, p_partkey, l_discount FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_discount >= 0.09""",
    "nbr_filter_both": """
        SELECT l_orderkey AS anchor, p_partkey, p_brand, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 25 AND l_quantity > 40""",
    "nbr_parallel": """
        SELECT l_orderkey AS src_key, l_partkey AS dst_key, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    "nbr_two_hop": """
        SELECT o_custkey AS anchor, l_partkey AS part_key, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey < 20""",
    "nbr_chain_region": """
        SELECT r_name, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""",
    "cell_types": """
        SELECT DISTINCT * FROM (SELECT o_orderkey AS id, 'outbound' AS direction, 'contains' AS edge_schema FROM orders SEMI JOIN lineitem ON l_orderkey =
        o_orderkey UNION ALL SELECT o_orderkey, 'inbound', 'placed' FROM orders)""",
    "dyn_field": """
        SELECT event_id, user_id AS src_key, event_type AS dst_key, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""",
    "dyn_field_filter": """
        SELECT event_id, user_id AS src_key, value FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) > 90 AND event_type = 'purchase'""",
    "mut_new_vertex": """
        SELECT p_partkey, p_name FROM part UNION ALL SELECT 900000001, 'new part'""",
    "mut_link": """
        SELECT l_orderkey AS id, count(*) AS degree FROM (SELECT l_orderkey FROM lineitem UNION ALL SELECT 7 UNION ALL SELECT 7) GROUP BY l_orderkey""",
    "mut_update": """
        SELECT c_custkey, CASE WHEN c_custkey = 42 THEN 'UPDATED' ELSE c_mktsegment END AS c_mktsegment FROM customer""",
    "mut_remove_edge": """
        SELECT l_orderkey AS src_key, l_partkey AS dst_key, l_linenumber FROM lineitem WHERE l_orderkey <> 7""",
    "mut_remove_one_of_two": """
        SELECT * FROM (VALUES (1, 2), (3, 4)) t(src_key, dst_key)""",
    "mut_remove_vertex": """
        SELECT o_orderkey AS id, count(l_orderkey) AS degree FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_partkey <> 5) ON l_orderkey = o_orderkey
        GROUP BY o_orderkey""",
    "mut_rollback": """
        SELECT count(*) AS n FROM part""",
    "catalog_count": "SELECT CAST(16 AS BIGINT) AS n",
    "form_update_edge": """
        SELECT l_orderkey AS src_key, l_partkey AS dst_key, l_linenumber, CASE WHEN l_partkey = 5 THEN 'X' ELSE l_returnflag END AS l_returnflag
        FROM lineitem WHERE l_orderkey = 7""",
}
#: The groups of the sales graph in order of their ids.
_GROUPS = """(VALUES (1, 'region', 'vertex', NULL, NULL, 'r_regionkey', ['r_regionkey', 'r_name'], false),
    (2, 'nation', 'vertex', NULL, NULL, 'n_nationkey', ['n_nationkey', 'n_name', 'n_regionkey'], false),
    (3, 'customer', 'vertex', NULL, NULL, 'c_custkey', ['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment'], false),
    (4, 'supplier', 'vertex', NULL, NULL, 's_suppkey', ['s_suppkey', 's_name', 's_nationkey', 's_acctbal'], false),
    (5, 'part', 'vertex', NULL, NULL, 'p_partkey', ['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice'], false),
    (6, 'orders', 'vertex', NULL, NULL, 'o_orderkey', ['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority'], false),
    (7, 'event_type', 'vertex', NULL, NULL, 'event_type', ['event_type'], false),
    (8, 'in_region', 'edge', 'directed', false, NULL, [], false), (9, 'lives_in', 'edge', 'directed', false, NULL, [], false),
    (10, 'based_in', 'edge', 'directed', false, NULL, [], false), (11, 'placed', 'edge', 'directed', false, NULL, [], false),
    (12, 'contains', 'edge', 'directed', true, NULL, ['l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_returnflag', 'l_linestatus', 'l_shipdate'], false),
    (13, 'traded', 'edge', 'undirected', true, NULL, ['l_orderkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_returnflag', 'l_linestatus', 'l_shipdate'], false),
    (14, 'supplies', 'edge', 'undirected', false, NULL, [], false), (15, 'neighbour', 'edge', 'undirected', false, NULL, [], false),
    (16, 'performed', 'edge', 'directed', true, NULL, ['event_id', 'ts', 'value'], true)) t(id, name, kind, edge_type, has_body, key_field, fields, is_dynamic)"""
ORACLE_SQL |= {
    "catalog_groups": f"SELECT id, name, kind, edge_type, has_body, key_field, CAST(fields AS VARCHAR[]) AS fields, is_dynamic FROM {_GROUPS}",
    "catalog_saved": f"SELECT id, name, kind, edge_type, has_body FROM {_GROUPS}",
    "catalog_lookup": f"SELECT name, id, kind FROM {_GROUPS} UNION ALL SELECT name, id, kind FROM {_GROUPS} UNION ALL SELECT 'nothing', 0, NULL",
    "catalog_fields": f"""
        WITH h AS (SELECT name, CASE WHEN kind = 'vertex' THEN ['_outbound', '_inbound', '_undirected'] WHEN NOT has_body THEN []
            WHEN edge_type = 'directed' THEN ['_inbound', '_outbound'] ELSE ['_vertex_a', '_vertex_b'] END || fields AS f
            FROM {_GROUPS} WHERE name IN ('region', 'in_region', 'contains', 'traded'))
        SELECT name, CAST(i - 1 AS INTEGER) AS place, f[i] AS field FROM (SELECT name, f, unnest(range(1, len(f) + 1)) AS i FROM h)""",
    "catalog_schema": """
        SELECT * FROM (VALUES ('nation', 'n_nationkey', 'int'), ('nation', 'n_name', 'string'), ('nation', 'n_regionkey', 'int'), ('nothing', 'None', NULL)) t(name, field, type)""",
    "catalog_changes": """
        SELECT * FROM (VALUES ('added', 'place', 17), ('added', 'near', 18), ('deleted', 'performed', 16), ('count', 'groups', 17), ('id_of', 'performed', 0)) t(what, name, id)""",
    "stream_link": """
        SELECT c_custkey AS id, 2 * count(o_custkey) AS degree FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "stream_degrees": """
        SELECT o_custkey AS id, count(*) AS degree FROM orders GROUP BY o_custkey""",
    "deg_one": """
        SELECT k AS id, count(l_orderkey) AS degree FROM (VALUES (7::BIGINT), (8), (999999999)) v(k) LEFT JOIN lineitem ON l_orderkey = k GROUP BY k""",
    "cell_types_one": """
        SELECT DISTINCT o_custkey AS id, 'outbound' AS direction, 'placed' AS edge_schema FROM orders WHERE o_custkey = 42
        UNION ALL SELECT c_custkey, 'outbound', 'lives_in' FROM customer WHERE c_custkey = 42
        UNION ALL SELECT DISTINCT user_id, 'outbound', 'performed' FROM events WHERE user_id = 42""",
    "txn_get_vertex": """
        SELECT c_custkey, CASE WHEN c_custkey = 43 THEN (SELECT c_mktsegment FROM customer WHERE c_custkey = 42) ELSE c_mktsegment END AS c_mktsegment FROM customer""",
    "txn_conflict": """
        SELECT c_custkey, CASE WHEN c_custkey = 42 THEN 'FIRST' ELSE c_mktsegment END AS c_mktsegment FROM customer""",
    "form_insert_edge": """
        SELECT l_orderkey AS src_key, l_partkey AS dst_key, l_linenumber FROM lineitem WHERE l_orderkey = 7 UNION ALL SELECT 7, 5, 99""",
    "form_delete_edge": """
        SELECT o_orderkey AS id, count(l_orderkey) - CASE WHEN o_orderkey = 7 THEN 1 ELSE 0 END AS degree FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    "form_select_cell": """
        SELECT p_partkey, p_brand FROM part WHERE p_type = 'PROMO' AND p_size = 45""",
    "form_update_vertex": ORACLE_SQL["mut_update"],
    "form_insert_cell": ORACLE_SQL["mut_new_vertex"],
    "form_delete_cell": ORACLE_SQL["mut_remove_vertex"],
    "form_select_vertex": ORACLE_SQL["v_filter"],
    "form_insert_vertex": ORACLE_SQL["mut_new_vertex"],
    "form_update_cell": ORACLE_SQL["mut_update"],
    "form_delete_vertex": ORACLE_SQL["mut_remove_vertex"],
    "form_select_edge": ORACLE_SQL["edges_out"],
}

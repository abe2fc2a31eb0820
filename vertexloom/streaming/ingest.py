"""Edges and vertices that arrive as a stream, and degrees kept up to date over one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.graph import Graph
from ..plans.types import Direction, Kind


def link_stream(graph: Graph, group, stream: DataFrame, checkpoint: str, check: bool = True) -> DataStreamWriter:
    """Each micro-batch of edge rows is linked in a transaction of its own.

    A batch that breaks a rule fails the stream and leaves the graph as it was. A batch that is
    sent again after a failure of the driver is linked again, as the graph itself is in memory.
    """

    def commit(batch: DataFrame, _: int) -> None:
        # the batch's source is gone once it is over, so its rows are kept as a table
        from ..sources.store import _storable

        path = f"{checkpoint}/linked/{_}"
        _storable(batch).write.mode("overwrite").parquet(path)
        with graph.transaction() as txn:
            txn.link_many(group, graph.snapshot.spark.read.schema(batch.schema).parquet(path), check)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", f"{checkpoint}/progress")


def degree_stream(graph: Graph, group, stream: DataFrame, direction: Direction) -> DataFrame:
    """Running degrees (v_schema, v_key, degree) over a stream of edge rows of a group."""
    found = graph.snapshot.catalog.need(group, Kind.EDGE)
    sides = {Direction.OUTBOUND: "a", Direction.INBOUND: "b"}
    if direction in sides:
        s = sides[direction]
        seen = stream.select(F.col(f"{s}_schema").alias("v_schema"), F.col(f"{s}_key").alias("v_key"))
    else:
        ends = F.array(*[F.struct(F.col(f"{s}_schema").alias("v_schema"), F.col(f"{s}_key").alias("v_key")) for s in "ab"])
        seen = stream.select(F.inline(ends))
    directed = found.edge.edge_type.value == "directed"
    if directed != (direction is not Direction.UNDIRECTED):
        seen = seen.where(F.lit(False))
    return seen.groupBy("v_schema", "v_key").agg(F.count("*").alias("degree"))

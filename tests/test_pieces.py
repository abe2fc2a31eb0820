"""Pairs made distinct in pieces: their number grows with the input, what is counted stays the same."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vertexloom.plans.types import Direction
from vertexloom.queries import QUERIES
from vertexloom.sources import tables

BOTH = Direction.UNDIRECTED
SMALL = Path("/root/testdata/sf0.001")
#: Rows of the small tables, by which the keys of a copy are shifted.
ROWS = {"l_suppkey": 10, "l_partkey": 200, "s_suppkey": 10, "p_partkey": 200}


def copies(spark, folder: Path, times: int, lines=lambda df: df) -> str:
    """The small tables, with supplier, part and lineitem repeated with shifted keys."""
    folder.mkdir()
    for table in SMALL.glob("*.parquet"):
        if table.stem not in ("supplier", "part", "lineitem"):
            os.symlink(table, folder / table.name)
            continue
        df = spark.read.parquet(str(table)).crossJoin(F.broadcast(spark.range(times).withColumnRenamed("id", "_i")))
        df = df.withColumns({c: F.col(c) + F.col("_i") * ROWS[c] for c in df.columns if c in ROWS}).drop("_i")
        (lines(df) if table.stem == "lineitem" else df).coalesce(1).write.parquet(str(folder / table.name))
    return str(folder)


def wanted(spark, folder: str) -> dict:
    """Degrees counted by Spark's SQL over plain pairs."""
    pairs = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().na.drop()
    out = {}
    for name, key, column in (("supplier", "s_suppkey", "l_suppkey"), ("part", "p_partkey", "l_partkey")):
        rows = spark.read.parquet(f"{folder}/{name}.parquet").join(pairs, F.col(key) == F.col(column), "left").groupBy(key).agg(F.count(column).alias("n"))
        out |= {(name, r[key]): r["n"] for r in rows.collect()}
    return out


def found(spark, folder: str) -> dict:
    rows = QUERIES["deg_undirected_simple"](spark, folder).collect()
    out = {(r["vschema"], r["id"]): r["degree"] for r in rows}
    assert len(out) == len(rows)
    return out


def most_of_a_task(spark, folder: str) -> int:
    """The most edges that one task makes when the whole group is read."""
    rows = tables.sales_graph(spark, folder).edges(None, "supplies", BOTH)
    return rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_a_task_holds_a_piece_at_any_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "PIECE", 1000, raising=False)
    small, large = copies(spark, tmp_path / "x2", 2), copies(spark, tmp_path / "x12", 12)
    assert most_of_a_task(spark, large) < 1.5 * most_of_a_task(spark, small)
    assert found(spark, small) == wanted(spark, small) and found(spark, large) == wanted(spark, large)


def test_pairs_are_dealt_out_once_for_both_ends(spark):
    plan = QUERIES["deg_undirected_simple"](spark, str(SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and "REPARTITION_BY_NUM" in plan


def test_a_frequent_pair_and_missing_ends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "PIECE", 1000, raising=False)

    def odd(df):
        key = F.col("l_linenumber")
        part = F.when(key <= 3, F.lit(11)).when(key == 4, F.lit(None)).otherwise(F.col("l_partkey")).cast("long")
        return df.withColumns({"l_suppkey": F.when(key <= 3, F.lit(7)).when(key == 5, F.lit(None)).otherwise(F.col("l_suppkey")).cast("long"), "l_partkey": part})

    folder = copies(spark, tmp_path / "odd", 2, odd)
    assert found(spark, folder) == wanted(spark, folder)
    empty = copies(spark, tmp_path / "empty", 1, lambda df: df.where("false"))
    assert set(found(spark, empty).values()) == {0}


def test_pairs_known_by_key_or_changed_are_read_as_before(spark):
    g = tables.sales_graph(spark, str(SMALL))
    plan = g.edges(("part", 5), "supplies", BOTH)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_partkey,5)" in plan and "REPARTITION_BY_NUM" not in plan
    before = g.degrees(("part", [5]), "supplies", BOTH).first()["degree"]
    assert before == g.degrees("part", "supplies", BOTH).where("v_key = 5").first()["degree"] > 0
    g.remove_edges("supplies", F.col("b_key") == 5)
    left = {r["v_key"]: r["degree"] for r in g.degrees("part", "supplies", BOTH).collect()}
    assert left[5] == 0 and sum(left.values()) == g.edges(None, "supplies", BOTH).where("v_schema = 'part'").count()


@pytest.mark.parametrize("query", ["nbr_undirected", "edges_undirected_simple_orientation"])
def test_point_queries_shuffle_no_pieces(spark, query):
    assert "REPARTITION_BY_NUM" not in QUERIES[query](spark, str(SMALL))._jdf.queryExecution().executedPlan().toString()

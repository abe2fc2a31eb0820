"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is its least node.

    Each round a node goes to the first of itself and its neighbours, then twice to where that
    one went; the links between what is left are kept once and the next round has only these.
    First comes the least node, in later rounds the least hash, so that the rounds grow with the
    logarithm of the nodes whatever order they stand in. Links and nodes stay tables; only
    counts reach the driver. Links may repeat and may join a node with itself; rows with a null
    end are left out.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    left, labels, made = scratch.save(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), None, 0
    while labels is None or left.limit(1).count():
        near = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a")
        if labels is None:
            to = near.agg(F.least(F.min("b"), F.col("a")).alias("to"))
        else:
            rank = lambda c: F.xxhash64(F.col(c), F.lit(made))
            to = near.agg(F.min_by("b", rank("b")).alias("b")).select("a", F.when(rank("b") < rank("a"), F.col("b")).otherwise(F.col("a")).alias("to"))
        to = scratch.save(to)
        for _ in range(2):
            to = to.join(to.select(F.col("a").alias("to"), F.col("to").alias("further")), "to").select("a", F.col("further").alias("to"))
        to = scratch.save(to)
        went = lambda c: to.select(F.col("a").alias(c), F.col("to").alias(f"to_{c}"))
        after = left.where("a <> b").join(went("a"), "a").join(went("b"), "b").where("to_a <> to_b")
        left = scratch.save(after.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        if labels is None:
            labels = to.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            labels = scratch.save(labels.join(went("component"), "component", "left").select("node", F.coalesce("to_component", "component").alias("component")))
        made += 1
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return scratch.save(labels.join(least, "component").select("node", F.col("least").alias("component"))) if made > 1 else labels

"""Connected components of a graph by contraction, as Spark joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadenz.llm.staging import stage


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges (a, b) from the greater to the smaller node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a long, b long); component is the smallest node reachable.

    Nodes are in the order of their hashes. Each round sends every node to its least neighbour, if that is smaller, and
    renames the edges. The renamed graph keeps an edge from each new name to where that name itself went, so nothing
    is cut apart. The order by hash makes rounds grow with the logarithm of a path's length, also where ids rise along
    it, as in chains of revisions. A hot node costs one row per task in the aggregation. The driver sees only whether
    edges are left.
    """
    key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id")).alias(c)
    edges = stage(_ordered(edges.where("a IS NOT NULL AND b IS NOT NULL").select(key("a"), key("b"))), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        to = stage(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("to")), "parents")
        if labels is None:
            labels = to.withColumnRenamed("to", "component")
        else:
            moved = labels.join(to.withColumnRenamed("node", "component"), "component", "left")
            labels = moved.select("node", F.coalesce("to", "component").alias("component"))
        labels = stage(labels, "labels")
        a = to.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        b = to.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        renamed = edges.join(a, "a").join(b, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
        went = to.select(F.col("to").alias("a")).distinct().join(a, "a").select("a", F.col("ta").alias("b"))
        edges = stage(_ordered(renamed.unionByName(went)), "edges")
    if labels is None:
        return edges.select(F.col("a.id").alias("node"), F.col("b.id").alias("component"))
    least = stage(labels.groupBy("component").agg(F.min("node.id").alias("least")), "least")
    return labels.join(least, "component").select(F.col("node.id").alias("node"), F.col("least").alias("component"))

"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settled


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (a, b), undirected; equal labels mark a component.

    In each round a node joins the neighbour of least random rank, if that is less than its own, and the graph is
    contracted; the rounds grow with the logarithm of the longest path. No row holds more than a node, and minima are
    folded before they are exchanged, so a hub costs no more than its edges.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    edges = settled(edges.select("a", "b").where("a <> b").distinct(), "edges")
    steps = []
    while not edges.isEmpty():
        before = edges
        both = edges.union(edges.select("b", "a"))
        joins = both.groupBy("a").agg(F.min(rank("b")).alias("least")).withColumn("own", rank("a"))
        joins = joins.select(F.col("a").alias("node"), F.least("least", "own")["id"].alias("to"))
        steps.append(settled(joins, "joins"))
        to = steps[-1]
        edges = edges.join(to.withColumnsRenamed({"node": "a", "to": "la"}), "a").join(to.withColumnsRenamed({"node": "b", "to": "lb"}), "b")
        low, high = F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")
        edges = settled(edges.where("la <> lb").select(low, high).distinct(), "edges", before)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = steps[0].withColumnRenamed("to", "label")
    for to in steps[1:]:
        labels = labels.join(to.withColumnsRenamed({"node": "label", "to": "next"}), "label", "left")
        labels = labels.select("node", F.coalesce("next", "label").alias("label"))
    return settled(labels, "labels", *steps)

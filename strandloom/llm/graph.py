"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of undirected edges (a, b); component: its smallest node.

    Nodes take the least label among their neighbours, then their label's label, until none changes.
    Labels and edges are shuffled, never collected; each round is settled in the shared folder.
    Loops and edges with a null end are left out, edges may repeat, and no edges give no rows.
    """
    with scratch() as own:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
        both = settle(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).filter("node <> other").distinct(), "edges")
        labels = settle(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
        while True:
            near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
            hooked = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
            jumps = labels.select(F.col("node").alias("new"), F.col("component").alias("jump"))
            moved = settle(hooked.join(jumps, "new").select("node", "old", F.least("new", "jump").alias("component")), "labels")
            labels = moved.select("node", "component")
            if moved.filter("component <> old").isEmpty():
                return own.keep(labels, "labels")

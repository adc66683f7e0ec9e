"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallix.session import checkpoint


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of an undirected edge table; component is its smallest node.

    Each round a node takes the smallest label of its neighbours and then the label of that label (pointer
    jumping), so the rounds grow with the logarithm of the longest path in practice. Labels are cut off by
    checkpoint() each round; the loop ends when none changes. Neighbour labels are pre-aggregated before they are
    shuffled, so a node with very many edges is no single task.

    Defined cases: edges with a null end are left out; a loop makes its node a component; repeated edges change
    nothing; an empty table gives no rows.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    e = checkpoint(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = checkpoint(e.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("component")))
    while True:
        near = e.join(labels, e["y"] == labels["node"]).groupBy("x").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["node"] == near["x"], "left").select("node", F.least("component", F.coalesce("m", "component")).alias("to"), F.col("component").alias("old"))
        up = step.select(F.col("node").alias("n2"), F.col("to").alias("to2"))
        new = checkpoint(step.join(up, step["to"] == up["n2"], "left").select("node", F.least("to", F.coalesce("to2", "to")).alias("component"), "old"))
        changed = not new.where("component <> old").isEmpty()
        labels = new.drop("old")
        if not changed:
            return labels

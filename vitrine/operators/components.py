"""Connected components of a graph of string nodes by least labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.storage import save

#: Rounds after which something is wrong: labels settle within about twice the logarithm of the longest chain.
MOST_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of the edges (a, b) with the least node that it is connected with.

    Every round takes the least label among neighbours, by partial aggregates, then the label's own label. Rows with a
    null end are left aside. Joins are by shuffle: stored labels are compressed, so Spark would take them for few.
    """
    ends = edges.where("a is not null and b is not null").select("a", "b")
    both = save(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    for _ in range(MOST_ROUNDS):
        near = both.join(labels.hint("merge"), both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near.hint("merge"), "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        roots = hooked.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = hooked.join(roots.hint("merge"), "component").select("node", "was", F.least("component", "root").alias("component"))
        moved = save(jumped, "labels")
        labels = moved.select("node", "component")
        if moved.where("was <> component").isEmpty():
            return labels
    raise RuntimeError("components didn't settle")

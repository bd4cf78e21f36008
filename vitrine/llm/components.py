"""Connected components of an edge table: union-find inside partitions, then star rounds between them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import save


def _forest(batches):
    """Union-find over one partition's edges; gives each node's link to the smallest node of its tree."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    pairs = [(x, r) for x in list(parent) if (r := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges u > v.

    Large: every node hands its larger neighbours to the smallest node of its neighbourhood.
    Small: every node hands its smaller neighbours and itself to the smallest of them.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): every node that has an edge, with the smallest node reachable from it.

    edges: (a, b) long, any direction, repeats and loops allowed; an empty table gives an empty result.
    Each round is written to the shared folder, so lineage stays short; raises if `rounds` don't suffice.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    now = save(pairs.mapInArrow(_forest, "u long, v long"), "forest")
    sums = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003))
    before = now.agg(sums).first()[0]
    if before[0]:
        for _ in range(rounds):
            now = save(_star(_star(now, True), False), "stars")
            after = now.agg(sums).first()[0]
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components: not settled after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

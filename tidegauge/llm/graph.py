"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import stored


def _to_smallest(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Tie the neighbours of each node u to the smallest node m around it. `edges` has (u, v).

    With larger_only, neighbours above u are tied to m, from both directions of each edge (large star); without, u and
    the neighbours below it (small star; edges then point down already).
    """
    around = edges.union(edges.select("v", "u")) if larger_only else edges
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    if larger_only:
        near = around.join(least.select("u", F.least("u", "m").alias("m")), "u")
        tied = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        near = edges.join(least, "u")
        tied = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return tied.filter("u <> v").distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) for every node of an edge table (u, v): root is the smallest node it is connected to; roots are left out.

    Large and small stars take turns until nothing moves. Every step is an aggregation and a join by node, written under
    `folder`, so neither a large component nor a hub has to fit into one task.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    before, turn = None, 0
    while True:
        now = stored(_to_smallest(_to_smallest(now, True), False), f"{folder}/turn-{turn}")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if before == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, turn = state, turn + 1

"""Connected components of an edge table by hooking each node to its least neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.runtime import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v); roots are the same within a component and differ between.

    A round maps every node to the least of itself and its neighbours (a map-side combined minimum, so
    a node of many links costs no more than its tasks), follows that pointer twice and contracts. Each
    round is written to shared storage. The edge count falls at least by half a round.
    """
    found, edges = None, materialise(edges.select("u", "v").filter("u != v").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy("u").agg(F.min("v").alias("p")).select(F.col("u").alias("node"), F.least("u", "p").alias("p"))
        up = materialise(up, "hook")
        for _ in range(2):
            above = up.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            up = up.join(above, "p").select("node", F.col("pp").alias("p"))
        up = materialise(up, "jump")
        a, b = up.select(F.col("node").alias("u"), F.col("p").alias("pu")), up.select(F.col("node").alias("v"), F.col("p").alias("pv"))
        edges = edges.join(a, "u").join(b, "v").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).filter("u != v").distinct()
        edges = materialise(edges, "edges")
        up = up.select("node", F.col("p").alias("root"))
        if found is None:
            found = up
        else:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = materialise(found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
    return found if found is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))

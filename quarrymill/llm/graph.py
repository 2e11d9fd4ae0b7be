"""Connected components by alternating large-star and small-star steps, each a shuffle, with every step written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, hot_keys, save


def connected_components(edges: DataFrame, path: str, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) long, in any order and with repeats -> (id, component): the smallest id reachable.

    Ids without an edge to another id are absent. Nulls and loops are ignored; no edges give an empty table. A node's minimum and degree
    are one aggregate with map-side combine; where the minimum is joined back, hubs with over a thousandth of all edges are dealt to as many
    tasks as they have thousandths.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = save(e, f"{path}/0")
    for k in range(1, most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nodes = save(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"{path}/nodes-{k}")
        # all trees are stars around their smallest ids once every node with a smaller neighbour has no other
        if nodes.where("m < u and n > 1").isEmpty():
            return nodes.select(F.col("u").alias("id"), F.least("u", "m").alias("component"))
        hot = hot_keys(nodes, ["u"], 2 * e.count())
        low = nodes.select("u", F.least("u", "m").alias("m"))
        large = dealt_join(both, low, ["u"], "v", hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # a node has no more rows here than it had neighbours, so that the same nodes are hot at most
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = dealt_join(large, low, ["u"], "v", hot).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        e = save(small, f"{path}/{k}")
    raise RuntimeError(f"components not settled after {most_rounds} rounds")

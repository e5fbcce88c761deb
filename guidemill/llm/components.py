"""Connected components by edge contraction, entirely in DataFrames.

Every round points each node to the smallest of itself and its neighbours and contracts the edges along these
pointers.  Each node that is no local minimum disappears, so at least half of the nodes go per round and the
edge tables shrink geometrically.  The smallest node of a component points to itself in every round and is
therefore the final label.  A hub node appears in joins whose other side has one row per node (split by the
adaptive skew join) and in minimum aggregates that combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidemill.llm.common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that occurs in an edge; component is the smallest node reachable.

    Edges may repeat, run either way, or be loops; rows with a null end are ignored.  No edges: no rows.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    graph = materialize(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    levels: list[DataFrame] = []
    while not graph.isEmpty():
        hops = materialize(graph.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to")), "hops")
        levels.append(hops)
        moved = (
            graph.join(hops.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a")
            .join(hops.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b")
            .where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct())
        graph = materialize(moved, "edges")
    if not levels:
        return graph.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = levels[-1].select("node", F.col("to").alias("component"))
    for level in reversed(levels[:-1]):
        later = found.select(F.col("node").alias("to"), "component")
        found = level.join(later, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    return materialize(found, "components") if len(levels) > 1 else found

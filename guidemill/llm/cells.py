"""Bucketed comparison in bounded cells.

Members of one bucket (table, key) have to be compared with each other.  A bucket of up to ``block`` members
is one cell.  A larger one is dealt into blocks by a hash of the member, and each pair of blocks is a cell of
its own, so no task ever holds more than ``2 * block`` members and a hot bucket spreads over many tasks.
Comparisons happen inside the cell; only links found leave it, never all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ["table", "key", "cell_a", "cell_b"]


def deal_cells(members: DataFrame, node: str, block: int, payload: DataFrame | None = None) -> DataFrame:
    """Members with their cells, partitioned and sorted by cell; ``side`` is the member's block.

    Buckets of one member are dropped, as they hold no pair; only the others get the ``payload``, one row per node.
    """
    sizes = members.groupBy("table", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.col(node)), F.col("blocks").cast("bigint")).cast("int")
    rest = members.join(sizes, ["table", "key"])
    return (
        (rest if payload is None else rest.join(payload, node)).withColumn("blocks", blocks).withColumn("side", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("cell_a", F.least("side", "other")).withColumn("cell_b", F.greatest("side", "other"))
        .drop("size", "blocks", "other").repartition(*[F.col(c) for c in CELL]).sortWithinPartitions(*CELL))

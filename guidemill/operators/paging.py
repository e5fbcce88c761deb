"""Pages of an ordered table: an order index for deep pages, and reads that go on after a key.

The index is the table in order, cut into ranges of keys and stored by range, with each row's place in its range; a short
list says how many rows lie before each range.  A page reads the one or two ranges it lies in and picks its places there: no row
before it is read or sorted.  Reads after a key need no index: Spark keeps the first rows beyond the key per task.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guidemill.session import ensure_checkpoint_dir

RANGE, PLACE = "_range", "_place"
_PLACE_BITS = 33  # low bits of Spark's increasing ids: number of the row in its task


def sort_columns(order: Sequence[tuple[str, bool]]) -> list[Column]:
    """(column, ascending) as sort columns; nulls come first ascending and last descending."""
    return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order]


@dataclass
class OrderIndex:
    rows: DataFrame  # the rows with their range and the place in it, from 0
    ranges: DataFrame  # range, rows in it, rows before it; one row a range
    order: list[tuple[str, bool]]
    columns: list[str]


def build_order(rows: DataFrame, order: Sequence[tuple[str, bool]], ranges: int | None = None) -> OrderIndex:
    """Index of ``rows`` in a total order; ``ranges`` should give ranges of a few hundred thousand rows.

    Rows equal in all columns of the order stand in some order that stays as it was written.
    """
    spark = rows.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = sort_columns(order)
    number = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(n, *columns).sortWithinPartitions(*columns).withColumn("_id", number).withColumns({
        RANGE: F.shiftright("_id", _PLACE_BITS).cast("int"), PLACE: F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))}).drop("_id")
    path = f"{ensure_checkpoint_dir(spark)}/order-{uuid.uuid4().hex}"
    placed.write.partitionBy(RANGE).parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    stored = spark.read.schema(placed.schema).parquet(path)
    counts = stored.groupBy(RANGE).agg(F.count(F.lit(1)).alias("rows")).checkpoint()
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    return OrderIndex(stored, counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).checkpoint(), list(order), rows.columns)


def row_total(index: OrderIndex) -> int:
    return index.ranges.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]


def page(index: OrderIndex, skip: int, limit: int) -> DataFrame:
    """The rows at positions skip .. skip + limit - 1; reads the ranges that hold them and no others."""
    if skip < 0 or limit < 0:
        raise ValueError("skip and limit must not be negative")
    held = index.ranges.where((F.col("before") < skip + limit) & (F.col("before") + F.col("rows") > skip)).orderBy("before").collect()
    picked = [(F.col(RANGE) == r[RANGE]) & F.col(PLACE).between(max(skip - r["before"], 0), skip + limit - r["before"] - 1) for r in held]
    found = index.rows.where(reduce(lambda a, b: a | b, picked, F.lit(False)))
    return found.orderBy(RANGE, PLACE).select(*index.columns)


def with_position(index: OrderIndex, position: str = "position") -> DataFrame:
    """All rows with their position in the whole order, from 0."""
    return index.rows.join(F.broadcast(index.ranges.select(RANGE, "before")), RANGE).select(
        *index.columns, (F.col("before") + F.col(PLACE)).alias(position))


def page_keys(index: OrderIndex, size: int) -> DataFrame:
    """First key of every page of ``size`` rows: (page, order columns)."""
    if size < 1:
        raise ValueError("a page holds at least one row")
    at = with_position(index).where(F.col("position") % size == 0)
    return at.select(F.floor(F.col("position") / size).cast("bigint").alias("page"), *[c for c, _ in index.order])


def beyond(order: Sequence[tuple[str, bool]], key: Mapping[str, object], included: bool = False) -> Column:
    """True for rows that stand after ``key`` in the order (or at it, if ``included``); a null in the key is the null of the order."""
    result = F.lit(included)
    for c, up in reversed(order):
        value, column = key[c], F.col(c)
        if value is None:
            after, same = (column.isNotNull() if up else F.lit(False)), column.isNull()
        else:
            same = column.eqNullSafe(F.lit(value))
            after = F.coalesce(column > F.lit(value), F.lit(False)) if up else F.coalesce(column < F.lit(value), F.lit(True))
        result = after | (same & result)
    return result


def page_after(rows: DataFrame, order: Sequence[tuple[str, bool]], key: Mapping[str, object] | None, limit: int, included: bool = False) -> DataFrame:
    """The next ``limit`` rows after ``key`` (all rows from the first on without one)."""
    ahead = rows if key is None else rows.where(beyond(order, key, included))
    return ahead.orderBy(*sort_columns(order)).limit(limit)

"""Pages from the order index and after a key against the sorted list."""

import random

import pytest
from pyspark.sql import functions as F

from guidemill.operators import paging

ORDER = [("a", True), ("b", False), ("id", True)]


def plain(rows):
    """Nulls first ascending, last descending."""
    return sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), (r[2] is None, -(r[2] or 0)), r[0]))


@pytest.fixture(scope="module")
def made(spark):
    pick = random.Random(5)
    rows = [(i, pick.choice([None, 1, 1, 1, 2, 7]), pick.choice([None, 0, 3, 4])) for i in range(500)]
    return rows, spark.createDataFrame(rows, "id int, a int, b int").repartition(7)


def test_every_page_equals_the_offset_form(made):
    rows, df = made
    want, index = plain(rows), paging.build_order(df, ORDER, 6)
    assert paging.row_total(index) == 500
    for skip, limit in [(0, 7), (3, 0), (93, 60), (250, 250), (499, 5), (500, 3), (0, 1000)]:
        assert [tuple(r) for r in paging.page(index, skip, limit).collect()] == want[skip: skip + limit]
    placed = paging.with_position(index).collect()
    assert sorted((r["position"], r["id"]) for r in placed) == [(n, r[0]) for n, r in enumerate(want)]
    assert sorted(map(tuple, paging.page_keys(index, 60).collect())) == [(n, want[60 * n][1], want[60 * n][2], want[60 * n][0]) for n in range(9)]
    with pytest.raises(ValueError):
        paging.page(index, -1, 5)


def test_a_deep_page_reads_its_range_alone(made):
    index = paging.build_order(made[1], ORDER, 6)
    plan = paging.page(index, 450, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_range" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = paging.page(index, 495, 5).select(F.input_file_name().alias("f")).distinct().count()
    assert files == 1


def test_reads_after_a_key(made):
    rows, df = made
    want = plain(rows)
    for at in (0, 4, 90, 137, 300, 498, 499):
        key = dict(zip(("id", "a", "b"), want[at]))
        assert [tuple(r) for r in paging.page_after(df, ORDER, key, 15).collect()] == want[at + 1: at + 16]
        assert [tuple(r) for r in paging.page_after(df, ORDER, key, 15, included=True).collect()] == want[at: at + 15]
    assert [tuple(r) for r in paging.page_after(df, ORDER, None, 9).collect()] == want[:9]


def test_hot_and_empty(spark):
    same = spark.range(300).select(F.lit(1).alias("a"), F.lit(2).alias("b"), F.col("id").cast("int").alias("id"))
    index = paging.build_order(same, ORDER, 4)
    assert [r["id"] for r in paging.page(index, 120, 30).collect()] == list(range(120, 150))
    assert index.ranges.count() > 1  # one value of the first column spreads by the next
    none = paging.build_order(same.limit(0), ORDER, 4)
    assert paging.page(none, 0, 5).count() == 0 and paging.row_total(none) == 0 and paging.page_keys(none, 5).count() == 0

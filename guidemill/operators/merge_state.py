"""Metadata of any number of rows merged through a partial state.

A state is a frame of entries: a label with the place where it appears first, the newest value of a field, or an item of a list with
its place.  States of parts of the rows are combined into the state of all of them, in any order and grouping, so a day's rows are merged
into what is held without reading the earlier rows.  Labels and values are reduced before they travel; items of lists stay rows and are
never gathered, so a group may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidemill.sources.tables import written

SETS = ("tax_years", "keywords", "topics", "business_types")
LISTS = ("thresholds", "forms", "key_dates")


def _entry(part: str, field: str, value: Column, order: str, pos: Column) -> Column:
    return F.struct(F.lit(part).alias("part"), F.lit(field).alias("field"), value.alias("value"),
                    F.struct(F.col(order).alias("row"), pos.cast("int").alias("pos")).alias("at"))


def _elements(part: str, field: str, order: str, text) -> Column:
    return F.coalesce(F.transform(F.col(field), lambda x, i: _entry(part, field, text(x), order, i)), F.array())


def merge_state(rows: DataFrame, by: Sequence[str], order: str, sets: Sequence[str] = SETS, lists: Sequence[str] = LISTS, newest: Sequence[str] = ()) -> DataFrame:
    """State of ``rows``: (by .., part, field, value, at); ``order`` ranks the rows of a group and is unique in it.

    ``sets`` are arrays of strings, ``lists`` arrays of anything, ``newest`` single values.  Null arrays, labels and values add nothing.
    Labels, values and items are reduced apart, so the entries are written once; ``rows`` may be costly and are evaluated once.
    """
    sources = [_elements("set", c, order, lambda x: x.cast("string")) for c in sets]
    sources += [_elements("list", c, order, lambda x: F.to_json(F.struct(x.alias("v")))) for c in lists]
    if newest:
        sources.append(F.array(*[_entry("newest", c, F.col(c).cast("string"), order, F.lit(0)) for c in newest]))
    entries = rows.select(*by, F.explode(F.concat(*sources)).alias("_e")).select(*by, "_e.*").where("value IS NOT NULL")
    return _reduced(written(entries, "entries"), by)


def _reduced(entries: DataFrame, by: Sequence[str]) -> DataFrame:
    labels = entries.where("part = 'set'").groupBy(*by, "part", "field", "value").agg(F.min("at").alias("at"))
    values = entries.where("part = 'newest'").groupBy(*by, "part", "field").agg(F.max(F.struct("at", "value")).alias("_m")).select(
        *by, "part", "field", "_m.value", "_m.at")
    return entries.where("part = 'list'").unionByName(labels).unionByName(values)


def combine(states: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """One state of several; every row of the source is in exactly one of them."""
    return _reduced(reduce(DataFrame.unionByName, states), by)


def merged_labels(state: DataFrame, by: Sequence[str], sets: Sequence[str] = SETS, newest: Sequence[str] = (), lists: Sequence[str] = ()) -> DataFrame:
    """One row per group: label sets in order of first appearance, newest values, and ``n_<list>`` items of each list.

    Groups whose rows hold no label, value or item have no entries and no row.
    """
    def labels(field: str) -> Column:
        found = F.collect_list(F.when((F.col("part") == "set") & (F.col("field") == field), F.struct("at", "value")))
        return F.transform(F.array_sort(found), lambda x: x["value"]).alias(field)

    slim = state.where("part <> 'list'").select(*by, "part", "field", "value", "at", F.lit(0).cast("bigint").alias("n"))
    counts = state.where("part = 'list'").groupBy(*by, "part", "field").agg(F.count(F.lit(1)).alias("n"))
    every = slim.unionByName(counts, allowMissingColumns=True)
    return every.groupBy(*by).agg(
        *[labels(c) for c in sets],
        *[F.max(F.when((F.col("part") == "newest") & (F.col("field") == c), F.col("value"))).alias(c) for c in newest],
        *[F.coalesce(F.sum(F.when((F.col("part") == "list") & (F.col("field") == c), F.col("n"))), F.lit(0)).alias(f"n_{c}") for c in lists])


def merged_items(state: DataFrame, by: Sequence[str], field: str, item_type: str) -> DataFrame:
    """(by .., row, pos, item): the joined list of a field as rows, in order of row and pos."""
    item = F.from_json("value", f"v {item_type}")["v"]
    return state.where((F.col("part") == "list") & (F.col("field") == field)).select(*by, F.col("at.row").alias("row"), F.col("at.pos").alias("pos"), item.alias("item"))

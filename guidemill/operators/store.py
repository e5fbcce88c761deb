"""Stored frames: insert, update, delete, filter, page, validate.

A store is a DataFrame snapshot; every change yields a new snapshot from one join.  Changes come as
frames, so one row or a billion take the same single pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def insert_new(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Append rows whose key is not stored; missing columns become null.

    Of several new rows with one key the first in the order of their values is taken.
    """
    order = Window.partitionBy(key).orderBy(F.to_json(F.struct(*[c for c in rows.columns])))
    once = rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
    fresh = once.join(stored.select(key), key, "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True)


def update(stored: DataFrame, changes: DataFrame, key: str, stamps: Mapping[str, Column] | None = None) -> DataFrame:
    """Overwrite the fields that are set (not null) in ``changes``; ``stamps`` apply to changed rows.

    ``changes`` has at most one row per key.
    """
    fields = [c for c in changes.columns if c != key]
    ch = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_hit"))
    out = stored.join(ch, key, "left")
    cols = []
    for c in stored.columns:
        value = F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in fields else F.col(c)
        if stamps and c in stamps:
            value = F.when(F.col("_hit"), stamps[c]).otherwise(value)
        cols.append(value.alias(c))
    return out.select(*cols)


def matched_count(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """How many stored rows a change or delete touches."""
    return stored.join(keys.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("matched"))


def delete(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key).distinct(), key, "left_anti")


def delete_cascade(frames: Mapping[str, DataFrame], keys: DataFrame, key: str) -> dict[str, DataFrame]:
    """Delete from a parent and all frames that carry its key."""
    return {name: delete(df, keys, key) for name, df in frames.items()}


def keep_listed(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of a key list of any length."""
    return stored.join(keys.select(key).distinct(), key, "left_semi")


def find(stored: DataFrame, **equal) -> DataFrame:
    """Rows equal to every given value that is not None."""
    conds = [F.col(c) == v for c, v in equal.items() if v is not None]
    return stored.where(reduce(lambda a, b: a & b, conds)) if conds else stored


def page(df: DataFrame, order: Sequence[Column], skip: int, limit: int) -> DataFrame:
    """One page in a total order."""
    return df.orderBy(*order).offset(skip).limit(limit)


def name_contains(column: str, part: str) -> Column:
    """Case-insensitive substring test; the part is taken literally."""
    escaped = part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.col(column).ilike(f"%{escaped}%")


def violations(df: DataFrame, rules: Mapping[str, Column], key: str) -> DataFrame:
    """(key, rule) for each row and rule that does not hold; null counts as a violation."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
    return df.select(key, F.explode_outer(broken).alias("rule")).where(F.col("rule").isNotNull())


def metadata_json(chunks: DataFrame, fields: Sequence[str], defaults: Mapping[str, str] | None = None) -> DataFrame:
    """Metadata document per chunk for a vector store: defaults applied, empty values left out."""
    types = dict(chunks.dtypes)

    def field(c: str) -> Column:
        v = F.col(c)
        if types[c] == "string":
            v = F.nullif(v, F.lit(""))
            if defaults and c in defaults:
                v = F.coalesce(v, F.lit(defaults[c]))
        elif types[c].startswith("array"):
            v = F.when(F.size(v) > 0, v)
        return v.alias(c)

    return chunks.select("chunk_id", F.to_json(F.struct(*[field(c) for c in fields])).alias("metadata"))

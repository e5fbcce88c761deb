"""Documents with open keys as VARIANT columns: the vector-store row of a chunk, patches, keys over versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv

_OPEN = "map<string,variant>"


def _value(types: Mapping[str, str], name: str) -> Column:
    """The field without an empty text or list, and its default where it has one; an absent column is empty."""
    if name not in types:
        value = F.lit(None).cast("string")
    elif types[name] == "string":
        value = F.nullif(F.col(name), F.lit(""))
    elif types[name].startswith("array"):
        value = F.when(F.size(name) > 0, F.col(name))
    else:
        value = F.col(name)
    return F.coalesce(value, F.lit(fv.VECTOR_ROW_DEFAULTS[name])) if name in fv.VECTOR_ROW_DEFAULTS else value


def vector_rows(chunks: DataFrame, key: str = "chunk_id", more: str | None = None) -> DataFrame:
    """(key, metadata VARIANT): every field of the vector-store row that is not empty, defaults applied.

    ``more`` names a column with a json object of further keys; they are kept as they are, but a field of the row wins over them.
    A text that is no json object adds nothing.
    """
    types = dict(chunks.dtypes)
    row = F.parse_json(F.to_json(F.struct(*[_value(types, name).alias(name) for name in fv.VECTOR_ROW_FIELDS])))
    return chunks.select(key, (row if more is None else patched(F.try_parse_json(more), row)).alias("metadata"))


def keys_of(document: Column) -> Column:
    """The top level of a VARIANT object as a map; no object gives an empty map."""
    is_object = F.coalesce(F.schema_of_variant(document).startswith("OBJECT"), F.lit(False))
    held = F.when(is_object, document.cast(_OPEN))
    return F.coalesce(held, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))


def patched(document: Column, patch: Column, removed: Sequence[str] = ()) -> Column:
    """The document with the keys of ``patch`` put over its own; unknown keys survive, ``removed`` keys go."""
    new = keys_of(patch)
    kept = F.map_filter(keys_of(document), lambda k, _: ~F.map_contains_key(new, k))
    whole = F.map_filter(F.map_concat(kept, new), lambda k, _: ~k.isin(*removed) if removed else F.lit(True))
    return F.to_variant_object(whole)


def entries(rows: DataFrame, key: str, document: str) -> DataFrame:
    """(key, name, value as json) of all top-level keys."""
    return rows.select(key, F.explode(keys_of(F.col(document))).alias("name", "_value")).select(key, "name", F.to_json("_value").alias("value"))


def key_schema(rows: DataFrame, document: str, by: Sequence[str] = ()) -> DataFrame:
    """One type that holds all documents (of each group, for instance a version), as Spark's schema text."""
    return rows.groupBy(*by).agg(F.schema_of_variant_agg(document).alias("schema"))

"""Helpers shared by the training-data operators.

Null ids: an id of null never matches a label and is treated as held out, so nothing is learned from it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guidemill.session import ensure_checkpoint_dir


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write the frame as a Parquet table in the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.  The folder goes when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def held_out(id_column: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text falls into the fold that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))


def map_text(df: DataFrame, text_col: str, added: str, fn: Callable[[list[str]], list], keep_text: bool = False) -> DataFrame:
    """Append columns computed from whole texts, batch by batch; a null text is given to ``fn`` as empty.

    ``fn`` takes the texts of a batch and returns one sequence per column of the DDL string ``added``.  All
    other columns pass through Arrow untouched, nulls included.
    """
    fields = [f for f in df.schema.fields if keep_text or f.name != text_col]
    extra = T.StructType.fromDDL(added)
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            new = [v if isinstance(v, pa.Array) else pa.array(v, from_pandas=False) for v in fn(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + new, names=names + extra.names)

    return df.mapInArrow(run, T.StructType(fields + extra.fields))


def bounded_sample(df: DataFrame, id_col: str, bound: int) -> DataFrame:
    """About ``bound`` rows chosen by a hash of the id (all rows if there are no more).

    The share is taken in steps of 2^-40, so that the sample does not run empty on very large tables.
    """
    share = min(1.0, bound / max(1, df.count()))
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 40)) < int(share * (1 << 40)))


def sorted_groups(batches: Iterator, keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """From batches sorted by ``keys``: columns as arrays and the offsets of complete groups.

    The last, possibly incomplete group of a batch is carried into the next one, so a group is seen whole;
    callers bound the group size.
    """
    carry: dict[str, np.ndarray] | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        now = {c: pdf[c].to_numpy() for c in pdf.columns}
        if carry is not None:
            now = {c: np.concatenate([carry[c], now[c]]) for c in now}
        size = len(now[keys[0]])
        changed = np.zeros(size - 1, bool)
        for k in keys:
            changed |= now[k][1:] != now[k][:-1]
        starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
        if len(starts) > 1:
            yield {c: v[: starts[-1]] for c, v in now.items()}, starts
        carry = {c: v[starts[-1]:] for c, v in now.items()}
    if carry is not None:
        yield carry, np.array([0, len(carry[keys[0]])])


def group_labels(linked: np.ndarray) -> np.ndarray:
    """Smallest reachable index per row of a symmetric boolean matrix."""
    labels = np.arange(len(linked))
    while True:
        best = np.minimum(labels, np.where(linked, labels[None, :], len(labels)).min(axis=1))
        best = best[best]
        if (best == labels).all():
            return labels
        labels = best

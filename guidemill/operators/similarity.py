"""Exact cosine search of query vectors over a corpus, both of any size."""

from __future__ import annotations

from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096  # query vectors per pass over the corpus


def nearest(corpus: DataFrame, queries: DataFrame, k: int = 10, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` best corpus rows per query.

    Apply metadata filters to ``corpus`` first.  Each task scores its batches with one matrix product
    and keeps its own best ``k`` per query, so the exchange carries at most ``k`` rows per query and
    task, never the pairs.  Query vectors are read as a stream and sent to the tasks in blocks of fixed size, one pass
    over the corpus each.
    """
    stream = queries.select("query_id", vector).toLocalIterator()
    kind = dict(queries.dtypes)["query_id"]
    parts = [_scored(corpus, rows, kind, k, id_, vector) for rows in iter(lambda: list(islice(stream, BLOCK)), [])]
    partial = reduce(DataFrame.unionByName, parts or [_scored(corpus, [], kind, k, id_, vector)])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_)
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scored(corpus: DataFrame, rows: list, kind: str, k: int, id_: str, vector: str) -> DataFrame:
    """The best ``k`` of each task for a block of query vectors."""
    ids = [r[0] for r in rows]
    matrix = [list(map(float, r[1])) for r in rows]

    def best(batches):
        import numpy as np
        import pandas as pd

        if not ids:
            return
        q = np.asarray(matrix, dtype="float64")
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        kept = [[] for _ in ids]
        for pdf in batches:
            if not len(pdf):
                continue
            m = np.stack(pdf[vector].to_numpy()).astype("float64")
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            names = pdf[id_].to_numpy()
            scores = q @ m.T
            for i in range(len(ids)):
                order = np.lexsort((names, -scores[i]))[:k]
                merged = kept[i] + [(float(scores[i][j]), int(names[j])) for j in order]
                kept[i] = sorted(merged, key=lambda x: (-x[0], x[1]))[:k]
        out = [(ids[i], n, s) for i, part in enumerate(kept) for s, n in part]
        yield pd.DataFrame(out, columns=["query_id", id_, "score"])

    return corpus.select(id_, vector).mapInPandas(best, f"query_id {kind}, {id_} bigint, score double")


def centroids(corpus: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per label: (query_id, vector)."""
    parts = corpus.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(F.col(label).alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias(vector))

"""Vector search by inverted lists with residual codes, and exact search of the same shape.

Index: a coarse quantiser is trained by k-means on a bounded sample; every vector goes to the list of its nearest centre
and is coded as the 8-bit steps of its residual.  Search: a query visits the ``probes`` lists whose centres are nearest, scores the codes
there and keeps the best ``keep`` candidates; these are scored anew from the whole vectors.  Filters on metadata apply to the
index rows before any list is read, and a caller's expression over score and metadata gives the rerank score.

Queries are rows like vectors.  They meet in cells, (list, part), which are dealt so that no task holds more than a
bounded number of either; only the centres (lists x dimensions numbers) go to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guidemill.sources.tables import written

PART = 8192  # vectors of a cell
BLOCK = 2048  # queries of a cell


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector can be compared: not null, not empty, finite, not all zero.  The others are found by nothing and find nothing."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(ok, F.lit(False)) & F.exists(vector, lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    """Rows of a list column as unit vectors; all have one length."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(lists):
        return np.zeros((0, 1))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def train_centres(vectors: DataFrame, lists: int, sample: int = 65_536, rounds: int = 12, vector: str = "embedding") -> np.ndarray:
    """Centres of the lists by spherical k-means on at most ``sample`` vectors, chosen by a hash of their values.

    Fewer vectors than lists give as many centres as there are different vectors.
    """
    rows = usable(vectors, vector).select(F.col(vector).cast("array<double>").alias("v")).distinct().orderBy(F.xxhash64("v")).limit(sample).toArrow()
    x = _matrix(rows["v"])
    if not rows.num_rows:
        return np.zeros((0, 0))
    centres = x[:: max(1, len(x) // lists)][:lists].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


@dataclass
class VectorIndex:
    """Rows (id, metadata.., list, codes, scale) and the centres of the lists."""

    rows: DataFrame
    centres: np.ndarray
    id_col: str


def build_index(vectors: DataFrame, lists: int = 64, sample: int = 65_536, id_col: str = "vec_id", vector: str = "embedding") -> VectorIndex:
    """Index of every usable row; all columns but the vector stay as metadata."""
    centres = train_centres(vectors, lists, sample, vector=vector)
    metadata = [c for c in vectors.columns if c != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(vector))
            near = (x @ centres.T).argmax(axis=1) if len(x) else np.zeros(0, np.int64)
            rest = x - centres[near]
            scale = np.maximum(np.abs(rest).max(axis=1, initial=0.0), 1e-12) / 127
            codes = np.rint(rest / scale[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in metadata] + [pa.array(near, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale, pa.float64())],
                                             names=metadata + ["list", "codes", "scale"])

    schema = vectors.select(*metadata).schema
    for name, kind in (("list", "integer"), ("codes", "binary"), ("scale", "double")):
        schema = schema.add(name, kind)
    rows = usable(vectors, vector).select(*metadata, F.col(vector).cast("array<double>").alias(vector)).mapInArrow(run, schema) if len(centres) else \
        vectors.limit(0).select(*metadata, F.lit(0).alias("list"), F.lit(b"").alias("codes"), F.lit(0.0).alias("scale"))
    return VectorIndex(written(rows, "vector-index"), centres, id_col)


def _top(scores: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of a row of scores; equal scores by place."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((place[some], -scores[some]))[:k]]


def _cell(k: int, kinds, decode):
    """Best k vectors of a cell for each query of the cell."""
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[], [], []]
        if vectors.num_rows and queries.num_rows:
            ids = vectors["id"].combine_chunks()
            place = np.empty(len(ids), np.int64)
            place[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
            scores = _matrix(queries["v"]) @ decode(vectors).T
            for q, row in zip(queries["query_id"].combine_chunks(), scores):
                best = _top(row, place, k)
                out[0].append(pa.array([q.as_py()] * len(best), kinds[0]))
                out[1].append(ids.take(pa.array(best)))
                out[2].append(pa.array(row[best]))
        return pa.table([pa.chunked_array(c, t) for c, t in zip(out, (*kinds, pa.float64()))], names=["query_id", "id", "score"])

    return run


def _asked(queries: DataFrame, vector: str) -> DataFrame:
    return usable(queries, vector).select("query_id", F.col(vector).cast("array<double>").alias("v"))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _kinds(queries: DataFrame, rows: DataFrame, id_col: str):
    from pyspark.sql.pandas.types import to_arrow_type

    a, b = queries.schema["query_id"].dataType, rows.schema[id_col].dataType
    return (to_arrow_type(a), to_arrow_type(b)), f"query_id {a.simpleString()}, id {b.simpleString()}, score double"


def search_exact(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", part: int = PART, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the k vectors of largest cosine, by comparing every query with every vector, in cells.

    Equal scores rank by id.  Vectors that cannot be compared are left out on both sides; all others have one length.
    """
    rows, asked = usable(vectors, vector).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")), _asked(queries, vector)
    parts, blocks = (max(1, -(-df.count() // size)) for df, size in ((rows, part), (asked, block)))
    kinds, ddl = _kinds(queries, vectors, id_col)
    left = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_cell(k, kinds, lambda t: _matrix(t["v"])), ddl)
    return _best(found, k).select("query_id", F.col("id").alias(id_col), "score", "rank")


def search(index: VectorIndex, vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int = 12, keep: int = 50, where: Column | None = None,
           rerank: Column | None = None, vector: str = "embedding", part: int = PART, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score, rerank_score, rank): about the k vectors of largest cosine among those that ``where`` lets through.

    ``where`` and ``rerank`` are expressions over the metadata; ``rerank`` may use ``score``, orders the result, and is the score itself
    if not given.  With as many probes as lists every vector is looked at, and only the codes are approximate.
    """
    id_col, centres = index.id_col, index.centres
    rows = index.rows if where is None else index.rows.where(where)
    asked = _asked(queries, vector)
    kinds, ddl = _kinds(queries, vectors, id_col)
    sizes = {r["list"]: r["n"] for r in rows.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a list
    parts_of = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, -(-n // part))]), F.col("list")), F.lit(0)) if sizes else F.lit(0)
    held = np.array(sorted(sizes), np.int64)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            near = held[np.argsort(-(x @ centres[held].T), axis=1, kind="stable")[:, :probes]] if len(x) and len(held) else np.zeros((len(x), 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["query_id", "v", "lists"])

    id_kind = queries.schema["query_id"].dataType.simpleString()
    visits = asked.mapInArrow(choose, f"query_id {id_kind}, v array<double>, lists array<int>").select("query_id", "v", F.explode("lists").alias("list"))
    blocks = max(1, -(-asked.count() // block))
    right = visits.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts_of - 1)))
    left = rows.select(F.col(id_col).alias("id"), "list", "codes", "scale").withColumn("part", F.pmod(F.xxhash64("id"), parts_of.cast("long")).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def decode(table: pa.Table) -> np.ndarray:
        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.int8).reshape(table.num_rows, -1)
        x = centres[table["list"].to_numpy()] + codes * table["scale"].to_numpy()[:, None]
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    cell = ["list", "part", "block"]
    coarse = _best(left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell(keep, kinds, decode), ddl), keep).select("query_id", "id")
    whole = usable(vectors, vector).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("w"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = coarse.join(whole, "id").join(asked, "query_id").select("query_id", "id", (dot("v", "w") / F.sqrt(dot("v", "v") * dot("w", "w"))).alias("score"))
    metadata = rows.drop("list", "codes", "scale").withColumn("id", F.col(id_col))
    ranked = scored.join(metadata, "id").withColumn("rerank_score", F.col("score") if rerank is None else rerank.cast("double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("score"), "id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("id").alias(id_col), "score", "rerank_score", "rank")

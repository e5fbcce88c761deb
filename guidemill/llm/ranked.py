"""Ranked lexical search with norm buckets.

A document is the vector of its impacts on the terms of the items, an item the vector of its term weights, and a score their
inner product.  Documents are grouped by the length of their vectors.  A first pass scores one bounded part of every norm
bucket, which gives each item the score its ``top`` must reach; then Cauchy-Schwarz drops whole buckets for an item, and
within a bucket the documents whose length is too short.  The item's largest coordinates are added up first: a document
whose partial sum plus length of the rest cannot reach the score is left; the survivors are scored exactly in integers.
Bounds only drop what cannot rank, so the result is that of scoring everything.

Items meet documents as rows of cells, (norm bucket, part, block of items), never through the driver: only a bit table of fixed
size goes to the tasks that split texts, so that they send on the terms of items alone.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guidemill.llm.common import materialize
from guidemill.llm.contamination import words_of

CELL = ["bucket", "part", "block"]
MOST_BITS = 1 << 24  # of the table that marks terms of items; more terms let more others through, which costs exchange only
ENTRIES = 400_000  # vector entries of a cell
STEPS = (1024, 8192)  # documents scored before the bound of an item is raised, first and later
SLACK = 1 + 1e-9  # bounds are in doubles


class _Terms(dict):
    """64-bit hash of a term, None if no item holds it; at most 500,000 terms are remembered."""

    def __init__(self, bits: np.ndarray | None):
        self.bits, self.mask = bits, 0 if bits is None else 64 * len(bits) - 1

    def __missing__(self, term: bytes) -> int | None:
        if len(self) >= 500_000:
            self.clear()
        code = xxhash.xxh64_intdigest(term, 42)
        at = code & self.mask
        found = code - (1 << 64) if code >> 63 else code
        self[term] = found = found if self.bits is None or int(self.bits[at >> 6]) >> (at & 63) & 1 else None
        return found


def term_counts(rows: DataFrame, id_col: str, text_col: str, bits: np.ndarray | None = None) -> DataFrame:
    """(row, id, n, terms, tfs): all terms of the text counted, and how often each marked one occurs; one narrow pass."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        known = _Terms(shared.value)
        for batch in batches:
            sizes, terms, counts, ends = [], [], [], [0]
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                sizes.append(len(words))
                for word, n in Counter(words).items():
                    if (code := known[word]) is not None:
                        terms.append(code)
                        counts.append(n)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int64())),
                                              pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))], names=["row", "id", "n", "terms", "tfs"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"row long, id {kind}, n long, terms array<long>, tfs array<long>")


def marked_terms(items: DataFrame) -> np.ndarray:
    """Bit table of the items' term hashes, as unsigned words; its size follows the number of terms up to MOST_BITS."""
    terms = items.select(F.explode("terms").alias("term")).distinct()
    bits = 1 << 16
    while bits < MOST_BITS and bits < 16 * terms.count():
        bits *= 4
    at = F.col("term").bitwiseAND(F.lit(bits - 1))
    words = terms.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("marks")).toPandas()
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["marks"].to_numpy(np.int64)
    return table.view(np.uint64)


def _entries(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each entry, and the entries, of a list column."""
    lists = column.combine_chunks()
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)


def search_cell(docs: pa.Table, items: pa.Table, top: int) -> pa.Table:
    """Each item's best documents of the cell that reach its bound: (item, id, score)."""
    names, kinds = ["item", "id", "score"], [pa.int64(), docs.schema.field("id").type, pa.int64()]
    out: list[list[pa.Array]] = [[], [], []]
    if docs.num_rows and items.num_rows:
        docs = docs.sort_by([("norm", "descending")])
        norms, ids = docs["norm"].to_numpy(), docs["id"].combine_chunks()
        place = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()
        of_item, item_terms = _entries(items["terms"])
        item_weights = _entries(items["weights"])[1]
        vocabulary = np.unique(item_terms)
        rows, terms = _entries(docs["terms"])
        impacts = _entries(docs["impacts"])[1]
        at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
        some = np.flatnonzero(vocabulary[at] == terms)
        some = some[np.argsort(at[some], kind="stable")]
        rows, impacts = rows[some], impacts[some]
        lists = np.searchsorted(at[some], np.arange(len(vocabulary) + 1))
        numbers, bounds = items["item"].to_numpy(), items["bound"].to_numpy()
        first = np.searchsorted(of_item, np.arange(items.num_rows + 1))
        for k in range(items.num_rows):
            own = slice(first[k], first[k + 1])
            order = np.argsort(-item_weights[own], kind="stable")
            found, scores = search_item(np.searchsorted(vocabulary, item_terms[own])[order], item_weights[own][order], int(bounds[k]), norms, place, rows, impacts, lists, top)
            out[0].append(pa.array(np.full(len(found), numbers[k]), kinds[0]))
            out[1].append(ids.take(pa.array(found)))
            out[2].append(pa.array(scores, kinds[2]))
    return pa.table([pa.chunked_array(c, t) for c, t in zip(out, kinds)], names=names)


def search_item(terms, weights, bound: int, norms, place, rows, impacts, lists, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of the item's best ``top`` that score above 0 and at least ``bound``; rows are in descending order of norm.

    ``lists`` are the offsets of each term's rows and impacts.  Terms come in descending order of weight.
    """
    rest = np.sqrt(np.append(np.cumsum(weights[::-1].astype(float) ** 2)[::-1], 0.0))  # length of the coordinates from k on
    best, best_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, step = 0, STEPS[0]
    while low < len(norms) and norms[low] * rest[0] * SLACK >= bound:
        high = min(len(norms), low + step)
        step = STEPS[1]
        if bound:
            high = min(high, int(np.searchsorted(-norms, -bound / (rest[0] * SLACK), "right")))
        focus = int(np.searchsorted(-rest * norms[low] * SLACK, -bound, "right")) if bound else len(terms)
        focus = min(len(terms), max(1, focus))
        score, square = np.zeros(high - low, np.int64), np.zeros(high - low)
        parts = []
        for k in range(len(terms)):
            a, b = lists[terms[k]], lists[terms[k] + 1]
            a, b = a + np.searchsorted(rows[a:b], low), a + np.searchsorted(rows[a:b], high)
            parts.append((rows[a:b] - low, impacts[a:b]))
            if k < focus:
                score[parts[k][0]] += weights[k] * impacts[a:b]
                square[parts[k][0]] += impacts[a:b].astype(float) ** 2
        alive = score > 0
        if focus < len(terms):
            length = norms[low:high]
            alive &= (score + rest[focus] * np.sqrt(np.maximum(length * length * SLACK - square, 0.0))) * SLACK >= bound
            for k in range(focus, len(terms)):
                at, impact = parts[k]
                sure = alive[at]
                score[at[sure]] += weights[k] * impact[sure]
        found = np.flatnonzero(alive & (score >= bound))
        best, best_scores = np.append(best, found + low), np.append(best_scores, score[found])
        order = np.lexsort((place[best], -best_scores))[:top]
        best, best_scores = best[order], best_scores[order]
        if len(best) == top:
            bound = max(bound, int(best_scores[-1]))
        low = high
    return best, best_scores


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                     top: int = 20, entries: int = ENTRIES) -> DataFrame:
    """(item_id, rank, id, score): the ``top`` documents of each item by score above 0, equal scores by ascending id, null ids last.

    Every row of ``docs`` is a document and every row of ``items`` an item of its own, so repeated rows rank side by side.  A null or
    empty text has no terms: such a document is found by nothing, such an item finds nothing.
    """
    asked = materialize(term_counts(items, item_col, item_text_col), "items")
    counted = materialize(term_counts(docs, id_col, text_col, marked_terms(asked)), "impacts")
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_terms = max(1, n_terms)

    wanted = asked.select("row", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("row", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
    holding = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = wanted.select("term").distinct().join(holding, "term").select("term", weight.alias("w")).where("w > 0")
    weighted = wanted.join(weighed, "term").groupBy("row").agg(F.collect_list(F.struct("term", (F.col("tf") * F.col("w")).alias("w"))).alias("t"))
    queries = materialize(weighted.select(
        F.col("row").alias("item"), F.col("t.term").alias("terms"), F.col("t.w").alias("weights"),
        F.sqrt(F.aggregate("t.w", F.lit(0.0), lambda s, w: s + w.cast("double") * w)).alias("length")), "queries")
    blocks = max(1, math.ceil((queries.agg(F.sum(F.size("terms"))).first()[0] or 0) / entries))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))

    long_form = F.lit(75).cast("long") + F.expr(f"(25 * n * {n_docs}L) div {n_terms}L")
    impact = F.expr("transform(tfs, x -> (1000000000L * x) div (1000L * x + 12L * m))")
    vectors = (
        counted.where(F.size("terms") > 0).withColumn("m", long_form).select("row", "id", "terms", impact.alias("impacts"))
        .withColumn("norm", F.sqrt(F.aggregate("impacts", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).where("norm > 0").withColumn("bucket", F.floor(2 * F.log2("norm")).cast("int")))
    # Lengths lie between 1 and 1e6 * sqrt(terms), so there are at most some hundred buckets.
    buckets = vectors.groupBy("bucket").agg(F.ceil(F.sum(F.size("terms")) / entries).cast("int").alias("parts"), F.max("norm").alias("longest")).collect()
    if not buckets:
        return asked.limit(0).select(F.col("id").alias("item_id"), F.lit(0).alias("rank"), F.lit(None).cast(counted.schema["id"].dataType).alias("id"), F.lit(0).cast("long").alias("score"))
    parts = F.create_map(*[F.lit(v) for b in buckets for v in (b["bucket"], b["parts"])])[F.col("bucket")]
    dealt = vectors.withColumn("part", F.pmod(F.xxhash64("row"), parts.cast("long")).cast("int")).select("id", "terms", "impacts", "norm", "bucket", "part")
    known = F.array(*[F.struct(F.lit(b["bucket"]).alias("bucket"), F.lit(b["parts"]).alias("parts"), F.lit(b["longest"]).alias("longest")) for b in buckets])
    kind = counted.schema["id"].dataType.simpleString()

    def search(documents: DataFrame, asking: DataFrame) -> DataFrame:
        spread = documents.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else documents.withColumn("block", F.lit(0))
        return spread.groupBy(*CELL).cogroup(asking.groupBy(*CELL)).applyInArrow(lambda d, q: search_cell(d, q, top), f"item long, id {kind}, score long")

    def asking(bounds: DataFrame | None) -> DataFrame:
        met = (queries.withColumn("bound", F.lit(0).cast("long")) if bounds is None else queries.join(bounds, "item", "left").fillna(0, "bound")).select("*", F.inline(known))
        number = F.explode(F.array(F.lit(0))) if bounds is None else F.explode(F.when(F.col("parts") > 1, F.sequence(F.lit(1), F.col("parts") - 1)))
        return met.where(F.col("length") * F.col("longest") * SLACK >= F.col("bound")).withColumn("part", number).select("item", "terms", "weights", "bound", *CELL)

    found = materialize(_best(search(dealt.where("part = 0"), asking(None)), top), "found")
    if any(b["parts"] > 1 for b in buckets):
        bounds = found.where(F.col("rank") == top).select("item", F.col("score").alias("bound"))
        later = asking(bounds)
        needed = later.select("bucket").distinct()
        found = _best(found.drop("rank").unionByName(search(dealt.where("part > 0").join(needed, "bucket", "left_semi"), later)), top)
    return found.join(asked.select(F.col("row").alias("item"), F.col("id").alias("item_id")), "item").select("item_id", "rank", "id", "score")

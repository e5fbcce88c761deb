"""Near-duplicate documents by the Jaccard similarity of their word shingles.

Candidates come from MinHash tables: with 32 tables of 5 minima a pair at similarity 0.8 shares a bucket with
probability 1 - 3e-6, a more similar one more surely.  Every link is checked on the whole shingle sets (64-bit hashes).
Members of a bucket are first compared with two centres of it, which joins the copies of a much-copied text at the cost
of two pairs each.  Buckets that are then not within one component are compared in full, in bounded cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidemill.llm.cells import CELL, deal_cells
from guidemill.llm.common import map_text, materialize, sorted_groups
from guidemill.llm.components import connected_components
from guidemill.llm.simhash import shingle_hashes


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, a blank one has none."""
    return np.unique(shingle_hashes(text, width))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def bands(own: np.ndarray, factors: np.ndarray, tables: int) -> np.ndarray:
    """One key per table from the minima under ``factors`` (odd multipliers); an empty set gets none."""
    if not len(own):
        return np.zeros(0, np.int64)
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 256):
        part = own[at: at + 256, None] * factors[None, :]
        np.minimum(low, (part ^ (part >> np.uint64(32))).min(axis=0), out=low)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(low.reshape(tables, -1))], np.uint64).view(np.int64)


def _linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of copies that are similar enough."""
    def run(batches):
        for batch in batches:
            one, two = (batch.column(c).to_pylist() for c in ("set_a", "set_b"))
            keep = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(one, two)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(sets.select(F.col("copy").alias("a"), F.col("shingles").alias("set_a")), "a")
    rows = rows.join(sets.select(F.col("copy").alias("b"), F.col("shingles").alias("set_b")), "b")
    return rows.select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


def _cell_links(least: float):
    """Links that join the components inside a cell; pairs already in one component are passed over."""
    def run(batches):
        for cols, starts in sorted_groups(batches, CELL):
            out_a, out_b = [], []
            for s, e in zip(starts[:-1], starts[1:]):
                copies, across = cols["copy"][s:e], cols["cell_a"][s] != cols["cell_b"][s]
                own = [np.frombuffer(x, np.uint64) for x in cols["shingles"][s:e]]
                sizes = np.array([len(x) for x in own])
                group = np.unique(cols["component"][s:e], return_inverse=True)[1]
                for i in range(e - s):
                    fits = np.minimum(sizes, sizes[i]) >= least * np.maximum(sizes, sizes[i])
                    fits[: i + 1] = False
                    if across:
                        fits &= cols["side"][s:e] != cols["side"][s + i]
                    for j in np.flatnonzero(fits & (group != group[i])):
                        if group[j] != group[i] and similarity(own[i], own[j]) >= least:
                            group[group == group[j]] = group[i]
                            out_a.append(copies[i])
                            out_b.append(copies[j])
            yield pd.DataFrame({"a": out_a, "b": out_b}, dtype=object)

    return run


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, tables: int = 32, rows: int = 5,
                      block: int = 512) -> DataFrame:
    """(id, component_id): the smallest id reachable over pairs of Jaccard similarity ``least`` or more.

    Texts with equal shingle sets, blank ones included, count as one node.  Rows with a null id come back with component
    null.  A repeated id is one document with several texts.
    """
    factors = np.random.default_rng(42).integers(0, 1 << 63, tables * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    digest = lambda own: xxhash.xxh3_128_digest(own.tobytes())

    def sign(texts):
        found = [shingle_set(t, width) for t in texts]
        return [pa.array([digest(s) for s in found], pa.binary()), pa.array([bands(s, factors, tables) for s in found], pa.list_(pa.int64()))]

    def hashed(texts):
        found = [shingle_set(t, width) for t in texts]
        return [pa.array([digest(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())]

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = materialize(map_text(texts, "text", "copy binary, keys array<long>", sign), "signatures")
    known = signed.where("id IS NOT NULL")
    nodes = materialize(known.groupBy("copy").agg(F.min("id").alias("node"), F.any_value("keys").alias("keys")), "nodes")
    members = nodes.select("copy", F.explode("keys").alias("key"))
    company = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    shared = materialize(members.join(company, "key"), "members")
    # The shingle sets of copies in company, from one of their texts each.
    wanted = shared.select("copy").distinct().join(nodes.select("copy", "node"), "copy").select(F.col("node").alias("id"), F.col("copy").alias("of"))
    sets = map_text(texts.join(wanted.select("id").distinct(), "id", "left_semi"), "text", "copy binary, shingles binary", hashed)
    sets = materialize(sets.join(wanted.select("id", F.col("of").alias("copy")), ["id", "copy"], "left_semi").groupBy("copy").agg(F.any_value("shingles").alias("shingles")), "sets")

    centres = shared.groupBy("key").agg(F.min("copy").alias("low"), F.max("copy").alias("high"))
    stars = shared.join(centres, "key").select(F.col("copy").alias("one"), F.explode(F.array("low", "high")).alias("two")).where("one <> two")
    links = materialize(_linked(stars.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct(), sets, least), "links")
    # An id that repeats with different texts ties them together.
    ties = known.groupBy("id").agg(F.min("copy").alias("a"), F.max("copy").alias("z")).where("a <> z").join(known.select("id", F.col("copy").alias("b")), "id").select("a", "b")
    links = materialize(links.union(ties), "links")
    found = connected_components(links).withColumnRenamed("node", "copy")
    grouped = materialize(shared.join(found, "copy", "left").select("key", "copy", F.coalesce("component", "copy").alias("component")), "grouped")
    # Buckets of the same members are compared once.
    open_ = grouped.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count(F.lit(1)).alias("n"),
                                       F.bit_xor(F.xxhash64("copy")).alias("x"), F.bit_xor(F.xxhash64("copy", F.lit(1))).alias("y")).where("p <> q")
    once = open_.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    rest = grouped.join(once, "key").select(F.lit(0).alias("table"), "key", "copy", "component")
    more = deal_cells(rest, "copy", block, sets).select(*CELL, "side", "copy", "component", "shingles").mapInPandas(_cell_links(least), "a binary, b binary")
    found = connected_components(links.union(more)).withColumnRenamed("node", "copy")
    labelled = materialize(nodes.join(found, "copy", "left").select("copy", "node", F.coalesce("component", "copy").alias("root")), "labelled")
    smallest = labelled.groupBy("root").agg(F.min("node").alias("component_id"))
    named = labelled.join(smallest, "root").select("copy", "component_id")
    return signed.join(named, "copy", "left").select("id", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))

"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

A fingerprint has 64 bits; two link at ``radius`` or fewer differing bits.  The hash tables are structured so
that no such pair is missed: every bit position gets a non-zero vector of radius + 1 bits, and table v (any
non-zero vector) keeps the positions whose vector has an odd product with v.  The vectors of at most ``radius``
differing positions cannot span all radius + 1 dimensions, so some v is orthogonal to all of them and the pair
agrees on everything that table v keeps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidemill.llm.cells import CELL, deal_cells
from guidemill.llm.common import group_labels, map_text, materialize, sorted_groups
from guidemill.llm.components import connected_components

BITS = 64


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks over 64 bits; any ``radius`` positions are all outside of some mask."""
    count = 2 ** (radius + 1) - 1
    vectors = [1 + (position % count) for position in range(BITS)]
    return [sum(1 << p for p in range(BITS) if (vectors[p] & v).bit_count() % 2) for v in range(1, count + 1)]


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the word shingles of one text in order; a shorter text is one shingle, no words give none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z, and the six ASCII spaces
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, 42)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist())
    return np.array([digest(joined[i:j], 42) for i, j in spans], np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the word shingles of one text; no words: zero."""
    hashes = shingle_hashes(text, width)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at: at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long): the fingerprint's bits as a signed long.  A null or blank text has fingerprint zero."""
    def run(texts):
        return [np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)]

    return map_text(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "fp long", run)


def _links(radius: int):
    def run(batches):
        for cols, starts in sorted_groups(batches, CELL):
            nodes, fps = cols["node"], cols["fp"].view(np.uint64)
            out_a, out_b = [], []
            sizes = np.diff(starts)
            twos = starts[:-1][sizes == 2]
            near = np.bitwise_count(fps[twos] ^ fps[twos + 1]) <= radius
            out_a.append(nodes[twos[near]])
            out_b.append(nodes[twos[near] + 1])
            for s, n in zip(starts[:-1][sizes > 2], sizes[sizes > 2]):
                f, own = fps[s: s + n], np.sort(nodes[s: s + n])
                f = f[np.argsort(nodes[s: s + n])]
                labels = group_labels(np.bitwise_count(f[:, None] ^ f[None, :]) <= radius)
                moved = labels != np.arange(n)
                out_a.append(own[moved])
                out_b.append(own[labels[moved]])
            yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, block: int = 2048) -> DataFrame:
    """(id, fp, component_id): the smallest id reachable over links, the document itself included.

    Copies with one fingerprint count as one node, the smallest id among them.  Cells hand on a spanning tree of the links
    they find, which keeps every component whole without listing all pairs.  Rows with a null id come back
    with component null.  A repeated id is one document with several fingerprints.
    """
    signed = materialize(with_fingerprints(docs, id_col, text_col, width), "fingerprints")
    known = signed.where("id IS NOT NULL")
    nodes = materialize(known.groupBy("fp").agg(F.min("id").alias("node")), "nodes")
    masks = F.array(*[F.struct(F.lit(i).alias("table"), F.lit(m - (1 << 64) if m >> 63 else m).cast("long").alias("mask")) for i, m in enumerate(covering_masks(radius))])
    members = nodes.select("node", "fp", F.inline(masks)).select("table", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "node", "fp")
    id_type = nodes.schema["node"].dataType.simpleString()
    links = deal_cells(members, "fp", block).select(*CELL, "node", "fp").mapInPandas(_links(radius), f"a {id_type}, b {id_type}")
    # An id that repeats with different texts ties its fingerprints together.
    ties = known.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(known, "id").join(nodes, "fp").select(F.col("id").alias("a"), F.col("node").alias("b"))
    found = connected_components(links.union(ties))
    labelled = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return signed.join(labelled, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))

"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform; its hash is the coordinate of
greatest size with its sign.  A table joins ``hashes`` of them into a bucket key and also posts the vector to the ``probes - 1``
next likely buckets, in which the hash with the closest call takes its second choice.  Pairs in one bucket are verified by
cosine in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidemill.llm.cells import CELL, deal_cells
from guidemill.llm.common import group_labels, materialize, sorted_groups
from guidemill.llm.components import connected_components


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        x = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(-1, n)
        step *= 2
    return x / np.sqrt(n)


def bucket_keys(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 11) -> np.ndarray:
    """rows x tables x probes keys (64 bit)."""
    size = 1 << max(1, x.shape[1] - 1).bit_length()
    padded = np.zeros((len(x), size))
    padded[:, : x.shape[1]] = x
    rng = np.random.default_rng([seed, size])
    rows = np.arange(len(x))
    out = np.zeros((len(x), tables, probes), np.int64)
    for t in range(tables):
        first, second, gap = (np.zeros((hashes, len(x)), np.int64), np.zeros((hashes, len(x)), np.int64), np.zeros((hashes, len(x))))
        for h in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size))
            strength = np.abs(y)
            top = np.argpartition(-strength, 1, axis=1)[:, :2] if size > 2 else np.argsort(-strength, axis=1)[:, :2]
            swap = strength[rows, top[:, 0]] < strength[rows, top[:, 1]]
            top[swap] = top[swap][:, ::-1]
            code = 2 * top + (y[rows[:, None], top] < 0)
            first[h], second[h], gap[h] = code[:, 0], code[:, 1], strength[rows, top[:, 0]] - strength[rows, top[:, 1]]
        weight = (2 * size) ** np.arange(hashes)
        key = (first * weight[:, None]).sum(0)
        out[:, t, 0] = key
        order = np.argsort(gap, axis=0)
        for p in range(1, probes):
            h = order[p - 1]
            out[:, t, p] = key + (second[h, rows] - first[h, rows]) * weight[h]
    return out


def _with_keys(tables: int, hashes: int, probes: int):
    def run(batches):
        for pdf in batches:
            sizes = pdf["vec"].map(len).to_numpy()
            for size in np.unique(sizes):
                part = pdf[sizes == size]
                x = np.vstack(part["vec"].to_numpy()).astype(np.float64)
                keys = bucket_keys(x / np.abs(x).max(axis=1, keepdims=True), tables, hashes, probes)
                yield part.assign(posts=list(keys.reshape(len(part), -1)))

    return run


def _compare(threshold: float, tables: int, probes: int):
    """Per cell: a spanning tree of its links, and how many links each member has here for the first time."""
    def first_here(posts, i, j, table, key):
        a, b = posts[i].reshape(-1, tables, probes), posts[j].reshape(-1, tables, probes)
        same = (a[:, :, :, None] == b[:, :, None, :]).any(axis=3)  # in a's posts
        earlier = same[:, :table].any(axis=(1, 2))
        return ~(earlier | (same[:, table] & (a[:, table] < key)).any(axis=1))

    def run(batches):
        for cols, starts in sorted_groups(batches, CELL):
            a, b, n = [], [], []
            for s, e in zip(starts[:-1], starts[1:]):
                if e - s < 2:
                    continue
                order = s + np.argsort(cols["node"][s:e], kind="stable")
                node, copies, side = cols["node"][order], cols["copies"][order], cols["side"][order]
                x = np.vstack(cols["vec"][order]).astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                linked = x @ x.T >= threshold
                np.fill_diagonal(linked, False)
                if cols["cell_a"][s] != cols["cell_b"][s]:
                    linked &= side[:, None] != side[None, :]
                i, j = np.nonzero(np.triu(linked))
                if not len(i):
                    continue
                posts, links = np.vstack(cols["posts"][order]), np.zeros(len(order), np.int64)
                table, key = int(cols["table"][s]) % tables, int(cols["key"][s])
                for at in range(0, len(i), 20_000):
                    p, q = i[at: at + 20_000], j[at: at + 20_000]
                    new = first_here(posts, p, q, table, key)
                    np.add.at(links, p[new], copies[q[new]])
                    np.add.at(links, q[new], copies[p[new]])
                labels = group_labels(linked)
                some = (labels != np.arange(len(labels))) | (links > 0)
                a.append(node[some])
                b.append(node[labels[some]])
                n.append(links[some])
            if a:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "links": np.concatenate(n)})

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, tables: int = 12, hashes: int = 3, probes: int = 4,
                 block: int = 1024) -> DataFrame:
    """(id, n_links, component_id, kept): links are other vectors found with cosine >= ``threshold``.

    Equal vectors are one node with a number of copies.  A pair is counted in the first bucket that it shares, so
    counts are exact without listing pairs.  Null, zero and empty vectors and those with a null or non-finite component
    link with nothing and are their own component; vectors of different length do not link.  A null id
    has a null component and counts as a copy of an equal vector that has an id.
    """
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    clean = (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(clean, F.lit(False)))
    nodes = materialize(rows.where("usable").groupBy("vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")).where("node IS NOT NULL"), "vectors")
    vec_type = nodes.schema["vec"].dataType.simpleString()
    nodes = materialize(nodes.mapInPandas(_with_keys(tables, hashes, probes), f"vec {vec_type}, node {id_type}, copies long, posts array<long>"), "posts")
    posted = nodes.select("node", F.size("vec").alias("size"), F.posexplode("posts").alias("at", "key")).select(
        (F.col("size") * tables + F.floor(F.col("at") / probes)).cast("int").alias("table"), "key", "node").distinct()
    cells = deal_cells(posted, "node", block, nodes).select(*CELL, "side", "node", "copies", "vec", "posts")
    found = materialize(cells.mapInPandas(_compare(threshold, tables, probes), f"a {id_type}, b {id_type}, links long"), "links")
    degree = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    component = connected_components(found.select("a", "b"))
    known = materialize(nodes.join(degree, "node", "left").join(component, "node", "left").select(
        "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component")), "nodes")
    linked = rows.where("usable").join(known, "vec", "left").select("id", F.coalesce("links", F.lit(0)).alias("n_links"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))
    alone = rows.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))

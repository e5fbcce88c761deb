"""Vector search through the index against exact search, and exact search against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from guidemill.operators import vector_index as vi
from guidemill.queries.rules import vector_search

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 32))
    x = (centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 32))).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 4)) for i, v in enumerate(x)]
    odd = [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 32, 1), (9003, [float("nan")] * 32, 1), (9004, [None] + [1.0] * 31, 1), (9005, rows[7][1], 1), (9006, [2 * a for a in rows[7][1]], 1)]
    return x, spark.createDataFrame(rows + odd, SCHEMA).repartition(4)


def plain(x, queries, k, allowed=None):
    x = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = x @ x[q]
        if allowed is not None:
            s = np.where(allowed, s, -9)
        out[q] = np.lexsort((np.arange(len(x)), -np.round(s, 9)))[:k].tolist()
    return out


def asked(frame):
    return frame.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_exact_search_in_small_cells(spark, made):
    x, frame = made
    got = found(vi.search_exact(frame, asked(frame), k=10, part=400, block=17))
    same = np.vstack([x, x[7], x[7]])  # 9005 and 9006 lie in the direction of 7
    want = {q: [[*range(3000), 9005, 9006][j] for j in js] for q, js in plain(same, range(0, 3000, 50), 10).items()}
    assert {q: set(v) for q, v in got.items() if q < 9000} == {q: set(v) for q, v in want.items()}
    assert set(got) == set(range(0, 3000, 50))


def test_recall_of_the_index(spark, made):
    x, frame = made
    want, got = found(vi.search_exact(frame, asked(frame))), found(vi.search(vi.build_index(frame, lists=40), frame, asked(frame), probes=8, part=300, block=20))
    assert np.mean([len(set(want[q]) & set(got[q])) / 10 for q in want]) >= 0.9
    everything = found(vi.search(vi.build_index(frame, lists=5), frame, asked(frame), probes=5))
    assert np.mean([len(set(want[q]) & set(everything[q])) / 10 for q in want]) >= 0.99


def test_filter_before_the_lists_and_rerank(spark, made):
    x, frame = made
    index = vi.build_index(frame, lists=20)
    rows = vi.search(index, frame, asked(frame), k=5, probes=20, where=F.col("label") == 2, rerank=F.col("score") - F.col("vec_id") * 0.0001).collect()
    assert all(r["vec_id"] % 4 == 2 and abs(r["rerank_score"] - r["score"] + r["vec_id"] * 0.0001) < 1e-9 for r in rows) and len(rows) == 5 * 60
    by_query = {}
    for r in rows:
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["rerank_score"]))
    assert all([s for _, s in sorted(v)] == sorted((s for _, s in v), reverse=True) for v in by_query.values())
    assert vi.search(index, frame, asked(frame), where=F.col("label") > 77).count() == 0


def test_nothing_to_search(spark, made):
    _, frame = made
    empty = frame.limit(0)
    assert vi.search(vi.build_index(empty), empty, asked(frame)).count() == 0 and vi.search_exact(empty, asked(frame)).count() == 0
    assert vi.search_exact(frame, asked(empty)).count() == 0
    few = frame.where("vec_id < 3")
    assert found(vi.search(vi.build_index(few), few, asked(few))) == {0: found(vi.search_exact(few, asked(few)))[0]}


def test_recall_of_the_query(spark):
    """The registered search over whole tables: ten best among the labels up to 5."""
    folder = "/root/testdata/sf0.01"
    v = spark.read.parquet(f"{folder}/embeddings.parquet")
    want = found(vi.search_exact(v.where("label <= 5"), asked(v), k=40))
    got = vector_search(spark, folder).collect()
    scores = {}
    for r in got:
        assert abs(r["rerank_score"] - r["score"]) <= 0.0051
        scores.setdefault(r["query_id"], []).append(r["vec_id"])
    assert np.mean([len(set(scores[q]) & set(want[q])) / len(scores[q]) for q in want]) >= 0.9

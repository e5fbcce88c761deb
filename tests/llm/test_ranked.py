"""Ranked search against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from guidemill.llm import ranked
from guidemill.llm.queries import ranked_search

from test_operators import base_docs, folder  # noqa: F401

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return Counter(re.findall(TERM, re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")))


def plain_search(docs, items, top=20):
    """(item, rank, doc, score) by brute force over rows of (id, text)."""
    counted = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        asked, scored = terms(text), []
        for doc, own in counted:
            m = 75 + 25 * sum(own.values()) * n_docs // max(1, total)
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * own[t] // (1000 * own[t] + 12 * m)) for t, q in asked.items() if t in own)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored, key=lambda s: s[:3])[:top])]
    return Counter(out)


def found(df, doc="id"):
    return Counter((r["item_id"], r["rank"], r[doc], r["score"]) for r in df.collect())


def test_query(spark, folder, base_docs):  # noqa: F811
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(ranked_search(spark, folder), "doc_id") == plain_search([r[:2] for r in base_docs], items)


@pytest.mark.parametrize("entries", [60, 700])
def test_small_cells_and_blocks(spark, base_docs, entries):  # noqa: F811
    """Many parts of every bucket and many blocks of items, with awkward items among them."""
    docs = [r[:2] for r in base_docs] + [(5000 + i, "a hot text " + "of words " * (i % 3)) for i in range(300)]
    items = [(1, "of words"), (1, "of words"), (2, None), (3, ""), (4, base_docs[3][1]), (None, base_docs[7][1][:300]), (5, "nowhereatall"), (6, "hot hot HOT Été same 123"), (7, " ".join(t for _, t in docs[:6] if t))]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, row int, n int").repartition(4)
    got = ranked.search_documents(frame, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, terms int"), entries=entries, top=7)
    assert found(got) == plain_search(docs, items, 7)


def test_bounds_skip_documents_and_lose_none():
    """A rising bound leaves short vectors unscored; the result stays that of all."""
    rng = np.random.default_rng(3)
    for trial in range(40):
        n, v = 3000, 12
        impacts = np.where(rng.random((n, v)) < 0.15, rng.integers(1, 900_000, (n, v)), 0)
        impacts = impacts[np.argsort(-np.sqrt((impacts.astype(float) ** 2).sum(1)), kind="stable")]
        norms = np.sqrt((impacts.astype(float) ** 2).sum(1))
        cols, rows = np.nonzero(impacts.T)
        lists = np.searchsorted(cols, np.arange(v + 1))
        weights = np.sort(rng.integers(1, 20_000, 5) ** (1 + trial % 2))[::-1]
        chosen = rng.choice(v, 5, replace=False)
        scores, place = impacts[:, chosen] @ weights, rng.permutation(n)
        bound = [0, int(np.sort(scores)[-40]), int(np.sort(scores)[-10]), int(scores.max()) + 1][trial % 4]
        at, got = ranked.search_item(chosen, weights, bound, norms, place, rows, impacts.T[cols, rows], lists, 20)
        order = np.lexsort((place, -scores))[:20]
        want = [(k, s) for k, s in zip(order.tolist(), scores[order].tolist()) if s >= max(1, bound)]
        assert list(zip(at.tolist(), got.tolist())) == want


def test_marks_of_many_terms(spark):
    items = spark.createDataFrame([(i, list(range(i * 1000 - 2**62, i * 1000 + 1000 - 2**62))) for i in range(20)], "id long, terms array<long>")
    bits = ranked.marked_terms(items)
    marked = lambda c: int(bits[(c & (64 * len(bits) - 1)) >> 6]) >> (c & 63) & 1
    assert len(bits) * 64 >= 16 * 20_000 and all(marked(c - 2**62) for c in range(20_000)) and not all(marked(c * 77_777_777_777) for c in range(1, 200))


def test_all_documents_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, " !")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    got = ranked.search_documents(docs, items)
    assert got.columns == ["item_id", "rank", "id", "score"] and got.select(F.count("*")).first()[0] == 0

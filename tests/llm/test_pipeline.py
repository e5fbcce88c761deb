"""The stages of the corpus pipeline, each against a brute-force version on what its predecessor kept."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from guidemill.llm.queries import vocabulary_files

from test_operators import base_docs, folder  # noqa: F401
from test_similar import plain_groups


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):  # noqa: F811
    out = str(tmp_path_factory.mktemp("stages"))
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    seen.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
        seen.append(docs)
    return seen


def key(r):
    return tuple((x is not None, x if x is not None else 0) for x in (r["doc_id"], r["text"], r["lang"], r["n_chars"]))


def test_columns_stay(steps):
    assert all(s.columns == steps[0].columns and s.dtypes == steps[0].dtypes for s in steps[1:5])


def test_quality_keeps_the_good(spark, folder, steps):  # noqa: F811
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in steps[1].collect()}
    good, bad = [d for d, q in labels.items() if q == 1], [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.95 * len(good) and sum(d in kept for d in bad) <= 0.1 * len(bad)
    rows = Counter(map(key, steps[0].collect()))
    assert not Counter(map(key, steps[1].collect())) - rows


def test_one_of_each_near_duplicate_group(steps):
    """Five-word Jaccard similarity of 0.8 or more, by brute force over all pairs."""
    before = steps[1].collect()
    groups = plain_groups([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None])
    want = sorted(key(r) for r in before if r["doc_id"] is None or groups[r["doc_id"]] == r["doc_id"])
    assert sorted(map(key, steps[2].collect())) == want and len(want) < len(before)


def test_contaminated_documents_go(spark, folder, steps):  # noqa: F811
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda t: re.findall(word, re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        ws = words(r["text"])
        windows |= {tuple(ws[k: k + 13]) for k in range(max(1, len(ws) - 12) if ws else 0)}
    sizes = {len(w) for w in windows}
    want = []
    for r in steps[2].collect():
        ws = words(r["text"])
        hit = {k + j for n in sizes for k in range(len(ws) - n + 1) if tuple(ws[k: k + n]) in windows for j in range(n)}
        if not (hit and 20 * len(hit) >= len(ws)):
            want.append(key(r))
    assert sorted(map(key, steps[3].collect())) == sorted(want)


def test_secrets_are_hidden(steps):
    from guidemill.llm.secrets import base_spans

    after = sorted(steps[4].collect(), key=key)
    before = {(r["doc_id"], r["source"]): r["text"] for r in steps[3].collect()}
    assert len(after) == steps[3].count()
    for r in after:
        if r["doc_id"] is None:
            continue
        old = before[r["doc_id"], r["source"]]
        found = base_spans(old or "")
        assert not base_spans(r["text"] or "") and ("[secret]" in (r["text"] or "")) >= bool(found)
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
        if not found and "[secret]" not in (r["text"] or ""):
            assert r["text"] == old


def test_packed_pieces(steps):
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_file(vocabulary_files()[0])
    rows = steps[4].collect()
    texts = {r["doc_id"]: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in rows}
    times, total = Counter(r["doc_id"] for r in rows), Counter()
    for p in steps[5].collect():
        own = texts[p["doc_id"]]
        if p["doc_id"] is not None:
            assert zlib.crc32(np.array(own[p["start"]: p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"]
        total[p["doc_id"]] += p["length"]
    assert {d: n for d, n in total.items() if d is not None} == {d: len(v) * times[d] for d, v in texts.items() if d is not None}


def test_run_gives_the_last_stage(spark, folder, steps):  # noqa: F811
    pick = lambda df: Counter((r["doc_id"], r["doc_tokens"]) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert pick(corpus_pipeline.run(spark, folder)) == pick(steps[5])


def test_no_labels_drop_nothing(spark, folder, tmp_path):  # noqa: F811
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.keep_good(spark, docs, str(tmp_path)).count() == docs.count()

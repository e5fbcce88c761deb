"""Near-duplicates by five-word Jaccard similarity against a brute-force version."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline
from guidemill.llm.similar import similar_documents

from test_operators import SPACES, base_docs, folder, plain_components  # noqa: F401


def plain_shingles(text):
    words = re.findall(SPACES, re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4) if words else 0)}


def plain_groups(texts, least=0.8):
    """Component per id of (id, text) pairs; an id may repeat."""
    sets, own = [(d, plain_shingles(t)) for d, t in texts], defaultdict(list)
    for d, s in sets:
        own[d].append(s)
    alike = lambda a, b: len(a & b) >= least * len(a | b)
    return plain_components(sorted(own), lambda a, b: any(alike(x, y) for x in own[a] for y in own[b]))


def test_groups_of_the_fixture(spark, folder, base_docs):  # noqa: F811
    want = plain_groups([(d, t) for d, t, *_ in base_docs if d is not None])
    got = similar_documents(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    assert len(got) == len(base_docs) and all(r["component_id"] == (None if r["id"] is None else want[r["id"]]) for r in got)


@pytest.mark.parametrize("block", [4, 512])
def test_members_of_a_bucket_that_no_centre_joins(spark, block):
    """Chains, whose ends are less similar than 0.8, and a repeated id, over cells of any size."""
    words = [f"w{i}" for i in range(1200)]
    rows = [(100 + i, " ".join(words[9 * i: 9 * i + 120])) for i in range(60)] + [(500 + i, " ".join(words[700 + 40 * i: 820 + 40 * i])) for i in range(8)]
    rows += [(7, rows[3][1]), (7, rows[-1][1]), (8, ""), (9, None), (10, "one two"), (11, "One  TWO")]
    want = plain_groups(rows)
    got = {r["id"]: r["component_id"] for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    assert got == want and want[159] == 7 and want[501] == 501


def test_stage_drops_pairs_of_many_differing_bits(spark):
    """Document 9167 of sf0.1 is 0.81 and 0.84 similar to 3330 and 205, at more than three bits of the fingerprint."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id in (205, 3330, 9167)")
    assert [r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()] == [205]


def test_every_similar_pair_is_linked(spark):
    """All pairs of sf0.1 with a similarity of 0.8 or more that share a shingle held by at most 60 documents."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    sets = {r["doc_id"]: plain_shingles(r["text"]) for r in docs.collect()}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    pairs = {(a, b) for ds in holders.values() if len(ds) <= 60 for a in ds for b in ds if a < b}
    alike = [(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    got = {r["id"]: r["component_id"] for r in similar_documents(docs).collect()}
    assert len(alike) > 1000 and all(got[a] == got[b] for a, b in alike)

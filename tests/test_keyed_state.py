"""The stream with a state per address against the batch ingest of the same batches."""

import json
import shutil

from pyspark.sql import functions as F

from guidemill.plans.publish import Publication
from guidemill.streaming import ingest_stream, keyed_state

WORDS = "Guidance on the return and how to file it in time. " * 30


def payload(path, body, day, kind="guide"):
    return json.dumps({"base_path": path, "title": "T" + path, "document_type": kind, "details": {"body": f"<h1>A</h1><p>{body}</p>"}, "public_updated_at": f"2024-03-{day:02d}T09:30:00Z",
                       "first_published_at": f"2020-01-{day:02d}T00:00:00Z"})


BATCHES = [
    [payload("/a", WORDS, 10), payload("/a", WORDS + "newer", 12), payload("/a", WORDS + "older", 11), payload("/b", WORDS, 3), payload("/short", "few words", 3), payload("/b", WORDS, 3)],
    [payload("/a", WORDS + "newer", 12), payload("/b", WORDS + "late but other", 1, "manual"), payload("/c", WORDS, 4), payload("/short", WORDS, 4)],
    [payload("/a", WORDS, 2), payload("/c", WORDS, 4), payload("/c", "few words", 5), payload("/d", WORDS, 6), payload("/b", WORDS + "late but other", 1)],
]


def test_three_batches_equal_the_batch_ingest(spark, tmp_path):
    src, state, check, plain = (str(tmp_path / n) for n in ("in", "state", "check", "plain"))
    (tmp_path / "in").mkdir()
    for i, lines in enumerate(BATCHES):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(lines))
        keyed_state.start(spark, src, state, check).awaitTermination(120)
        ingest_stream.ingest_batch(spark.createDataFrame([(x,) for x in lines], "value string"), i, plain)
    store, other = Publication(spark, state), Publication(spark, plain)
    assert store.latest() == other.latest() == 3
    columns = ["document_id", "url", "authority", "document_type", "reliability_tier", "publication_date", "content_hash", "last_updated_source", "title", "total_chunks"]
    pick = lambda df: sorted(map(str, df.select(*columns).collect()))
    got, want = pick(keyed_state.current(spark, state)), pick(other.read("documents"))
    assert set(got) ^ set(want) == set()
    assert len(pick(keyed_state.current(spark, state))) == 5
    chunks = lambda df: sorted((r["document_id"], r["chunk_index"], r["content"]) for r in df.collect())
    assert chunks(keyed_state.current(spark, state, "chunks")) == chunks(ingest_stream.current_chunks(spark, plain))
    for v in (1, 2, 3):
        told = lambda s: sorted((r["url"], r["action"], r["reason"]) for r in s.read("outcomes").where(F.col("version") == v).collect())
        got = told(store)
        want = told(other) if v == 1 else sorted((r["url"], r["action"], r["reason"]) for r in spark.read.parquet(f"{plain}/outcomes/version={v}").collect())
        assert v == 1 or got == want
    written = store.read("documents").groupBy("version").count().collect()
    assert {r["version"]: r["count"] for r in written} == {1: 2, 2: 3, 3: 2}  # only what changed


def test_a_batch_handed_over_again_changes_nothing(spark, tmp_path):
    src, state, check = (str(tmp_path / n) for n in ("in", "state", "check"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(BATCHES[0]) + "\nno json at all")
    keyed_state.start(spark, src, state, check).awaitTermination(120)
    before = Publication(spark, state).folders()
    shutil.copytree(check, check + "-again")
    again = spark.createDataFrame([("https://x/a", BATCHES[0][0], False, None, None, None, None, None)], keyed_state.DECISION_DDL)
    keyed_state.publish_batch(again, 0, state)
    assert Publication(spark, state).folders() == before
    keyed_state.start(spark, src, state, check).awaitTermination(120)  # nothing new has come
    assert Publication(spark, state).latest() == 1

"""Versions of several tables: whole or not at all."""

import pytest
from pyspark.sql import functions as F

from guidemill.plans.publish import Conflict, Publication, delete_everywhere


def rows(spark, n, tag):
    return spark.range(n).select(F.col("id").alias("document_id"), F.lit(tag).alias("tag"))


def held(store, version=None):
    return {t: sorted((r["document_id"], r["tag"]) for r in store.read(t, version).collect()) for t in store.folders(version)}


def test_versions_follow_each_other(spark, tmp_path):
    store = Publication(spark, str(tmp_path / "s"))
    assert store.latest() == 0 and store.folders() == {}
    assert store.publish({"documents": rows(spark, 2, "d1"), "chunks": rows(spark, 2, "c1")}, 0) == 1
    assert store.publish({"documents": rows(spark, 3, "d2")}, 1, append={"chunks": rows(spark, 1, "c2")}) == 2
    assert held(store, 1) == {"documents": [(0, "d1"), (1, "d1")], "chunks": [(0, "c1"), (1, "c1")]}
    assert held(store) == {"documents": [(0, "d2"), (1, "d2"), (2, "d2")], "chunks": [(0, "c1"), (0, "c2"), (1, "c1")]}
    assert store.publish({}, 2, drop=("chunks",)) == 3 and set(held(store)) == {"documents"}
    assert store.read("chunks", 3, "document_id long").count() == 0
    with pytest.raises(KeyError):
        store.read("chunks")


def test_a_writer_that_stops_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = Publication(spark, str(tmp_path / "s"))
    store.publish({"documents": rows(spark, 2, "old"), "chunks": rows(spark, 2, "old"), "edges": rows(spark, 2, "old")}, 0)
    before = held(store)
    broken = rows(spark, 2, "new").withColumn("tag", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        store.publish({"documents": rows(spark, 5, "new"), "chunks": broken, "edges": rows(spark, 5, "new")}, 1)
    assert store.latest() == 1 and held(store) == before
    monkeypatch.setattr(Publication, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.publish({"documents": rows(spark, 5, "new")}, 1)
    assert held(store) == before
    monkeypatch.undo()
    assert store.publish({"documents": rows(spark, 1, "new")}, 1) == 2 and held(store)["documents"] == [(0, "new")] and held(store)["edges"] == before["edges"]


def test_two_writers_conflict(spark, tmp_path, monkeypatch):
    one, two = Publication(spark, str(tmp_path / "s")), Publication(spark, str(tmp_path / "s"))
    one.publish({"documents": rows(spark, 1, "one")}, 0)
    with pytest.raises(Conflict):
        two.publish({"documents": rows(spark, 1, "two")}, 0)
    monkeypatch.setattr(two, "latest", lambda: 1)  # both saw the same last version; the other commits first
    one.publish({"documents": rows(spark, 1, "first")}, 1)
    with pytest.raises(Conflict):
        two.publish({"documents": rows(spark, 1, "second")}, 1)
    assert held(one) == {"documents": [(0, "first")]} and one.latest() == 2


def test_cascade_is_one_version(spark, tmp_path):
    store = Publication(spark, str(tmp_path / "s"))
    plain = spark.range(3).select(F.col("id").alias("other"))
    store.publish({"documents": rows(spark, 4, "d"), "chunks": rows(spark, 4, "c").unionByName(rows(spark, 4, "e")), "settings": plain}, 0)
    gone = spark.createDataFrame([(1,), (3,), (None,), (77,)], "document_id long")
    assert delete_everywhere(store, gone, "document_id") == 2
    assert {r["document_id"] for t in ("documents", "chunks") for r in store.read(t).collect()} == {0, 2}
    assert store.read("settings").count() == 3 and store.read("chunks", 1).count() == 8


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    import json

    from guidemill.streaming import ingest_stream

    body = "<h1>A</h1><p>" + "Guidance on the return and how to file it in time. " * 40 + "</p>"
    lines = [json.dumps({"base_path": "/a", "title": "A", "details": {"body": body + x}, "public_updated_at": f"2024-03-1{k}T09:30:00Z"}) for k, x in enumerate(("", "more"))]
    state = str(tmp_path / "state")
    batch = spark.createDataFrame([(x,) for x in [lines[0], lines[1], lines[1]]], "value string")
    for _ in range(2):
        ingest_stream.ingest_batch(batch, 0, state)
    store = Publication(spark, state)
    assert store.latest() == 1 and store.read("documents").count() == 1 and [r["action"] for r in store.read("outcomes").collect()] == ["created"]
    assert any("more" in r["content"] for r in ingest_stream.current_chunks(spark, state).collect())

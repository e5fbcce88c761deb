"""Graph expansion, resolution and crawl; ingest of snapshots; store changes; stream run mode."""

import json
import random

from pyspark.sql import functions as F

from guidemill.operators import graph, lookup, similarity, store
from guidemill.plans import ingest
from guidemill.streaming import ingest_stream

EDGE = ("reference_id long, source_chunk_id long, target_chunk_id long, reference_type string, reference_strength string, "
        "target_section_id string, is_resolved boolean")


def plain_expand(seed, edges, depth, strengths, cap):
    rank = {"required": 0, "recommended": 1, "optional": 2}
    seen, frontier, out = {seed}, [seed], []
    for hop in range(1, depth + 1):
        best = {}
        for e in edges:
            if e[1] in frontier and e[6] and e[4] in strengths and e[2] not in seen:
                best[e[2]] = min(best.get(e[2], (9, 1 << 60)), (rank[e[4]], e[0]))
        new = sorted(best, key=lambda t: (best[t][0], t))[: cap - len(seen)]
        out += [(seed, t, hop) for t in new]
        seen |= set(new)
        frontier = new
    return out


def test_expansion_equals_plain_loop(spark):
    rnd = random.Random(3)
    # node 0 is a hub that holds a third of all edges
    edges = [(i, 0 if i % 3 == 0 else rnd.randrange(60), rnd.randrange(60), "see_also", rnd.choice(["required", "recommended", "optional"]), None,
              rnd.random() < 0.9) for i in range(900)]
    edges = [e if e[6] else (*e[:2], None, *e[3:]) for e in edges]
    df = spark.createDataFrame(edges, EDGE)
    seeds = spark.range(60).select(F.col("id").alias("chunk_id"))
    got = graph.expand_references(seeds, df, 3, ("required", "recommended"), 8).where("hop > 0").collect()
    want = [x for s in range(60) for x in plain_expand(s, edges, 3, ("required", "recommended"), 8)]
    assert sorted((r.seed, r.chunk_id, r.hop) for r in got) == sorted(want)


def test_hub_edges_are_limited_before_the_exchange(spark):
    df = spark.createDataFrame([(1, 1, 2, "x", "required", None, True)], EDGE)
    plan = graph.usable_edges(df, ["required"], 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_resolution_flags_and_circles(spark):
    df = spark.createDataFrame([(1, 1, 2, "definition", "required", "S2", True), (2, 2, 1, "see_also", "optional", "S1", True),
                                (3, 1, None, "see_also", "optional", "S3", False), (4, 3, None, "see_also", "optional", "S9", False)], EDGE)
    chunks = spark.createDataFrame([(1, "S1"), (2, "S2"), (3, "S3"), (4, "S3")], "chunk_id long, section_id string")
    r = {x.reference_id: (x.target_chunk_id, x.is_resolved) for x in graph.resolve_references(df, chunks).collect()}
    assert r[3] == (3, True) and r[4] == (None, False)
    f = {x.chunk_id: (x.has_outgoing_references, x.has_incoming_references) for x in graph.with_reference_flags(chunks, df).collect()}
    assert f == {1: (True, True), 2: (True, True), 3: (True, False), 4: (False, False)}
    assert [tuple(x) for x in graph.circular_references(df).collect()] == [(1, 2)]


def test_crawl_with_failures_and_cap(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "e"), ("e", "a"), ("d", "f")], "source string, target string")
    roots = spark.createDataFrame([("a",)], "node string")
    failed = spark.createDataFrame([("b",)], "node string")
    assert sorted(tuple(r) for r in graph.crawl(edges, roots, failed).collect()) == [("a", 0), ("c", 1), ("e", 2)]
    assert [r.node for r in graph.crawl(edges, roots, max_nodes=4).collect()] == ["a", "b", "c", "d"]


def pages(spark, rows):
    df = spark.createDataFrame(rows, "input_idx long, url string, full_text string, error string")
    sec = F.array(F.struct(F.lit("T").alias("heading"), F.lit(1).alias("level"), F.col("full_text").alias("content"), F.lit("T").alias("heading_path")))
    return df.withColumns({
        "sections": sec, "word_count": F.size(F.split("full_text", " ")).cast("long"), "has_content": F.col("full_text") != "",
        "title": F.lit("T"), "parent_title": F.lit("P"), "section_hierarchy": F.array(F.lit("H")), "document_type": F.lit("answer"),
        "schema_name": F.lit("guide"), "first_published": F.lit("2024-01-02").cast("timestamp"), "last_updated": F.lit("2024-01-03").cast("timestamp")})


LONG = "word " * 40


def test_ingest_twice_is_unchanged(spark):
    first = pages(spark, [(0, "https://www.gov.uk/a", LONG, None), (1, "https://www.gov.uk/hmrc-internal-manuals/b", LONG + "b", None),
                          (2, "https://www.gov.uk/c", "", None), (3, "https://www.gov.uk/d", "too short", None), (4, "https://www.gov.uk/e", None, "gone")])
    empty = spark.createDataFrame([], ingest_stream.DOCUMENT_DDL)
    done = ingest.process(first, empty, materialize=True)
    out = {r.url.rsplit("/", 1)[1]: r for r in ingest.outcomes(done).collect()}
    assert {k: v.action for k, v in out.items()} == {"a": "created", "b": "created", "c": "skipped", "d": "skipped", "e": "failed"}
    assert out["d"].error == "Content too short (2 words)" and out["e"].error == "gone" and out["a"].chunks_created == 1
    docs = ingest.next_documents(empty, done, F.lit("2024-05-01").cast("timestamp")).checkpoint()
    assert {r.url[-1]: (r.authority, r.reliability_tier) for r in docs.collect()} == {"a": ("GOV_UK", 2), "b": ("HMRC_MANUAL", 1)}
    again = ingest.outcomes(ingest.process(first, docs)).collect()
    assert {r.reason for r in again if r.url[-1] in "ab"} == {"unchanged"} and all(r.action in ("skipped", "failed") for r in again)
    forced = ingest.outcomes(ingest.process(first, docs, ingest.IngestSettings(mode=ingest.FORCE_UPDATE))).collect()
    assert sum(r.action == "updated" for r in forced) == 2
    summary = ingest.run_summary(ingest.outcomes(done)).collect()[0]
    assert (summary.documents_created, summary.documents_skipped, summary.documents_failed, summary.status) == (2, 2, 1, "completed_with_errors")


def test_circles_of_any_length(spark):
    rnd = random.Random(3)
    for seed in range(3):
        pairs = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(30 + 10 * seed)} | {(100 + i, 100 + (i + 1) % 9) for i in range(9)} | {(200, 200), (300, 301), (301, 302)}
        df = spark.createDataFrame([(i, a, b, "see_also", "optional", None, True) for i, (a, b) in enumerate(sorted(pairs))] + [(999, 302, 300, "see_also", "optional", None, False)], EDGE)
        reach = {a: {b for x, b in pairs if x == a} for a in {n for p in pairs for n in p}}
        for _ in range(6):
            reach = {a: bs | {c for b in bs for c in reach[b]} for a, bs in reach.items()}
        want = {a: max(b for b in bs if a in reach[b]) for a, bs in reach.items() if a in bs}
        assert {r.chunk_id: r.circle for r in graph.circle_members(df).collect()} == want


def test_seeds_of_a_request_share_the_cap(spark):
    df = spark.createDataFrame([(i, a, b, "see_also", "required", None, True) for i, (a, b) in enumerate([(1, 2), (1, 10), (1, 11), (2, 12), (3, 13)])], EDGE)
    seeds = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "request string, chunk_id int")
    got = {(r.seed, r.chunk_id, r.hop) for r in graph.expand_references(seeds, df, max_total=4, request="request").collect()}
    assert got == {("x", 1, 0), ("x", 2, 0), ("x", 10, 1), ("x", 11, 1), ("y", 3, 0), ("y", 13, 1)}


def test_error_cap(spark):
    rows = [(i, f"https://x/{i}", LONG, "bad" if i % 2 else None) for i in range(20)]
    empty = spark.createDataFrame([], ingest_stream.DOCUMENT_DDL)
    o = ingest.outcomes(ingest.process(pages(spark, rows), empty, ingest.IngestSettings(max_errors=3))).collect()
    assert len(o) == 20 and sum(r.action == "failed" for r in o) == 3 and sum(r.action == "not_processed" for r in o) == 14
    assert sum(r.action == "created" for r in o) == 3
    uncapped = ingest.outcomes(ingest.process(pages(spark, [(i, f"https://x/{i}", LONG, "bad" if i < 60 else None) for i in range(70)]), empty)).collect()
    assert sum(r.action == "failed" for r in uncapped) == 60 and sum(r.action == "created" for r in uncapped) == 10


def test_a_url_twice_in_a_batch(spark):
    rows = [(0, "https://x/a", LONG + "old", None), (1, "https://x/b", LONG, None), (2, "https://x/a", LONG + "new", None)]
    empty = spark.createDataFrame([], ingest_stream.DOCUMENT_DDL)
    for done in (ingest.process(pages(spark, rows), empty), ingest.process_changed(pages(spark, rows), empty)[1]):
        docs = ingest.next_documents(empty, done, F.current_timestamp()).collect()
        chunks = ingest.new_chunks(done).collect()
        assert len(docs) == 2 and len({c.chunk_id for c in chunks}) == len(chunks)
        assert any(c.content.endswith("new") for c in chunks) and not any(c.content.endswith("old") for c in chunks)
    decisions, done = ingest.process_changed(pages(spark, rows), empty)
    assert ingest.outcomes_of_decisions(decisions, done).count() == 3


def test_unreadable_payloads_get_an_outcome(spark):
    from guidemill.sources.payloads import source_rows

    raw = spark.createDataFrame([("not json",), (None,), ("[1]",), (json.dumps({"base_path": "/a", "title": "A", "details": {"body": f"<p>{LONG}</p>"}}),)], "raw string")
    done = ingest_stream.latest_per_url(ingest.pages_from_sources(source_rows(raw))).withColumn("input_idx", F.monotonically_increasing_id())
    out = ingest.outcomes(ingest.process(done, spark.createDataFrame([], ingest_stream.DOCUMENT_DDL))).collect()
    assert sorted(r.action for r in out) == ["created", "failed", "failed", "failed"]
    assert {r.error for r in out if r.action == "failed"} == {"Payload is not readable json"}


def test_new_rows_with_one_key(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (2, "c"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, store.insert_new(old, new, "k").collect())) == [(1, "a"), (2, "b")]


def test_replaced_chunks(spark):
    old = pages(spark, [(0, "https://x/a", LONG, None), (1, "https://x/b", LONG, None)])
    empty = spark.createDataFrame([], ingest_stream.DOCUMENT_DDL)
    p0 = ingest.process(old, empty)
    docs, chunks = ingest.next_documents(empty, p0, F.current_timestamp()), ingest.new_chunks(p0)
    p1 = ingest.process(pages(spark, [(0, "https://x/a", LONG + "new", None), (1, "https://x/b", LONG, None)]), docs)
    got = ingest.next_chunks(chunks, p1).collect()
    assert {r.source_url[-1]: r.content.endswith("new") for r in got} == {"a": True, "b": False}


def test_two_passes_equal_one(spark):
    rows = [(i, f"https://x/{i}", "" if i == 3 else LONG + str(i), "gone" if i == 4 else None) for i in range(12)]
    empty = spark.createDataFrame([], ingest_stream.DOCUMENT_DDL)
    docs = ingest.next_documents(empty, ingest.process(pages(spark, rows[:8]), empty), F.current_timestamp()).checkpoint()
    new = pages(spark, [(i, u, t + (" changed" if i < 2 else ""), e) for i, u, t, e in rows])
    one = ingest.process(new, docs)
    decisions, done = ingest.process_changed(new, docs)
    cols = ["url", "reason", "action", "chunks_created", "error"]
    a = sorted(tuple(str(v) for v in r) for r in ingest.outcomes(one).select(cols).collect())
    b = sorted(tuple(str(v) for v in r) for r in ingest.outcomes_of_decisions(decisions, done).select(cols).collect())
    assert a == b and any("content_changed" in x for x in a)
    assert sorted(r.chunk_id for r in ingest.new_chunks(one).collect()) == sorted(r.chunk_id for r in ingest.new_chunks(done).collect())


def test_bucketed_chunk_table(spark, tmp_path):
    path = str(tmp_path / "chunks")
    empty = spark.createDataFrame([], ingest_stream.DOCUMENT_DDL)
    first = ingest.process(pages(spark, [(i, f"https://x/{i}", LONG + str(i), None) for i in range(9)]), empty)
    ingest.new_chunks(first).withColumn("bucket", ingest.bucket("document_id", 4)).write.partitionBy("bucket").parquet(path)
    docs = ingest.next_documents(empty, first, F.current_timestamp())
    again = ingest.process(pages(spark, [(0, "https://x/0", LONG + "new", None), (1, "https://x/1", LONG + "1", None)]), docs)
    ingest.replace_chunks(path, again, 4)
    got = {r.source_url[-1]: r.content for r in spark.read.parquet(path).collect()}
    assert len(got) == 9 and got["0"].endswith("new") and got["1"].endswith("1")
    assert spark.read.parquet(path).count() == 9


def test_store_changes(spark):
    s = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, name string, note string")
    ch = spark.createDataFrame([(1, None, "n1"), (3, "z", "n3")], "id int, name string, note string")
    assert sorted(tuple(r) for r in store.update(s, ch, "id").collect()) == [(1, "a", "n1"), (2, "b", "x")]
    assert sorted(r.id for r in store.insert_new(s, ch, "id").collect()) == [1, 2, 3]
    assert [r.id for r in store.delete(s, ch, "id").collect()] == [2]
    assert store.matched_count(s, ch, "id").collect()[0].matched == 1
    t = spark.createDataFrame([("100% sure",), ("100 sure",)], "name string")
    assert t.where(store.name_contains("name", "100% S")).count() == 1


def test_deadline_and_bands(spark):
    d = spark.createDataFrame([("2024-25", 31, 1), ("2024-25", 31, 7), ("2024-25", 5, 4)], "tax_year string, rule_day int, rule_month int").withColumns({
        "rule_type": F.lit("fixed"), "rule_value": F.lit(None).cast("int"), "rule_unit": F.lit(None).cast("string"), "event_date": F.lit(None).cast("date")})
    got = [str(r.calculated_date) for r in lookup.deadline_dates(d, F.lit("2025-06-01").cast("date")).collect()]
    assert got == ["2026-01-31", "2025-07-31", "2025-04-05"]
    bands = spark.createDataFrame([("t", 0, 0.0, 12570.0, 0), ("t", 1, 12571.0, 50270.0, 20), ("t", 2, 50271.0, None, 40)],
                                  "table_id string, row_idx int, lo double, hi double, result int")
    req = spark.createDataFrame([(1, "t", 60000.0), (2, "t", 100.0), (3, "u", 5.0)], "request_id int, table_id string, value double")
    assert {r.request_id: r.result for r in lookup.lookup_range(req, bands).collect()} == {1: 40, 2: 0, 3: None}


def test_nearest_equals_brute_force(spark):
    import numpy as np

    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").repartition(4)
    rows = v.collect()
    q = v.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r["rank"]): r.vec_id for r in similarity.nearest(v, q, 5).collect()}
    m = np.array([r.embedding for r in rows], dtype="float64")
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in rows])
    for i in range(3):
        order = np.lexsort((ids, -(m @ m[list(ids).index(i)])))[:5]
        assert [got[(i, k + 1)] for k in range(5)] == [int(ids[j]) for j in order]


def test_stream_run_mode(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def payload(path, body):
        return json.dumps({"base_path": path, "title": "T" + path, "details": {"body": body}, "public_updated_at": "2024-03-15T09:30:00Z"})

    (src / "1.json").write_text(payload("/a", f"<h1>A</h1><p>{LONG}</p>") + "\n" + payload("/b", f"<p>{LONG}</p>"))
    state, check = str(tmp_path / "state"), str(tmp_path / "check")
    q = ingest_stream.start(spark, str(src), state, check)
    q.awaitTermination(120)
    (src / "2.json").write_text(payload("/a", f"<h1>A</h1><p>{LONG} changed</p>") + "\n" + payload("/b", f"<p>{LONG}</p>"))
    q = ingest_stream.start(spark, str(src), state, check)
    q.awaitTermination(120)
    out = {r.url[-1]: r.action for r in spark.read.parquet(state + "/outcomes/version=2").collect()}
    assert out == {"a": "updated", "b": "skipped"}
    assert spark.read.parquet(state + "/documents/version=2").count() == 2
    assert spark.read.parquet(state + "/chunks/version=2").where("content like '%changed%'").count() == 1
    first = {r.source_url[-1]: r.content for r in ingest_stream.current_chunks(spark, state, 0).collect()}
    last = {r.source_url[-1]: r.content for r in ingest_stream.current_chunks(spark, state).collect()}
    assert set(first) == set(last) == {"a", "b"} and first["b"] == last["b"]
    assert "changed" in last["a"] and "changed" not in first["a"]
    assert {r.source_url[-1] for r in spark.read.parquet(state + "/chunks/version=2").collect()} == {"a"}  # only what changed
    ingest_stream.compact_chunks(spark, state, str(tmp_path / "flat"))
    assert spark.read.parquet(str(tmp_path / "flat")).count() == len(last)

"""The maintained reference graph against a full recomputation in plain Python after random changes."""

import random

from guidemill.operators import graph_delta as gd

EDGE_SCHEMA = "reference_id long, source_chunk_id long, target_chunk_id long, target_section_id string, is_resolved boolean"


def plain(chunks, edges):
    first = {}
    for c, s in chunks.items():
        if s is not None:
            first[s] = min(first.get(s, c), c)
    found, degrees = {}, {}
    for r, (a, b, s, done) in edges.items():
        found[r] = b if done else first.get(s) if s is not None else None
        for at, node in ((0, a), (1, found[r])):
            if node is not None:
                degrees.setdefault(node, [0, 0])[at] += 1
    return found, {k: tuple(v) for k, v in degrees.items()}


def state(graph):
    return ({r["reference_id"]: r["found"] for r in graph.edges.collect()}, {r["chunk_id"]: (r["outgoing"], r["incoming"]) for r in graph.degrees.collect()})


def saved(graph):
    return gd.ReferenceGraph(graph.chunks.checkpoint(), graph.edges.checkpoint(), graph.degrees.checkpoint())


def test_changes_equal_a_recomputation(spark):
    pick = random.Random(11)
    new_edge = lambda: (pick.randint(0, 40), pick.choice([None, *range(40)]), pick.choice([None, *"abcdef"]), pick.random() < 0.4)
    chunks = {c: pick.choice([None, *"abcde"]) for c in range(30)}
    edges = {r: new_edge() for r in range(120)}
    edge_rows = lambda d: spark.createDataFrame([(r, *v) for r, v in d.items()], EDGE_SCHEMA)
    chunk_rows = lambda d: spark.createDataFrame(list(d.items()), "chunk_id long, section_id string")
    graph = saved(gd.build(chunk_rows(chunks), edge_rows(edges)))
    assert state(graph) == plain(chunks, edges)
    for turn in range(5):
        put_c = {c: pick.choice([None, *"abcdef"]) for c in pick.sample(range(40), 4)}
        cut_c = set(pick.sample(range(40), 3 if turn else 0))
        put_e = {r: new_edge() for r in pick.sample(range(140), 9)}
        cut_e = set(pick.sample(range(140), 5))
        graph = saved(gd.apply_changes(graph, edge_rows(put_e), spark.createDataFrame([(r,) for r in cut_e], "reference_id long"),
                                       chunk_rows(put_c), spark.createDataFrame([(c,) for c in cut_c], "chunk_id long")))
        chunks = {c: s for c, s in {**chunks, **put_c}.items() if c not in cut_c}
        edges = {r: v for r, v in {**edges, **put_e}.items() if r not in cut_e and v[0] not in cut_c and not (v[3] and v[1] in cut_c)}
        assert state(graph) == plain(chunks, edges)
        assert sorted(r["chunk_id"] for r in graph.chunks.collect()) == sorted(chunks)


def test_no_change_and_parts(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "chunk_id long, section_id string")
    edges = spark.createDataFrame([(10, 1, 2, "x", True), (11, 3, None, "a", False), (12, 3, None, "z", None), (13, 2, None, None, False)], EDGE_SCHEMA)
    graph = saved(gd.build(chunks, edges))
    assert state(graph)[0] == {10: 2, 11: 1, 12: None, 13: None}
    assert state(gd.apply_changes(graph)) == state(graph)
    less = gd.apply_changes(graph, removed_chunks=spark.createDataFrame([(1,)], "chunk_id long"))
    assert state(less)[0] == {11: 2, 12: None, 13: None}
    assert {r["chunk_id"]: (r[1], r[2]) for r in gd.with_flags(less).collect()} == {2: (True, True), 3: (True, False)}

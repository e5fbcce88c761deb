"""Circles of a reference graph against a plain search."""

import random

import pytest

from guidemill.operators import circles


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, b is not None) for a, b in pairs], "source_chunk_id long, target_chunk_id long, is_resolved boolean").repartition(4)


def plain(pairs):
    after, before = {}, {}
    for a, b in pairs:
        if a is not None and b is not None:
            after.setdefault(a, set()).add(b)
            before.setdefault(b, set()).add(a)

    def reach(start, step):
        seen, todo = set(), [start]
        while todo:
            for n in step.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    out = {}
    for node in after:
        both = reach(node, after) & reach(node, before)
        if node in both:
            out[node] = max(both)
    return out


def found(df):
    rows = [(r["chunk_id"], r["circle"]) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("seed, nodes, edges", [(1, 12, 14), (2, 60, 68), (4, 120, 130)])
def test_random_graphs(spark, seed, nodes, edges):
    pick = random.Random(seed)
    pairs = [(pick.randrange(nodes), pick.randrange(nodes)) for _ in range(edges)]
    assert found(circles.circle_members(frame(spark, pairs))) == plain(pairs)


def test_shapes(spark):
    pairs = [(1, 2), (2, 1), (1, 2), (5, 5), (6, None), (None, 7), (10, 11), (11, 12), (12, 10), (12, 13), (13, 14)]  # circles of two, one and three, and what hangs on them
    pairs += [(20, 21), (21, 22), (22, 20), (22, 23), (23, 24), (24, 22)]  # two circles that share a node
    pairs += [(30, 31), (31, 32), (32, 33), (33, 31)] + [(40 + k, 41 + k) for k in range(6)] + [(46, 43)]
    assert found(circles.circle_members(frame(spark, pairs))) == plain(pairs)
    assert found(circles.circle_members(frame(spark, [(1, 2)]).limit(0))) == {} and found(circles.circle_members(frame(spark, [(1, 2), (2, 3)]))) == {}


def test_long_circle_and_chain_take_few_rounds(spark, monkeypatch):
    """Ten thousand nodes each, in random order of ids."""
    writes = []
    monkeypatch.setattr(circles, "written", lambda df, label, keep=circles.written: writes.append(label) or keep(df, label))
    ids = list(range(20_000))
    random.Random(3).shuffle(ids)
    ring, chain = ids[:10_000], ids[10_000:]
    pairs = list(zip(ring, ring[1:] + ring[:1])) + list(zip(chain, chain[1:]))
    assert found(circles.circle_members(frame(spark, pairs))) == {n: max(ring) for n in ring}
    assert len(writes) <= 40


def test_long_ladder_takes_few_rounds(spark, monkeypatch):
    """No node is on a chain: 40 rungs, closed to a circle."""
    writes = []
    monkeypatch.setattr(circles, "written", lambda df, label, keep=circles.written: writes.append(label) or keep(df, label))
    pairs = [p for k in range(40) for p in ((2 * k, 2 * k + 1), (2 * k, 2 * k + 2), (2 * k + 1, 2 * k + 3), (2 * k, 2 * k + 3))]
    assert found(circles.circle_members(frame(spark, [*pairs, (80, 0), (81, 0), (80, 81)]))) == {n: 81 for n in range(82)}
    assert len(writes) <= 45


def test_labels_do_not_travel(spark, monkeypatch):
    """A label follows from its node; what is written of a step is the node, its best label and whether that grew."""
    kinds = []
    monkeypatch.setattr(circles, "written", lambda df, label, keep=circles.written: kinds.append((label, tuple(df.columns))) or keep(df, label))
    pairs = [(1, 2), (2, 3), (3, 1), (2, 1), (3, 2), (3, 4), (4, 5), (5, 4), (4, 6), (6, 5), (5, 6)]
    assert found(circles.circle_members(frame(spark, pairs))) == plain(pairs)
    assert {columns for label, columns in kinds if label == "reach"} == {("node", "best", "moved")}


def test_sparse_graph_takes_few_steps(spark, monkeypatch):
    """As many edges as nodes: long thin paths, on which labels would go on for dozens of steps."""
    writes = []
    monkeypatch.setattr(circles, "written", lambda df, label, keep=circles.written: writes.append(label) or keep(df, label))
    pick = random.Random(7)
    pairs = [(pick.randrange(3_000), pick.randrange(3_000)) for _ in range(3_200)] + [(k, k + 1) for k in range(4_000, 4_300)] + [(4_300, 4_000), (4_200, 4_100)]
    want = plain(pairs)
    assert found(circles.circle_members(frame(spark, pairs))) == want and len(set(want.values())) > 2
    assert len(writes) <= 10


@pytest.mark.parametrize("most", [0, 30])
def test_more_edges_than_a_task_holds(spark, monkeypatch, most):
    """Trimming, chains and labels by joins alone, and until the rest fits a task."""
    monkeypatch.setattr(circles, "TASK_EDGES", most)
    writes = []
    monkeypatch.setattr(circles, "written", lambda df, label, keep=circles.written: writes.append(label) or keep(df, label))
    pick = random.Random(9)
    pairs = [(pick.randrange(60), pick.randrange(60)) for _ in range(75)] + [(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (104, 103), (200, 201), (201, 200), (7, 7)]
    assert found(circles.circle_members(frame(spark, pairs))) == plain(pairs)
    assert "trimmed" in writes and ("finished" in writes) == (most > 0)


def test_sets_of_a_task_for_any_kind_of_key(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("f", "f")]
    edges = spark.createDataFrame([(a, b, True) for a, b in pairs], "source_chunk_id string, target_chunk_id string, is_resolved boolean").repartition(3)
    assert found(circles.circle_members(edges)) == {"a": "c", "b": "c", "c": "c", "d": "e", "e": "e", "f": "f"}
    sets = circles._by_one_task(edges.where("source_chunk_id <> target_chunk_id").selectExpr("source_chunk_id AS a", "target_chunk_id AS b"), 1).collect()
    assert sorted(sorted(r["node"] for r in sets if r["set"] == s) for s in {r["set"] for r in sets}) == [["a", "b", "c"], ["d", "e"]]


def test_node_of_a_chain_that_leads_to_itself(spark, monkeypatch):
    """It belongs to the circle of its chain, once, and to one of its own where the chain lies on none."""
    monkeypatch.setattr(circles, "TASK_EDGES", 0, raising=False)
    pairs = [(1, 2), (2, 3), (3, 1), (1, 3), (2, 2), (10, 11), (11, 12), (12, 10), (10, 12), (10, 20), (20, 21), (21, 1), (20, 20)]
    assert found(circles.circle_members(frame(spark, pairs))) == plain(pairs)

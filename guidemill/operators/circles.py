"""Circles of a reference graph: sets of chunks that reach each other, in a number of rounds that grows with the logarithm of their length.

Each round works on the edges that may still lie on a circle:

1. Chains, nodes with one edge in and one edge out, are replaced by one edge from what leads into the chain to what it
   leads to.  Pointers to both ends are found by doubling: after k jumps a pointer spans 2^k nodes.  A chain that never
   ends is a circle by itself.
2. Nodes that nothing leads to, or that lead nowhere, are dropped.
3. Every node gets a random label and learns the largest label that reaches it, along edges and by jumping: what reaches
   the node of that label reaches it, too.  Within the nodes of one label the same is done backwards; those that reach the node of
   the label are one set.  The rest falls into smaller parts, by both labels, and goes into the next round.

Every step is a join or aggregate over edges, written once; nothing is collected.  Sides of joins meet by exchange: there is a join a
round and more, and tables broadcast each time would all pass through the driver.

Long thin paths take many such steps over few edges.  Edges beyond ``TASK_EDGES`` are trimmed for as long as that takes out a good part
of them; a rest within it whose labels do not settle in ``TASK_STEPS`` steps is finished by one task, in time linear in its edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from guidemill.sources.tables import written

TASK_EDGES = 1 << 20  # edges that one task may hold, some 300 MB of its Python process
TASK_STEPS = 2  # label steps before a rest that fits a task goes there


def circle_members(edges: DataFrame) -> DataFrame:
    """(chunk_id, circle): chunks on a circle of any length; ``circle`` is the largest chunk of the mutually reachable set.

    Resolved edges with a target count; repeated edges count once, an edge to itself is a circle of one.  No edges: no rows.
    """
    pairs = written(edges.where(F.col("is_resolved") & F.col("source_chunk_id").isNotNull() & F.col("target_chunk_id").isNotNull()).select(
        F.col("source_chunk_id").alias("a"), F.col("target_chunk_id").alias("b")).distinct(), "pairs")
    loops = pairs.where("a = b").select(F.col("a").alias("node"))
    sets: list[DataFrame] = []  # (node, set) of finished sets
    chains: list[tuple[DataFrame, DataFrame]] = []  # (node, head, tail) of the chains taken out, and (node) of those a chain leads back to, round by round
    rest, turn = pairs.where("a <> b"), 0
    while count := rest.count():
        turn += 1
        rest, count = _shrunk(rest, count)
        if count > TASK_EDGES:
            inner, rings, rest = _contract(rest)
            if inner is not None:
                chains.append((inner, rest.where("a = b").select(F.col("a").alias("node"))))
                sets.append(rings)
            rest = written(_trim(rest.where("a <> b")), "trimmed")
            count = rest.count()
        if not count:
            break
        if turn > 1 and count <= TASK_EDGES:
            sets.append(_by_one_task(rest, turn))
            break
        nodes = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        forward = _largest_label(rest, nodes, turn, count)
        if forward is None:
            sets.append(_by_one_task(rest, turn))
            break
        ends = forward.select("node", "best")
        same = written(
            rest.join(ends.select(F.col("node").alias("a"), F.col("best").alias("fa")).hint("merge"), "a").join(ends.select(F.col("node").alias("b"), F.col("best").alias("fb")).hint("merge"), "b")
            .where("fa = fb").select("a", "b", "fa"), "classes")
        backward = _largest_label(same.select(F.col("b").alias("a"), F.col("a").alias("b")), nodes, turn, count)
        if backward is None:  # edges between nodes of two labels lie on no circle
            sets.append(_by_one_task(same.select("a", "b"), turn))
            break
        both = written(forward.select("node", F.col("best").alias("f")).join(backward.select("node", F.col("best").alias("r")).hint("merge"), "node"), "labels")
        sizes = both.where("f = r").groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f")
        sets.append(both.where("f = r").join(sizes.hint("merge"), "f", "left_semi").select("node", F.concat(F.lit(f"label {turn} "), F.col("f").cast("string")).alias("set")))
        left = both.where("f <> r").select("node", "r")
        rest = written(
            same.join(left.select(F.col("node").alias("a"), F.col("r").alias("ra")).hint("merge"), "a").join(left.select(F.col("node").alias("b"), F.col("r").alias("rb")).hint("merge"), "b")
            .where("ra = rb").select("a", "b"), "rest")
    found = None
    for part in sets:
        found = part if found is None else found.unionByName(part)
    for inner, turned in reversed(chains):
        found = written(_with_single(found, turned), "sets")
        held = inner.join(found.select(F.col("node").alias("head"), F.col("set").alias("set")).hint("merge"), "head").join(
            found.select(F.col("node").alias("tail"), F.col("set").alias("at_tail")).hint("merge"), "tail").where("set = at_tail").select("node", "set")
        found = found.unionByName(held)
    found = written(_with_single(found, loops), "sets")  # last: a node of a chain is known only now
    largest = found.groupBy("set").agg(F.max("node").alias("circle"))
    return found.join(largest.hint("merge"), "set").select(F.col("node").alias("chunk_id"), "circle")


def _with_single(found: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """Nodes that lead to themselves are sets of one unless they are in a set already."""
    alone = nodes.withColumn("set", F.concat(F.lit("loop "), F.col("node").cast("string")))
    return alone if found is None else found.unionByName(alone.join(found.select("node").hint("merge"), "node", "left_anti"))


def _contract(edges: DataFrame) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """Chains as (node, head, tail), circles that are nothing but a chain as (node, set), and the edges left.

    Without chains the edges come back as they are.
    """
    arriving = edges.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("head")).where("n = 1")
    leaving = edges.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("tail")).where("n = 1")
    inner = arriving.drop("n").join(leaving.drop("n").hint("merge"), "node")
    members = inner.select("node")
    on_chain = lambda df, column: df.join(members.select(F.col("node").alias(column), F.lit(True).alias(f"{column}_open")).hint("merge"), column, "left").fillna(False, f"{column}_open")
    state = written(on_chain(on_chain(inner, "head"), "tail").select("node", "head", "tail", "head_open", "tail_open", F.col("node").alias("top")), "chains")
    size, span = state.count(), 1
    if not size:
        return None, None, edges
    while span < size:
        open_ = state.where("head_open OR tail_open")
        if open_.isEmpty():
            break
        # Only pointers that still lead into a chain meet others, so a hub that many chains lead to is no key of a join.
        ahead = state.select(F.col("node").alias("tail"), F.col("tail").alias("next"), F.col("tail_open").alias("next_open"), F.col("top").alias("next_top"))
        behind = state.select(F.col("node").alias("head"), F.col("head").alias("back"), F.col("head_open").alias("back_open"))
        tails = state.where("tail_open").join(ahead.hint("merge"), "tail").select("node", F.col("next").alias("new_tail"), F.col("next_open").alias("new_tail_open"), "next_top")
        heads = state.where("head_open").join(behind.hint("merge"), "head").select("node", F.col("back").alias("new_head"), F.col("back_open").alias("new_head_open"))
        moved = open_.join(tails.hint("merge"), "node", "left").join(heads.hint("merge"), "node", "left").select(
            "node", F.coalesce("new_head", "head").alias("head"), F.coalesce("new_tail", "tail").alias("tail"), F.coalesce("new_head_open", "head_open").alias("head_open"),
            F.coalesce("new_tail_open", "tail_open").alias("tail_open"), F.greatest("top", F.coalesce("next_top", "top")).alias("top"))
        state = written(moved.unionByName(state.where("NOT head_open AND NOT tail_open")), "chains")
        span *= 2
    rings = state.where("tail_open").select("node", F.concat(F.lit("ring "), F.col("top").cast("string")).alias("set"))
    done = state.where("NOT tail_open AND NOT head_open").select("node", "head", "tail")
    others = edges.join(members.withColumnRenamed("node", "a").hint("merge"), "a", "left_anti").join(members.withColumnRenamed("node", "b").hint("merge"), "b", "left_anti").select("a", "b")
    left = written(others.unionByName(done.select(F.col("head").alias("a"), F.col("tail").alias("b"))).distinct(), "contracted")
    return done, rings, left


def _shrunk(edges: DataFrame, count: int) -> tuple[DataFrame, int]:
    """Edges that may lie on a circle, and how many: trimmed while they are too many for a task and a quarter goes each time."""
    while count > TASK_EDGES:
        edges = written(_trim(edges), "trimmed")
        before, count = count, edges.count()
        if count > before * 3 / 4:
            break
    return edges, count


def _trim(edges: DataFrame) -> DataFrame:
    """Edges whose start something leads to and whose end leads somewhere; one step."""
    return edges.join(edges.select(F.col("b").alias("a")).distinct().hint("merge"), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct().hint("merge"), "b", "left_semi").select("a", "b")


def _label(node: str, turn: int) -> Column:
    """The label of a node in a round; it follows from the node, so it need not travel."""
    return F.xxhash64(node, F.lit(turn))


def _largest_label(edges: DataFrame, nodes: DataFrame, turn: int, count: int) -> DataFrame | None:
    """(node, best): the largest label of the nodes from which a node can be reached, itself included.

    Only nodes whose label grew in the step before send it on: what others hold has been sent.  None if that goes on although
    the edges (``count`` at most) fit a task.
    """
    state, steps = written(nodes.select("node", _label("node", turn).alias("best"), F.lit(True).alias("moved")), "reach"), 0
    while count > TASK_EDGES or steps < TASK_STEPS:
        sent = edges.join(state.where("moved").select(F.col("node").alias("a"), "best").hint("merge"), "a").groupBy(F.col("b").alias("node")).agg(F.max("best").alias("sent"))
        stepped = state.join(sent.hint("merge"), "node", "left").select("node", F.greatest("best", F.coalesce("sent", "best")).alias("best"), F.col("best").alias("old"))
        further = state.where(F.col("best") > _label("node", turn)).select(_label("node", turn).alias("best"), F.col("best").alias("jump"))
        state, steps = written(stepped.join(further.hint("merge"), "best", "left").select(
            "node", F.coalesce("jump", "best").alias("best"), (F.coalesce("jump", "best") > F.col("old")).alias("moved")), "reach"), steps + 1
        if state.where("moved").isEmpty():
            return state.drop("moved")
    return None


def _by_one_task(edges: DataFrame, turn: int) -> DataFrame:
    """(node, set) of the sets of two nodes and more; all edges go to one task of an executor."""
    schema = StructType([StructField("node", edges.schema["a"].dataType), StructField("number", LongType())])
    found = written(edges.select("a", "b").coalesce(1).mapInArrow(_sets_of(schema.names), schema), "finished")
    return found.select("node", F.concat(F.lit(f"task {turn} "), F.col("number").cast("string")).alias("set"))


def _sets_of(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        nodes = pa.chunked_array([batch.column(side) for side in (0, 1) for batch in held]).combine_chunks().dictionary_encode()
        a, b = np.split(nodes.indices.to_numpy(), 2)
        number = strong_sets(a, b, len(nodes.dictionary))
        kept = np.flatnonzero(np.bincount(number, minlength=len(number))[number] > 1)
        yield pa.RecordBatch.from_arrays([nodes.dictionary.take(pa.array(kept)), pa.array(number[kept])], names=names)

    return sets


def strong_sets(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """For each of the nodes 0 .. size - 1 a node of its set of mutually reachable nodes, the same for all of a set (edges a to b; Tarjan)."""
    ends = np.cumsum(np.bincount(a, minlength=size))
    after, upto, at = b[np.argsort(a, kind="stable")].tolist(), ends.tolist(), [0, *ends[:-1].tolist()]
    seen, low, number = [0] * size, [0] * size, [-1] * size  # order of the visit (0: none yet), earliest open node within reach, set
    clock, open_ = 0, []
    for root in range(size):
        path = [] if seen[root] else [root]
        while path:
            x = path[-1]
            if not seen[x]:
                clock += 1
                seen[x] = low[x] = clock
                open_.append(x)
            if at[x] < upto[x]:
                y = after[at[x]]
                at[x] += 1
                if not seen[y]:
                    path.append(y)
                elif number[y] < 0 and seen[y] < low[x]:
                    low[x] = seen[y]
                continue
            path.pop()
            if path and low[x] < low[path[-1]]:
                low[path[-1]] = low[x]
            while low[x] == seen[x] and number[x] < 0:
                number[open_.pop()] = x
    return np.array(number, np.int64)

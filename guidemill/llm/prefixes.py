"""Prefix trie of conversations: union-find over the LCP edges of sorted neighbours, in descending depth.

A conversation is the sequence of its turns, each a 16-byte hash of role and text; sequences are sorted, so a trie node at
depth d is a run of neighbours that share at least d turns.  In every range of the sort the edges between neighbours are
taken from the deepest to the shallowest.  Each union of two components makes or extends a branching node, and the
turns between it and the node below are its unary chain.

Nodes that reach neither end of a range are finished there.  The others lie on the paths of the range's first and last
conversation.  Such a range is contracted to these two paths, with what hangs off each of their nodes summed up (members,
children, leaves, saved tokens), and the contracted ranges are merged by the same procedure, ``fan`` at a time, until one is
left.  Nothing but the two border paths of a range leaves it besides finished nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidemill.llm.common import materialize

KEY = 16  # bytes of a turn in a path
PIECE = 4096  # ids of one piece of a list of conversations that end at a node
ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"

ATTACHED = ("depth", "n", "low", "kids", "leaves", "saved", "ended")
ATT = pa.struct([(n, pa.int64()) for n in ATTACHED])
COLUMNS = [
    ("kind", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("parent_key", pa.binary()), ("node_key", pa.binary()), ("end_key", pa.binary()),
    ("part", pa.int64()), ("side", pa.int32()), ("path", pa.binary()), ("words", pa.list_(pa.int32())), ("atts", pa.list_(ATT)), ("ids", pa.string())]
DDL = ("kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_key binary, node_key binary, end_key binary, "
       "part long, side int, path binary, words array<int>, atts array<struct<depth long, n long, low long, kids long, leaves long, saved long, ended long>>, ids string")
NODE, BORDER, ENDS = 0, 1, 2


def prefix_key(path: bytes) -> bytes:
    return hashlib.sha256(path).digest()[:KEY]


def shared_turns(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size // KEY
    return int(np.argmax(np.frombuffer(a, np.uint8, size) != np.frombuffer(b, np.uint8, size))) // KEY


class _Part:
    """A component: the node it currently ends in, what lies below it, and the attached sums still to come above it."""

    __slots__ = ("top", "n", "low", "kids", "leaves", "saved", "ended", "waiting", "words", "atts", "left", "right")

    def __init__(self, top: int, words, atts: list[tuple], left: bool, right: bool):
        self.top, self.words, self.left, self.right = top, words, left, right
        self.atts = sorted(atts)
        self.clear()
        self.take()

    def clear(self):
        self.n, self.low, self.kids, self.leaves, self.saved, self.ended, self.waiting = 0, None, 0, 0, 0, 0, []

    def add(self, n, low, kids, leaves, saved, ended):
        self.n += n
        self.low = low if self.low is None else self.low if low is None else min(low, self.low)
        self.kids += kids
        self.leaves += leaves
        self.saved += saved
        self.ended |= ended

    def take(self):
        while self.atts and self.atts[-1][0] == self.top:
            self.add(*self.atts.pop()[1:])


class Forest:
    """The trie over sorted rows of one range; ``final`` if there is nothing left or right of it."""

    def __init__(self, final: bool, keyed: bool):
        self.final, self.keyed = final, keyed
        self.parts: list[_Part] = []
        self.edges: list[int] = []
        self.nodes: list[list] = []
        self.first, self.last = b"", b""
        self.first_words = self.last_words = ()
        self.border: dict[str, list[tuple]] = {"left": [], "right": []}

    def add(self, path: bytes, words, atts: list[tuple]):
        if self.parts:
            self.edges.append(shared_turns(self.last, path))
        else:
            self.first, self.first_words = path, words
        self.last, self.last_words = path, words
        self.parts.append(_Part(len(path) // KEY, words, atts, not self.final and not self.parts, False))

    def _lift(self, part: _Part, depth: int, paths: dict):
        """Finish the part's nodes below ``depth``, so that it becomes a child of a node there."""
        while part.top > depth:
            j = part.top
            if part.left or part.right:  # the node goes on beyond the range
                path = self.first if part.left else self.last
                key = prefix_key(path[: KEY * j]) if part.waiting else None
                for row in part.waiting:
                    self.nodes[row][7] = key
                self.border["left" if part.left else "right"].append((j, part.n, part.low, part.kids, part.leaves, part.saved, part.ended))
                part.clear()
            else:
                leaves = part.leaves if part.kids else 1
                saved = part.saved + (part.n - 1) * int(part.words[j - 1]) if j else part.saved
                for row in part.waiting:
                    self.nodes[row][2] = part.low
                key = prefix_key(paths[id(part)][: KEY * j]) if self.keyed else None
                end = None if not part.ended else key if self.keyed else paths[id(part)]
                self.nodes.append([part.low, j, None, part.n, part.kids, leaves, saved, None, key, end])
                n, low = part.n, part.low
                part.clear()
                part.add(n, low, 1, leaves, saved, 0)
                part.waiting = [len(self.nodes) - 1]
            part.top = j - 1
            part.take()

    def solve(self, keys: list[bytes]):
        """``keys``: the whole path of each row if nodes are keyed, else the key of the path."""
        if not self.parts:
            return
        parts, paths = self.parts, {id(p): k for p, k in zip(self.parts, keys)}
        parts[-1].right = not self.final
        root = list(range(len(parts)))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        depth_of = np.array(self.edges, np.int64)
        for at in np.argsort(-depth_of, kind="stable").tolist():
            a, b = parts[find(at)], parts[find(at + 1)]
            depth = int(depth_of[at])
            self._lift(a, depth, paths)
            self._lift(b, depth, paths)
            a.add(b.n, b.low, b.kids, b.leaves, b.saved, b.ended)
            if len(a.waiting) < len(b.waiting):
                a.waiting, b.waiting = b.waiting, a.waiting
            a.waiting.extend(b.waiting)
            a.atts = sorted(a.atts + b.atts) if a.atts and b.atts else a.atts or b.atts
            a.left, a.right = a.left or b.left, a.right or b.right
            root[find(at + 1)] = find(at)
        self._lift(parts[find(0)], -1, paths)

    def rows(self, part: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.nodes), ROWS):
            some = self.nodes[at: at + ROWS]
            yield _batch(len(some), kind=[NODE] * len(some), **{n: [r[k] for r in some] for k, n in enumerate(
                ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "parent_key", "node_key", "end_key"))})
        if self.parts and not self.final:
            sides = [(0, self.first, self.first_words, self.border["left"])] + ([(1, self.last, self.last_words, self.border["right"])] if self.last != self.first else [])
            yield _batch(len(sides), kind=[BORDER] * len(sides), part=[part] * len(sides), side=[s[0] for s in sides], path=[s[1] for s in sides],
                         words=[list(s[2]) for s in sides], atts=[[dict(zip(ATTACHED, a)) for a in s[3]] for s in sides])


def _batch(size: int, **given) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(given[n], t) if n in given else pa.nulls(size, t) for n, t in COLUMNS], names=[n for n, _ in COLUMNS])


def _first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trie of one sorted range of (path, words, id), and the ids of the conversations that end at each path, in pieces."""
    forest, keys, previous, key = Forest(False, False), [], None, b""
    ends: list[tuple[bytes, int, str]] = []
    run: list[int] = []

    def close():
        if run:
            ends.append((key, run[0], ",".join(map(str, run))))
            run.clear()

    for batch in batches:
        for path, words, conv in zip(batch.column(0), batch.column(1), batch.column(2)):
            path, conv = path.as_py(), conv.as_py()
            if path != previous or len(run) >= PIECE:
                close()
            if path != previous:
                previous, key = path, prefix_key(path)
            run.append(conv)
            keys.append(key)
            forest.add(path, words.values.to_numpy(), [(len(path) // KEY, 1, conv, 0, 0, 0, 1)])
        for at in range(0, len(ends), ROWS):
            some = ends[at: at + ROWS]
            yield _batch(len(some), kind=[ENDS] * len(some), end_key=[e[0] for e in some], conv_id=[e[1] for e in some], ids=[e[2] for e in some])
        ends.clear()
    close()
    if ends:
        yield _batch(len(ends), kind=[ENDS] * len(ends), end_key=[e[0] for e in ends], conv_id=[e[1] for e in ends], ids=[e[2] for e in ends])
    forest.solve(keys)
    yield from forest.rows(TaskContext.get().partitionId())


def _contract(final: bool):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["side"]))
        forest = Forest(final, True)
        for r in rows:
            forest.add(r["path"], r["words"], [tuple(a[n] for n in ATTACHED) for a in r["atts"]])
        forest.solve([r["path"] for r in rows])
        return pa.Table.from_batches(list(forest.rows(rows[0]["next"])) or [_batch(0)])

    return run


def number_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, pos, key, words): turns numbered from 1 in the order of turn (null first), role and text.

    A null role or text counts as empty; rows with a null id belong to no conversation.  The order comes from a range sort,
    so one conversation may span tasks; the few conversations that cross a border get the sizes of their earlier parts added.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    order = [F.col("id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    key = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * KEY))

    def count(batches):
        last, seen = None, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            starts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
            at = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids)))) + 1
            if ids[0] == last:
                at[: starts[1] if len(starts) > 1 else len(ids)] += seen
            last, seen = ids[-1], int(at[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at), pa.array(np.full(len(ids), part)), batch.column(1), batch.column(2)], names=["id", "pos", "part", "key", "words"])

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    counted = materialize(ordered.select("id", key.alias("key"), F.regexp_count("text", F.lit(WORD)).alias("words")).mapInArrow(count, "id long, pos long, part long, key binary, words int"), "turns")
    parts = counted.groupBy("id", "part").agg(F.max("pos").alias("n"))
    torn = parts.groupBy("id").agg(F.count(F.lit(1)).alias("parts"), F.collect_list(F.struct("part", "n")).alias("all")).where("parts > 1")
    before = torn.select("id", F.explode("all").alias("at"), "all").select(
        "id", F.col("at.part").alias("part"), F.aggregate(F.filter("all", lambda x: x["part"] < F.col("at.part")), F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("before"))
    return counted.join(F.broadcast(before), ["id", "part"], "left").select("id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "words")


def share_openings(turns: DataFrame, group: int = 20, choices: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations as (id, section, pos, key, words), and all their ids.

    Conversation c opens with the first h turns of conversation c - c % group and goes on with its own turns after its first h;
    h = crc32(c as text) % choices.  A conversation may be left without turns.
    """
    opened = F.crc32(F.col("id").cast("string").cast("binary")) % choices
    ids = turns.select("id").distinct().withColumn("h", opened)
    first = turns.where(F.col("pos") < choices).select(F.col("id").alias("base"), "pos", "key", "words")
    opening = ids.where("h > 0").withColumn("base", F.col("id") - F.col("id") % group).join(first, "base").where("pos <= h").select("id", F.lit(0).alias("section"), "pos", "key", "words")
    own = turns.where(F.col("pos") > opened).select("id", F.lit(1).alias("section"), "pos", "key", "words")
    return opening.unionByName(own), ids.select("id")


def sequences(turns: DataFrame, ids: DataFrame, order: list[str]) -> DataFrame:
    """(id, path, words): one row per conversation, 20 bytes a turn; texts stay behind.  Conversations without turns have empty paths."""
    made = turns.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(*order, "key", "words"))).alias("t")).select(
        "id", F.unhex(F.array_join(F.transform("t.key", F.hex), "")).alias("path"), F.col("t.words").alias("words"))
    return ids.join(made, "id", "left").select("id", F.coalesce("path", F.lit(b"")).alias("path"), F.coalesce("words", F.array().cast("array<int>")).alias("words"))


def prefix_trie(paths: DataFrame, fan: int = 64) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie over (id, path, words), and the conversations that end at a node.

    Nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, end_key; the key is
    set where conversations end, and leads to (end_key, conv_id, ids): their ids in ascending order, comma-joined, in pieces
    ordered by their first id conv_id.  No conversations: no nodes.  Equal conversations are one node and may span ranges.
    """
    ordered = paths.repartitionByRange("path", "id").sortWithinPartitions("path", "id").select("path", "words", "id")
    level = materialize(ordered.mapInArrow(_first_level, DDL), "trie")
    ends = level.where(F.col("kind") == ENDS).select("end_key", "conv_id", "ids")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "parent_key", "node_key", "end_key"]
    found = [level.where(F.col("kind") == NODE).select(*names)]
    while True:
        border = level.where(F.col("kind") == BORDER)
        parts = border.agg(F.max("part")).first()[0]
        final = parts is None or parts < fan
        dealt = border.withColumn("next", (F.lit(0) if final else F.floor(F.col("part") / fan)).cast("long"))
        level = materialize(dealt.groupBy("next").applyInArrow(_contract(final), DDL), "trie")
        found.append(level.where(F.col("kind") == NODE).select(*names))
        if final:
            break
    later = found[1]
    for more in found[2:]:
        later = later.unionByName(more)
    later = materialize(later, "spine")
    nodes = found[0].unionByName(later)
    spine = later.where("depth > 0").select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("above"))
    top = later.where("depth = 0").agg(F.min("conv_id")).first()[0]
    named = nodes.where("depth <= 1 OR parent_key IS NULL").withColumn("above", F.when(F.col("depth") == 1, F.lit(top).cast("long")))
    joined = nodes.where("depth > 1 AND parent_key IS NOT NULL").join(spine, "parent_key", "left").select(*named.columns)
    nodes = named.unionByName(joined).select(
        "conv_id", "depth", F.coalesce("above", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "end_key")
    return nodes, ends


def ends_digest(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes with ``ends_sha256``: SHA-256 of the joined ids, taken piece by piece in constant memory."""
    def run(batches):
        key, state, keys, sums = None, None, [], []
        for batch in batches:
            for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if key is not None:
                        keys.append(key)
                        sums.append(state.hexdigest())
                    key, state = k, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sums, pa.string())], names=["end_key", "ends_sha256"])
            keys, sums = [], []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["end_key", "ends_sha256"])

    sums = ends.repartition("end_key").sortWithinPartitions("end_key", "conv_id").select("end_key", "ids").mapInArrow(run, "end_key binary, ends_sha256 string")
    ended = nodes.where("end_key IS NOT NULL").join(sums, "end_key")
    return ended.unionByName(nodes.where("end_key IS NULL").withColumn("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))).drop("end_key")

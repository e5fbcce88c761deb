"""The conversation trie against a brute-force version."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from guidemill.llm import prefixes
from guidemill.llm.queries import conversation_trie

from test_operators import SPACES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(sequences):
    """Rows of the trie over {id: tuple of (role, text)}."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(re.findall(SPACES, p[-1][1])) if p else 0)
    ends = lambda p: ",".join(str(c) for c in sorted(members[p]) if len(sequences[c]) == len(p))
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items()}


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: tuple(t[2:] for t in sorted(ts)) for c, ts in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
    return {c: turns.get(c - c % 20, ())[: h[c]] + turns[c][h[c]:] for c in turns}


def found(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


@pytest.fixture
def many_ranges(spark):
    """Small inputs in many ranges of the sort, as large ones are."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "23"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed, fan", [(1, 2), (2, 3), (3, 64)])
def test_tries_across_ranges(spark, many_ranges, seed, fan):
    rng = np.random.default_rng(seed)
    made = {}
    for c in range(300):
        size = int(rng.integers(0, 7))
        made[c] = tuple((str(rng.choice(["u", "a"])), str(rng.choice(["x y", "z", ""], p=[0.8, 0.15, 0.05]))) for _ in range(size))
    for c in range(300, 420):  # a hot conversation, its prefixes and its extensions
        made[c] = (("u", "hot one"),) * int(rng.choice([12, 12, 12, 3, 13]))
    rows = [(c, d, r, t) for c, turns in made.items() for d, (r, t) in enumerate(turns)]
    turns = prefixes.number_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    ids = spark.createDataFrame([(c,) for c in made], "id long")
    got = found(prefixes.ends_digest(*prefixes.prefix_trie(prefixes.sequences(turns, ids, ["pos"]), fan=fan)))
    assert len(got) == len(set(got)) and set(got) == plain_trie(made)


def test_long_lists_of_equal_conversations(spark, monkeypatch):
    ids = spark.createDataFrame([(c,) for c in range(9000)], "id long")
    turns = prefixes.number_turns(spark.createDataFrame([(c, 0, "u", "same words") for c in range(9000)], "conv_id long, turn long, role string, text string"))
    nodes, ends = prefixes.prefix_trie(prefixes.sequences(turns, ids, ["pos"]))
    assert ends.count() >= 3
    assert set(found(prefixes.ends_digest(nodes, ends))) == plain_trie({c: (("u", "same words"),) for c in range(9000)})


def test_a_conversation_that_spans_ranges(spark, many_ranges):
    """Numbers go on across the borders of the sort; equal turns are ordered by role and text."""
    rows = [(7, t, "u", f"t{t}") for t in range(700)] + [(c, None, None, None) for c in (1, 9)] + [(7, 5, "a", "before"), (None, 1, "u", "x")]
    got = prefixes.number_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((r["id"], r["pos"]) for r in got.collect()) == [(1, 1), *((7, p) for p in range(1, 702)), (9, 1)]
    words = {r["pos"]: bytes(r["key"]) for r in got.where("id = 7").collect()}
    key = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()[:16]
    assert words[6] == key("a", "before") and words[7] == key("u", "t5") and words[701] == key("u", "t699")


def test_query(spark, many_ranges, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(int(c), int(t), str(rng.choice(["user", "assistant"])), str(rng.choice(["one two", "three", "four é x", " "]))) for c in rng.integers(0, 130, 400) for t in range(int(rng.integers(1, 6)))]
    rows += [(20, None, None, None), (25, 0, "system", None), (19, None, "user", "a"), (None, 0, "user", "lost"), (-7, 0, "user", "below"), (-7, 1, "user", "zero")]
    rows += [(c, t, "user", "very common") for c in range(1000, 1200) for t in range(5)]
    spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, id int, key string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    plain = plain_rebuilt([r for r in rows if r[0] is None or r[0] >= 0])
    got = found(conversation_trie(spark, str(tmp_path)))
    assert len(got) == len(set(got))
    own = tuple(t for t in (("user", "below"), ("user", "zero")))
    h = zlib.crc32(b"-7") % 4
    base = plain_rebuilt([(0, t, r, x) for c, t, r, x in rows if c == 0])  # -7 takes the openings of conversation 0
    opened = {c: v for c, v in {0: tuple((r or "", x or "") for c, t, r, x in sorted((q for q in rows if q[0] == 0), key=lambda q: (q[1] is not None, q[1] or 0, q[2] or "", q[3] or "")))}.items()}
    assert base.keys() <= {0}
    plain[-7] = opened.get(0, ())[:h] + own[h:]
    assert set(got) == plain_trie(plain)

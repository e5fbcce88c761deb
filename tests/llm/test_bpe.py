"""The streaming transducer against the tokenizers library and against plain merging."""

import hashlib
import random
import struct

import numpy as np
import pytest
import tokenizers

from guidemill.llm import bpe
from guidemill.llm.queries import llm_queries, vocabulary_files

from test_operators import base_docs, folder  # noqa: F401

PATH = vocabulary_files()[0]
PARTS = ["a", "e", "i", "n", "g", "s", "t", " ", "  ", "\n", "\t", "'", "'s", "'ll", "l", "1", "23", "!", "-", "=", "é", "中", "　", " ", "<|endoftext|>", "<|endof", "|>", "\U0001F600", "ͅ", "՘",
         "ing", "guarantee", " the", "\r\n", "x" * 50, " " * 40, " ", "\x85", "\x1c", "\U00010940"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def streamed(text, size):
    encoder = bpe.Encoder(PATH, bpe.word_classes(PATH))
    packed = b"".join([encoder.feed(text[k: k + size]) for k in range(0, len(text), size)] + [encoder.finish()])
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_short_texts_in_any_pieces(library):
    pick = random.Random(5)
    for _ in range(600):
        text = "".join(pick.choice(PARTS) for _ in range(pick.randint(0, 50)))
        want = library.encode(text, add_special_tokens=False).ids
        assert all(streamed(text, size) == want for size in (1, 2, 3, 7, 10_000)), text


def test_words_of_any_length(library):
    pick = random.Random(6)
    words = [t.decode() for t in bpe.load_merges(PATH).token.values() if t.isalpha() and t.isascii()]
    for _ in range(8):
        runs = ["".join(pick.choice(words) for _ in range(3000)), "".join(pick.choice("abcdeinst") for _ in range(9000)), " " + "".join(pick.choice("=-_#*") for _ in range(9000)) + "  x",
                "".join(pick.choice(" \n\t") for _ in range(9000)) + pick.choice(["", "z", " "]), "ß" * 6000 + "中文" * 3000, pick.choice(" \n=-a1_") * pick.randint(4000, 20_000) + pick.choice(["", "a", " b", "1"])]
        for text in runs:
            want = library.encode(text, add_special_tokens=False).ids
            assert all(streamed(text, size) == want for size in (1111, 4096, 70_000)), text[:20]


def test_memory_is_that_of_a_window():
    encoder = bpe.Encoder(PATH, bpe.word_classes(PATH))
    for piece in ["ab" * 20_000] * 10 + [" " * 30_000] * 3:
        encoder.feed(piece)
        assert len(encoder.window) <= encoder.merges.lookahead + bpe.BLOCK and len(encoder.open) <= bpe.LONG + 3 and len(encoder.tail) <= encoder.held


def plain_merge(data, rules):
    parts = [bytes([b]) for b in data]
    while True:
        found = min(((rules[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in rules), default=None)
        if found is None:
            return parts
        parts[found[1]: found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]


def test_lookahead_of_random_merge_lists():
    """Whatever follows, the tokens that end the lookahead before the end of a text stay as they are."""
    rng = np.random.default_rng(11)
    for _ in range(60):
        tokens, pairs = [bytes([c]) for c in b"abc"], []
        for _ in range(int(rng.integers(1, 14))):
            a, b = (tokens[int(k)] for k in rng.integers(0, len(tokens), 2))
            if a + b not in tokens:
                tokens.append(a + b)
                pairs.append((a, b))
        rules, look = {p: k for k, p in enumerate(pairs)}, bpe.sufficient_lookahead(pairs)
        for _ in range(60):
            text, more = (bytes(rng.choice(list(b"abc"), int(n))) for n in (rng.integers(1, 40), rng.integers(0, 20)))
            ends = lambda parts: set(np.cumsum([len(p) for p in parts]).tolist())
            alone, whole = ends(plain_merge(text, rules)), ends(plain_merge(text + more, rules))
            assert {e for e in alone if e <= len(text) - look} == {e for e in whole if e <= len(text) - look}


def test_merge_lists_without_a_bound_are_refused(tmp_path):
    import json

    parts = json.load(open(PATH, encoding="utf-8"))
    parts["model"]["merges"] = parts["model"]["merges"][::-1]
    (tmp_path / "v.json").write_text(json.dumps(parts))
    with pytest.raises(ValueError):
        bpe.load_merges(str(tmp_path / "v.json"))


def test_decoding_in_pieces(library):
    pick = random.Random(7)
    for _ in range(1500):
        ids = [pick.randrange(50_300) for _ in range(pick.randint(0, 25))]
        decoder = bpe.Decoder(PATH)
        text = "".join(decoder.feed(struct.pack("<I", i)) for i in ids) + decoder.feed(b"", True)
        assert text == library.decode(ids, skip_special_tokens=False)


def test_query(spark, library, folder, base_docs):  # noqa: F811
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in llm_queries()["op13_bpe"][0](spark, folder).collect()}
    want = set()
    for doc, text, *_ in base_docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.add((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want


def test_clashing_columns_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a text", 5), (1, "a text", 5), (None, None, None)], "doc_id long, text string, ids int")
    found = bpe.encode_documents(docs, PATH)
    assert found.columns == ["doc_id", "ids"] and found.count() == 3
    back = bpe.decode_documents(found.selectExpr("doc_id", "ids", "'x' AS text"), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == [(0, ""), (1, "a text"), (1, "a text")]
    nothing = bpe.decode_documents(spark.createDataFrame([(None,)], "ids binary"), PATH)
    assert [r["text"] for r in nothing.collect()] == [""]

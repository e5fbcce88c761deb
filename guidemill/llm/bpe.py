"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse as a byte-to-text state machine.

Merges run in the order of their rank, so text that follows a position can change tokens before it only through a chain
of rules of rising rank: one run merges a token to the left, which frees or takes the neighbour of the next, later rule.
Every link reaches back by the left side of its rule.  The longest such chain, found by dynamic programming over the merge
list, is the sufficient lookahead: a token that ends so many bytes before the end of what was read is stable and is
emitted.  A token boundary cuts the text into independent parts, so the transducer forgets what it has emitted and keeps
no more than one window of bytes, however long the text or a word in it is.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
import re
import struct
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame

from guidemill.llm.common import map_text

CHUNK = 1 << 16  # characters read at a time
LONG = 4096  # characters of an unfinished word from which on it is streamed through the window
BLOCK = 1024  # bytes a window takes beyond the lookahead
SHORT = 64  # bytes of a word up to which ranks are kept in a plain list
CACHE = 100_000  # stretches remembered per worker; beyond it the older half goes, but for those in use


def byte_letters() -> dict[str, int]:
    """The visible character that stands for each byte in a vocabulary file: printable Latin-1 as itself, the others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes before the end of a text whose tokens unseen text can still change.

    ``reach[x]`` is the longest chain so far whose last rule has x on its left.  A rule continues a chain if its right
    side begins with that x, which holds for all tokens on the left edge of the right side's own merges.
    """
    reach: dict[bytes, int] = {}
    opens: dict[bytes, bytes] = {}
    most = 0
    for left, right in merges:
        chain, edge = 0, right
        while edge is not None:
            chain = max(chain, reach.get(edge, 0))
            edge = opens.get(edge)
        reach[left] = max(reach.get(left, 0), chain + len(left))
        most = max(most, reach[left])
        opens[left + right] = left
    return most


@dataclass(frozen=True)
class Merges:
    """A vocabulary file: ids of single bytes, rank of each pair of ids, id made by the rule of a rank, bytes of each id, special strings."""

    of_byte: list[int]
    rank: dict[tuple[int, int], int]
    made: list[int]
    token: dict[int, bytes]
    special: dict[str, int]
    lookahead: int

    def merge(self, data: bytes) -> list[int]:
        """Ids of one word or window: always the rule of the lowest rank, the leftmost place first."""
        ids = [self.of_byte[b] for b in data]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        find, none = self.rank.get, len(self.made)
        ranks = [find(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < none:
            k = ranks.index(low)
            ids[k: k + 2] = [self.made[low]]
            del ranks[k]
            if k:
                ranks[k - 1] = find((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = find((ids[k], ids[k + 1]), none)
        return ids

    def _merge_long(self, ids: list[int | None]) -> list[int]:
        """The same with a heap of places, for windows."""
        rank, size = self.rank, len(ids)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(rank[pair], k, pair) for k in range(size - 1) if (pair := (ids[k], ids[k + 1])) in rank]
        heapq.heapify(heap)
        while heap:
            low, k, pair = heapq.heappop(heap)
            follower = after[k]
            if ids[k] != pair[0] or follower >= size or ids[follower] != pair[1]:
                continue
            made = self.made[low]
            ids[k], ids[follower] = made, None
            nearest = after[k] = after[follower]
            if nearest < size:
                before[nearest] = k
                if (new := (made, ids[nearest])) in rank:
                    heapq.heappush(heap, (rank[new], k, new))
            if (previous := before[k]) >= 0 and (new := (ids[previous], made)) in rank:
                heapq.heappush(heap, (rank[new], previous, new))
        return [i for i in ids if i is not None]


@functools.lru_cache(maxsize=4)
def load_merges(path: str) -> Merges:
    """Read a vocabulary file.

    The lookahead holds for merge lists in which every rule joins tokens of earlier rules and makes a token of its own;
    others are refused, as are options that change how words are merged.
    """
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    model, letters = parts["model"], byte_letters()
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) or parts["normalizer"] or parts["pre_tokenizer"]["type"] != "ByteLevel":
        raise ValueError("the vocabulary is no plain byte-level merge list")
    raw = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
    of = {raw[t]: i for t, i in model["vocab"].items()}
    pairs = [tuple(raw[t] for t in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    known = {t for t in of if len(t) == 1}
    for left, right in pairs:
        if left not in known or right not in known or left + right in known:
            raise ValueError("the merge list uses a token before it is made, or makes it twice")
        known.add(left + right)
    special = {t["content"]: t["id"] for t in parts["added_tokens"]}
    return Merges([of[bytes([b])] for b in range(256)], {(of[a], of[b]): rank for rank, (a, b) in enumerate(pairs)}, [of[a + b] for a, b in pairs],
                  {i: t for t, i in of.items()} | {i: t.encode() for t, i in special.items()}, special, sufficient_lookahead(pairs))


def _ranges(points: list[int]) -> str:
    """The code points as the inside of a character class."""
    out, k = [], 0
    while k < len(points):
        last = k
        while last + 1 < len(points) and points[last + 1] == points[last] + 1:
            last += 1
        out.append(f"\\U{points[k]:08X}" + (f"-\\U{points[last]:08X}" if last > k else ""))
        k = last + 1
    return "".join(out)


@functools.lru_cache(maxsize=4)
def word_classes(path: str) -> tuple[str, str, str]:
    """Letters, numbers and white space, as the insides of character classes, as the tokenizer's own splitter sees them.

    Libraries carry different Unicode versions, so every code point that this Python does not know is shown to the splitter.
    """
    splitter = tokenizers.Tokenizer.from_file(path).pre_tokenizer
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    classes = []
    for name, first in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", None)):
        mine = regex.compile(name)
        members = [c for c in every if mine.match(chr(c))]
        classes.append(_ranges([c for c in members if first is None or unicodedata.category(chr(c)) != "Cn" or len(splitter.pre_tokenize_str(first + chr(c))) == 1]))
    return tuple(classes)


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes() if len(ids) > SHORT else struct.pack("<%dI" % len(ids), *ids)


class _Stretches(dict):
    """Packed ids of a stretch, white space and what follows it up to the next white space; no word goes beyond one.

    Two generations of at most CACHE stretches: what is asked for again moves to the younger one, the older one is forgotten when
    the younger is full.
    """

    def __init__(self, merges: Merges, split: re.Pattern):
        self.merges, self.split, self.older = merges, split, {}

    def word(self, word: str) -> bytes:
        return _packed(self.merges.merge(word.encode("utf-8", "surrogatepass")))

    def __missing__(self, stretch: str) -> bytes:
        packed = self.older.get(stretch)
        if packed is None:
            if stretch[0] == " " and stretch[1:].isalpha():  # the common case, one word
                packed = self.word(stretch)
            else:
                packed = b"".join(map(self.word, self.split.findall(stretch)))
        if len(stretch) <= SHORT:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[stretch] = packed
        return packed


@functools.lru_cache(maxsize=4)
def _tables(path: str, classes: tuple[str, str, str]):
    merges, (letter, number, blank) = load_merges(path), classes
    runs = [f"[{blank}]+", f"[{letter}]+", f"[{number}]+", f"[^{blank}{letter}{number}]+"]
    split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{runs[1]}| ?{runs[2]}| ?{runs[3]}|{runs[0]}(?![^{blank}])|{runs[0]}")
    runs = [re.compile(r) for r in runs]
    mark = re.compile("|".join(map(re.escape, merges.special))) if merges.special else None
    return merges, split, runs, mark, re.compile(f"[{blank}]*[^{blank}]+|[{blank}]+"), _Stretches(merges, split)


class Encoder:
    """Ids of a text that comes in pieces: ``feed`` returns what has become stable, ``finish`` the rest; packed unsigned 32 bit.

    What is kept between pieces: an unfinished word of at most LONG characters or, in a longer one, its kind and a window of
    bytes; and a tail that may open a special string.
    """

    def __init__(self, path: str, classes: tuple[str, str, str]):
        self.merges, self.split, self.runs, self.mark, self.stretch, self.ids = _tables(path, classes)
        self.held = max(map(len, self.merges.special), default=1) - 1
        self.tail, self.open, self.run, self.window = "", "", None, b""

    def feed(self, piece: str, last: bool = False) -> bytes:
        text, at, out = self.tail + piece, 0, []
        for found in self.mark.finditer(text) if self.mark else ():
            out.append(self._words(text[at: found.start()], True))
            out.append(struct.pack("<I", self.merges.special[found[0]]))
            at = found.end()
        keep = len(text) if last else max(at, len(text) - self.held)
        self.tail = text[keep:]
        out.append(self._words(text[at: keep], last))
        return b"".join(out)

    def finish(self) -> bytes:
        return self.feed("", True)

    def _words(self, piece: str, last: bool) -> bytes:
        """Ids of the stretches that end in this piece; of a long one, of the words that are decided, three characters behind their end."""
        out = b""
        if self.run is not None:
            out, piece = self._continue(piece, last)
            if self.run is not None:
                return out
        text = self.open + piece
        if last:
            self.open = ""
            return out + b"".join(map(self.ids.__getitem__, self.stretch.findall(text)))
        parts = self.stretch.findall(text)
        stable = len(text) - len(parts.pop()) if parts else 0
        out += b"".join(map(self.ids.__getitem__, parts))
        self.open = text[stable:]
        if len(self.open) <= LONG:
            return out
        words, size = self.split.findall(self.open), len(self.open)
        stable = size
        while words and stable > size - 3:
            stable -= len(words.pop())
        rest, self.open = self.open[stable:], self.open[stable:]
        out += b"".join(map(self.ids.word, words))
        if len(rest) <= LONG:
            return out
        self.run, self.open = next(r for r in self.runs if r.match(rest[LONG // 2])), ""
        return out + self._start(rest)

    def _start(self, rest: str) -> bytes:
        lead = " " if rest[0] == " " and not self.run.match(" ") else ""
        self.window = lead.encode()
        out, piece = self._continue(rest[len(lead):], False)
        return out if self.run is not None else out + self._words(piece, False)

    def _continue(self, piece: str, last: bool) -> tuple[bytes, str]:
        """Pass more of a long word through the window; the word is over where its kind of character is.

        Of white space the last character belongs to what follows, if anything does.
        """
        blank = self.run is self.runs[0]
        text, self.open = self.open + piece, ""
        found = self.run.match(text)
        end = found.end() if found else 0
        over = end < len(text) or last
        if blank and end and not (last and end == len(text)):
            end -= 1
        if not over:
            self.open = text[end:]
            return self._push(text[:end], False), ""
        self.run = None
        return self._push(text[:end], True), text[end:]

    def _push(self, text: str, last: bool) -> bytes:
        out, data, look = [], self.window + text.encode("utf-8", "surrogatepass"), self.merges.lookahead
        at = 0
        while at < len(data):
            part = data[at: at + look + BLOCK]
            closing = at + len(part) == len(data)
            if closing and not last:
                break
            sure = len(part) if closing else len(part) - look
            ids, done = [], 0
            for i in self.merges.merge(part):
                if done + len(self.merges.token[i]) > sure:
                    break
                done += len(self.merges.token[i])
                ids.append(i)
            out.append(struct.pack(f"<{len(ids)}I", *ids))
            at += done
        self.window = b"" if last else data[at:]
        return b"".join(out)


class Decoder:
    """Text of ids that come in pieces; bytes of a character that is not complete yet wait for the next piece.

    Bytes that are no UTF-8 give a replacement character, ids outside of the vocabulary give nothing.
    """

    def __init__(self, path: str):
        self.token = load_merges(path).token
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes, last: bool = False) -> str:
        ids = array("I", packed)
        get = self.token.get
        return self.state.decode(b"".join([get(i, b"") for i in ids]), last)


def _pieces(whole, size: int) -> Iterator:
    return (whole[k: k + size] for k in range(0, len(whole), size))


def encode_documents(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The rows with ``ids_col`` (packed little-endian unsigned 32-bit ids) instead of the text; one narrow pass.

    A null or empty text has no ids.  Rows may repeat, ids of documents play no part, and a text or word may have any
    length.  A column of the name ``ids_col`` is replaced.
    """
    classes = word_classes(tokenizer_path)

    def run(texts):
        out = []
        for text in texts:
            encoder = Encoder(tokenizer_path, classes)
            out.append(encoder.feed(text, True) if len(text) <= CHUNK else b"".join([*map(encoder.feed, _pieces(text, CHUNK)), encoder.finish()]))
        return [pa.array(out, pa.binary())]

    return map_text(docs.drop(ids_col) if ids_col != text_col else docs, text_col, f"`{ids_col}` binary", run)


def decode_documents(tokens: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The rows with ``text_col`` instead of the ids, special tokens included; null or no ids give an empty text."""
    def run(rows):
        out = []
        for packed in rows:
            decoder = Decoder(tokenizer_path)
            out.append("".join([decoder.feed(p) for p in _pieces(packed or b"", 4 * CHUNK)]) + decoder.feed(b"", True))
        return [pa.array(out, pa.string())]

    return map_text(tokens.drop(text_col) if ids_col != text_col else tokens, ids_col, f"`{text_col}` string", run)

"""Benchmark contamination as a prefix-filtered set join.

An item window is a run of ``width`` item words (a shorter item is one window).  Its word shingles are ordered by how
rare they are in the corpus.  A document that holds the window holds all its shingles, so joining on the rarest one, the
necessary prefix for full containment, loses nothing.  The shingle's place in the window bounds where the window can
start; length and position exclude starts outside of the document, and the remaining ones are verified word by word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidemill.llm.common import map_text, materialize

SHINGLE = 3
# A-Z lower-cased; ASCII other than letters and digits separates; bytes of other characters stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Windows:
    """Distinct item windows as word numbers; ``vocabulary`` numbers the words of all of them."""

    vocabulary: dict[bytes, int]
    words: list[np.ndarray]
    items: list[list[str]]
    keys: np.ndarray  # sorted shingle codes that occur in any window
    of_window: list[np.ndarray]  # index into keys of each window's shingles, in order

    @staticmethod
    def build(items: list[tuple[str, str]], width: int) -> Windows:
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
            for at in range(max(1, len(ids) - width + 1) if ids else 0):
                found.setdefault(tuple(ids[at: at + width]), set()).update([] if item is None else [item])
        words = [np.array(w, np.int64) for w in found]
        codes = [shingle_codes(w, len(vocabulary), min(SHINGLE, len(w))) for w in words]
        keys = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        return Windows(vocabulary, words, [sorted(i) for i in found.values()], keys, [np.searchsorted(keys, c) for c in codes])


def shingle_codes(ids: np.ndarray, base: int, n: int) -> np.ndarray:
    """Codes of all runs of ``n`` words, different for different n; -1 where a word is not in the vocabulary (-1)."""
    size = max(0, len(ids) - n + 1)
    code, bad = np.zeros(size, np.int64), np.zeros(size, bool)
    for k in range(n):
        part = ids[k: k + size]
        code = code * (base + 1) + part + 1
        bad |= part < 0
    return np.where(bad, -1, code * SHINGLE + n - 1)


def _lookup(keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose code is a key, and the key's index."""
    some = np.flatnonzero(codes >= 0)
    if not len(some) or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, codes[some]), len(keys) - 1)
    hit = keys[at] == codes[some]
    return some[hit], at[hit]


def _numbers(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    get = vocabulary.get
    return np.array([get(w, -1) for w in words], np.int64)


def shingle_counts(docs: DataFrame, windows: Windows) -> np.ndarray:
    """How often each window shingle occurs in all documents; partitions add up, Spark sums."""
    lengths = sorted({min(SHINGLE, len(w)) for w in windows.words})

    def run(batches):
        total = np.zeros(len(windows.keys), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = _numbers(words_of(text), windows.vocabulary)
                for n in lengths:
                    np.add.at(total, _lookup(windows.keys, shingle_codes(ids, len(windows.vocabulary), n))[1], 1)
        some = np.flatnonzero(total)
        for at in range(0, len(some), 100_000):
            part = some[at: at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["at", "n"])

    counts = np.zeros(len(windows.keys), np.int64)
    for r in docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    return counts


@dataclass
class Prefixes:
    """For each key that is the rarest shingle of some window: the windows and the shingle's place in them."""

    keys: np.ndarray
    places: list[list[tuple[int, int]]]

    @staticmethod
    def choose(windows: Windows, counts: np.ndarray) -> Prefixes:
        chosen: dict[int, list[tuple[int, int]]] = {}
        for w, shingles in enumerate(windows.of_window):
            best = int(np.lexsort((shingles, counts[shingles]))[0])
            chosen.setdefault(int(shingles[best]), []).append((w, best))
        order = sorted(chosen)
        return Prefixes(windows.keys[order] if order else np.zeros(0, np.int64), [chosen[k] for k in order])


def find_hits(words: list[bytes], windows: Windows, prefixes: Prefixes, lengths: list[int]) -> tuple[np.ndarray, list[str]]:
    """Covered words as a boolean array, and the items with an occurring window."""
    ids = _numbers(words, windows.vocabulary)
    edge = np.zeros(len(ids) + 1, np.int64)
    items: set[str] = set()
    for n in lengths:
        at, key = _lookup(prefixes.keys, shingle_codes(ids, len(windows.vocabulary), n))
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]) if len(key) else []
        for s, e in zip(edges[:-1], edges[1:]):
            for w, place in prefixes.places[key[s]]:
                need = windows.words[w]
                start = at[s:e] - place
                start = start[(start >= 0) & (start + len(need) <= len(ids))]
                for k, word in enumerate(need):
                    if not len(start):
                        break
                    start = start[ids[start + k] == word]
                if len(start):
                    items.update(windows.items[w])
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + len(need), -1)
    return np.cumsum(edge)[:-1] > 0, sorted(items)


def _chunks(items: DataFrame, id_col: str, text_col: str, chunk_chars: int) -> list[DataFrame]:
    """Item frames of about ``chunk_chars`` characters each, by a hash of the item."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // chunk_chars) or 1
    return [rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) for k in range(parts)]


def _tables(texts: DataFrame, chunk: DataFrame, width: int):
    """Broadcast of one chunk's windows, prefixes and shingle lengths."""
    windows = Windows.build([(r["item"], r["text"]) for r in chunk.toLocalIterator()], width)
    prefixes = Prefixes.choose(windows, shingle_counts(texts, windows))
    lengths = sorted({min(SHINGLE, len(w)) for w in windows.words})
    return texts.sparkSession.sparkContext.broadcast((windows, prefixes, lengths))


def _search(rows: DataFrame, shared) -> DataFrame:
    """Replace ``text`` by n_words, covered (bits, null if none) and items."""
    def run(texts):
        sizes, covered, items = [], [], []
        for text in texts:
            words = words_of(text)
            mask, found = find_hits(words, *shared.value)
            sizes.append(len(words))
            covered.append(np.packbits(mask).tobytes() if mask.any() else None)
            items.append(found)
        return [pa.array(sizes, pa.int64()), pa.array(covered, pa.binary()), pa.array(items, pa.list_(pa.string()))]

    return map_text(rows, "text", "n_words long, covered binary, items array<string>", run)


def _bits(covered: pd.Series) -> pd.Series:
    """Words covered by any of several bit strings of one document."""
    return covered.map(lambda masks: sum(map(int.bit_count, np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in masks]).tolist())) if masks is not None and len(masks) else 0)


def mark_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                       width: int = 13, chunk_chars: int = 4_000_000) -> DataFrame:
    """(id, n_words, n_hit, items): hit words and the item ids found, as sorted strings; one row per input row.

    A null or empty text has no words and no hits; an item without words has no windows.  Words that only an item with a null id covers
    are hit, but such an item is not listed.
    The windows are broadcast: ``chunk_chars`` characters of items bound one broadcast.  More items take more chunks, one
    after the other with passes of their own, and what they found is joined by document without moving texts.
    """
    count = F.pandas_udf(_bits, "long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chunks = _chunks(items, item_col, item_text_col, chunk_chars)
    if len(chunks) == 1:
        return _search(rows, _tables(rows.select("text"), chunks[0], width)).select(
            "id", "n_words", count(F.array_compact(F.array("covered"))).alias("n_hit"), "items")
    rows = rows.withColumn("key", _row_key("id", "text"))
    hits = None
    for chunk in chunks:
        shared = _tables(rows.select("text"), chunk, width)
        found = materialize(_search(rows, shared), "contamination")
        shared.destroy()
        sizes = found.select("id", "key", "n_words")
        part = found.where("covered IS NOT NULL").select("key", "covered", "items").distinct()
        hits = part if hits is None else hits.unionByName(part)
    both = hits.groupBy("key").agg(F.collect_list("covered").alias("covered"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return sizes.join(both, "key", "left").select("id", "n_words", count("covered").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _row_key(id_col: str, text_col: str):
    """Equal for rows with equal id and text, nulls included."""
    return F.sha2(F.to_json(F.struct(F.col(id_col).alias("i"), F.col(text_col).alias("t"))), 256)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                      width: int = 13, chunk_chars: int = 4_000_000) -> DataFrame:
    """The documents, with all their columns, of which less than a twentieth of the words is hit."""
    chunks = _chunks(items, item_col, item_text_col, chunk_chars)
    if len(chunks) > 1:
        keyed = docs.select(_row_key(id_col, text_col).alias("__key"), F.col(text_col).alias("text"))
        marked = mark_contamination(keyed, items, "__key", "text", item_col, item_text_col, width, chunk_chars)
        gone = marked.where(is_contaminated(F.col("n_words"), F.col("n_hit"))).select(F.col("id").alias("__key")).distinct()
        return docs.withColumn("__key", _row_key(id_col, text_col)).join(gone, "__key", "left_anti").select(*docs.columns)
    shared = _tables(docs.select(F.col(text_col).alias("text")), chunks[0], width)

    def run(batches):
        for batch in batches:
            keep = []
            for text in batch.column(text_col).to_pylist():
                words = words_of(text)
                keep.append(not is_contaminated(len(words), int(find_hits(words, *shared.value)[0].sum())))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def is_contaminated(n_words, n_hit):
    """A twentieth of the words or more are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digest_columns(marked: DataFrame, id_name: str = "doc_id") -> DataFrame:
    return marked.select(
        F.col("id").alias(id_name), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))

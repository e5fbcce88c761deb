"""Order-preserving packing of documents into fixed token windows by dynamic programming.

Documents follow each other in their order of reading as one token stream per block.  Cuts may be made behind a
document or sentence for free, and elsewhere at a penalty for the truncation.  A window of L tokens is padded to
``window`` unless L is a power of two.  With best(p) the least cost of the stream up to cut p,
best(q) = min over p of best(p) + penalty(q) + padding(q - p), and a price for one more window.  Padding is linear in p, so the minimum of
best(p) + p over the last ``window`` tokens comes from a monotone queue; powers of two are eleven more choices.
"""

from __future__ import annotations

import base64
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_ID = 0
GRID = 128  # mid-sentence cuts are offered at these steps, so that a chain of full windows is always possible
BLOCK_TOKENS = 2_000_000  # of one optimisation; bounds a task's memory
READ_ROWS = 256  # rows of a batch that are Python strings at a time


def vocabulary_facts(tokenizer_path: str) -> tuple[list[str], int]:
    """Special tokens and size of the vocabulary."""
    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_path)
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()], tokenizer.get_vocab_size()


class Tokens:
    """Ids of the vocabulary file.

    The same vocabulary in rank form is about four times faster and gives the same ids for text without special
    tokens; texts that hold one go through the tokenizer itself, which a task loads only then.  ``facts`` are those of
    :func:`vocabulary_facts`, read once in the driver.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str, facts: tuple[list[str], int] | None = None):
        self.path, self.slow = tokenizer_path, None
        self.special, size = facts or vocabulary_facts(tokenizer_path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        ends = np.zeros(size, bool)
        for token, i in ranks.items():
            ends[i] = token.rstrip(b" \"')]")[-1:] in (b".", b"!", b"?") or b"\n" in token
        self.ends_sentence = ends

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            if self.slow is None:
                self.slow = tokenizers.Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def choose_cuts(points: np.ndarray, penalty: np.ndarray, window: int, opening: float = 0.0) -> np.ndarray:
    """Positions of the best cuts; ``points`` ascend from 0 to the length, no two more than ``window`` apart.

    ``opening`` is the price of one more window, without which powers of two would be cut into crumbs.
    """
    where, fee = points.tolist(), penalty.tolist()
    exact: list[list[int]] = [[] for _ in where]
    size = 1
    while size <= window:
        at = np.searchsorted(points, points - size)
        for j in np.flatnonzero((points >= size) & (points[np.minimum(at, len(points) - 1)] == points - size)).tolist():
            exact[j].append(int(at[j]))
        size *= 2
    best, came = [0.0] * len(where), [0] * len(where)
    queue: deque[int] = deque([0])
    for j in range(1, len(where)):
        q = where[j]
        while where[queue[0]] < q - window:
            queue.popleft()
        i = queue[0]
        cost = best[i] + window - (q - where[i])
        for k in exact[j]:
            if best[k] < cost:
                cost, i = best[k], k
        best[j], came[j] = cost + fee[j] + opening, i
        value = best[j] + q
        while queue and best[queue[-1]] + where[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(where) - 1
    while j > 0:
        cuts.append(where[j])
        j = came[j]
    return np.array(cuts[::-1], np.int64)


def pack_block(lengths: np.ndarray, sentence_ends: np.ndarray, window: int, truncation: float, sentence: float = 0.5, opening: float = 64.0) -> np.ndarray:
    """Cuts of one stream of documents; ``sentence_ends`` are offsets behind a sentence."""
    total = int(lengths.sum())
    documents = np.cumsum(lengths)
    grid = np.arange(0, total + 1, min(GRID, window))
    rest, tail = total % window, []
    for bit in range(window.bit_length()):  # the rest as powers of two, largest first
        size = 1 << (window.bit_length() - 1 - bit)
        if rest & size:
            tail.append((tail[-1] if tail else total - rest) + size)
    points = np.unique(np.concatenate([[0, total], documents, sentence_ends, grid, np.array(tail, np.int64)]))
    penalty = np.where(np.isin(points, documents), 0.0, np.where(np.isin(points, sentence_ends), sentence, truncation))
    return choose_cuts(points, penalty, window, opening)


def pack_documents(docs: DataFrame, tokenizer_path: str, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                   window: int = 1024, truncation: float = 8.0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: id, start, length, ids (packed little-endian unsigned 32 bit), doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone; repeated rows and null ids are packed as any other row.  The work is
    narrow: a block is a stretch of one input partition, so texts never move, and a very long document may span any number
    of windows and is a block of its own at most.  ``sequence_id`` numbers sequences within the input partition.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    facts = vocabulary_facts(tokenizer_path)

    def run(batches):
        tokens = Tokens(tokenizer_path, ranks_path, pattern, facts)
        held: list[tuple] = []
        size, serial = 0, 0

        def flush(part: int):
            nonlocal held, size, serial
            lengths = np.array([len(ids) for _, ids in held], np.int64)
            stream = np.concatenate([ids for _, ids in held])
            starts = np.cumsum(lengths) - lengths
            ends = np.flatnonzero(tokens.ends_sentence[np.minimum(stream, len(tokens.ends_sentence) - 1)]) + 1
            cuts = pack_block(lengths, ends, window, truncation)
            opens = np.concatenate([[0], cuts[:-1]])
            begin = np.union1d(starts, opens)  # pieces start at documents and at windows
            end = np.concatenate([begin[1:], [len(stream)]])
            doc = np.searchsorted(starts, begin, "right") - 1
            seq = np.searchsorted(opens, begin, "right") - 1
            raw = stream.astype("<u4").tobytes()
            rows = pd.DataFrame({
                "id": pd.Series([held[d][0] for d in doc], dtype=object), "start": begin - starts[doc], "length": end - begin,
                "ids": [raw[4 * a: 4 * b] for a, b in zip(begin.tolist(), end.tolist())], "doc_tokens": lengths[doc],
                "sequence_id": (part << 36) + serial + seq, "offset": begin - opens[seq]})
            serial += len(opens)
            held, size = [], 0
            return rows

        part = 0
        for batch in (b.slice(at, READ_ROWS) for b in batches for at in range(0, b.num_rows, READ_ROWS)):
            ids, texts, parts = (batch.column(i).to_pylist() for i in range(3))
            for i, text, part in zip(ids, texts, parts):
                own = np.append(tokens.encode(text or ""), np.uint32(END_ID))
                held.append((i, own))
                size += len(own)
                if size >= block_tokens:
                    yield flush(part)
        if held:
            yield flush(part)

    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def arrow(batches):
        id_kind = None

        def watched():
            nonlocal id_kind
            for b in batches:
                id_kind = b.schema.field(0).type
                yield b

        for rows in run(watched()):
            for at in range(0, len(rows), 20_000):
                part = rows.iloc[at: at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part["id"].tolist(), id_kind)] + [pa.array(part[n].tolist(), k) for n, k in zip(names[1:], kinds)], names=names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part")).mapInArrow(
        arrow, f"id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")

"""Exact removal of repeated word windows behind a count-min prefilter.

First pass: every task sketches the windows of its documents; the sketches are merged shard by shard into bitmaps of
cells counted twice or more.  A count-min cell never undercounts, so a window that occurs in two documents has two
or more in each of its cells.  Second pass: only windows estimated repeated are grouped exactly, by 96 bits of
hash, for the smallest document they start in.  They travel as compressed columns, one row per task and range of hashes.  A
task decides on its own about all but the smallest of its documents with a window, so even the most frequent window
is sent once per task.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_BITS = 22
FLUSH = 1_000_000  # windows that a task holds before it sends them
BUCKET = 1_000_000  # windows per range of hashes, at most on average
_rng = np.random.default_rng(20)  # two odd 64-bit multipliers of the rolling hashes
FACTORS = [int(x) | 1 for x in _rng.integers(1, 1 << 63, 2)]


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def window_hashes(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two rolling hashes (64 and 32 bits) of every window of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    digest = xxhash.xxh3_64_intdigest
    base = np.fromiter(map(digest, words), np.uint64, len(words))
    first, second = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    other = (base ^ (base >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    a, b = 1, 1
    for k in range(width):
        first += base[k: k + n] * np.uint64(a)
        second += other[k: k + n] * np.uint64(b)
        a, b = a * FACTORS[0] % (1 << 64), b * FACTORS[1] % (1 << 64)
    first ^= first >> np.uint64(32)
    first *= np.uint64(0x9E3779B97F4A7C15)
    return first, (second >> np.uint64(32)).astype(np.uint32)


def _cells(first: np.ndarray, second: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cell of each window in a row of the sketch."""
    mixed = (first + second.astype(np.uint64) * np.uint64(0x94D049BB133111EB)) * np.uint64(FACTORS[row] ^ 0x2545F4914F6CDD1C)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _squeeze(values: np.ndarray) -> bytes:
    """Bytes of equal rank next to each other, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def _expand(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack(cells: np.ndarray) -> bytes:
    """Ascending cells as compressed gaps."""
    return _squeeze(np.diff(cells, prepend=0).astype("<u4"))


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_expand(data, "<u4").astype(np.int64))


def repeated_cells(docs: DataFrame, text_col: str, width: int, rows: int, bits: int) -> tuple[list[bytes], int]:
    """Per sketch row the packed bitmap (zstd) of cells that count two or more windows; and the number of windows.

    A window that repeats within one document counts once.  Tasks send compressed cell lists per shard; each shard is merged
    as a stream with a fixed state.  The result has rows x 2^bits bits at most, however large the input.
    """
    shard_bits = min(SHARD_BITS, bits)

    def sketch(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            first = np.concatenate([a for a, _ in held])
            second = np.concatenate([b for _, b in held])
            out = []
            for row in range(rows):
                cells, counts = np.unique(_cells(first, second, row, bits), return_counts=True)
                shard = cells >> shard_bits
                edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(cells)]])
                for s, e in zip(edges[:-1], edges[1:]):
                    if e > s:
                        inside = cells[s:e] & ((1 << shard_bits) - 1)
                        out.append((row, int(shard[s]), int(counts[s:e].sum()), _pack(inside), _pack(inside[counts[s:e] > 1]) if (counts[s:e] > 1).any() else None))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=["row", "shard", "n", "once", "more"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                first, second = window_hashes(words_of(text or ""), width)
                if len(first):
                    first, at = np.unique(first, return_index=True)
                    held.append((first, second[at]))
                    size += len(first)
                    if size >= FLUSH:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    def merge(batches):
        key, seen, twice, total = None, None, None, 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total], pa.int64()), pa.array([zstandard.compress(np.packbits(twice, bitorder="little").tobytes(), 3)], pa.binary())], names=["row", "shard", "n", "bitmap"])

        for batch in batches:
            for row, shard, n, once, more in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (row, shard) != key:
                    if key is not None:
                        yield done()
                    key, seen, twice = (row, shard), np.zeros(1 << shard_bits, bool), np.zeros(1 << shard_bits, bool)
                    total = 0
                total += n
                cells = _unpack(once)
                twice[cells[seen[cells]]] = True
                seen[cells] = True
                if more is not None:
                    twice[_unpack(more)] = True
        if key is not None:
            yield done()

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(sketch, "row int, shard int, n long, once binary, more binary")
    merged = parts.repartition("row", "shard").sortWithinPartitions("row", "shard").mapInArrow(merge, "row int, shard int, n long, bitmap binary").collect()
    maps = [np.zeros((1 << bits) // 8 or 1, np.uint8) for _ in range(rows)]
    for m in merged:
        data = np.frombuffer(zstandard.decompress(m["bitmap"]), np.uint8)
        at = m["shard"] << max(0, shard_bits - 3)
        maps[m["row"]][at: at + len(data)] = data
    return [zstandard.compress(m.tobytes(), 1) for m in maps], sum(m["n"] for m in merged if m["row"] == 0)


def _opens(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where a new window begins in sorted hashes."""
    return np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]) if len(first) else np.zeros(0, bool)


def _later(first: np.ndarray, second: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted windows, where each begins, and which documents are not the smallest with their window."""
    order = np.lexsort((ids, second, first))
    first, second, ids = first[order], second[order], ids[order]
    opens = _opens(first, second)
    return first, second, ids, opens, ids > ids[opens][np.cumsum(opens) - 1] if len(ids) else opens


def _send(maps, width: int, bits: int, buckets: int):
    """Candidate windows of a task: per range of hashes those still open, and documents already decided."""
    def run(batches):
        bitmaps = [np.frombuffer(zstandard.decompress(m), np.uint8) for m in maps.value]
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush():
            first, second, ids, opens, decided = _later(*(np.concatenate(v) for v in zip(*held)))
            gone_i, gone_h = ids[decided], first[decided]
            first, second, ids = first[opens], second[opens], ids[opens]
            bucket = ((first >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # ascends with the hash
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            cut = np.linspace(0, len(gone_i), buckets + 1).astype(np.int64)  # any bucket will do for these
            out = []
            for k in range(buckets):
                s, e, x, y = ends[k], ends[k + 1], cut[k], cut[k + 1]
                if e > s or y > x:
                    out.append((k, _squeeze(np.diff(first[s:e], prepend=np.uint64(0))), _squeeze(second[s:e]), _squeeze(ids[s:e]), _squeeze(gone_i[x:y]), _squeeze(gone_h[x:y])))
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if n == 0 else pa.binary()) for n, v in enumerate(zip(*out))], names=["bucket", "h", "g", "id", "gone_id", "gone_h"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first, second = window_hashes(words_of(text or ""), width)
                first, at = np.unique(first, return_index=True)
                second = second[at]
                for row, bitmap in enumerate(bitmaps):
                    cells = _cells(first, second, row, bits)
                    hit = (bitmap[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1
                    first, second = first[hit], second[hit]
                if len(first):
                    held.append((first, second, np.full(len(first), i, np.int64)))
                    size += len(first)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _decide(batches):
    """Per range of hashes: documents and windows of theirs that a smaller document has, too."""
    def done(parts):
        first = np.concatenate([np.cumsum(_expand(p[0], "<u8"), dtype=np.uint64) for p in parts])
        second, ids, gone_i, gone_h = (np.concatenate([_expand(p[k], kind) for p in parts]) for k, kind in ((1, "<u4"), (2, "<i8"), (3, "<i8"), (4, "<u8")))
        first, second, ids, _, later = _later(first, second, ids)
        ids, first = np.concatenate([ids[later], gone_i]), np.concatenate([first[later], gone_h])
        order = np.argsort(ids, kind="stable")
        for at in range(0, len(order), 200_000):
            part = order[at: at + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(first[part].view(np.int64))], names=["id", "h"])

    at, parts = None, []
    for batch in batches:
        for bucket, *columns in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if bucket != at and parts:
                yield from done(parts)
                parts = []
            at = bucket
            parts.append(columns)
    if parts:
        yield from done(parts)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, rows: int = 2, bits: int = 29) -> DataFrame:
    """(id, n_words, n_removed, kept): ``kept`` is the text of the kept words, one space between them.

    Ids are integers.  A word goes if a window of ``width`` words covers it whose words also start in a document with a smaller id;
    windows are judged on the input.  Null texts have no words.  Rows with one id are one document for this purpose
    and each loses the same windows; rows with a null id neither remove nor lose words.
    ``rows`` x 2^``bits`` bits of sketch are broadcast (128 MB at most by default); a fuller sketch only lets more
    windows through to the exact grouping.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = base.where("id IS NOT NULL")
    packed, total = repeated_cells(known, "text", width, rows, bits)
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    sent = known.mapInArrow(_send(spark.sparkContext.broadcast(packed), width, bits, buckets), "bucket int, h binary, g binary, id binary, gone_id binary, gone_h binary")
    later = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_decide, "id long, h long")
    lists = later.groupBy("id").agg(F.collect_list("h").alias("gone"))
    joined = base.join(lists, "id", "left").select("id", "text", "gone")

    def strip(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            gone = batch.column(2)
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text or "")
                removed = 0
                if gone[i].is_valid and len(words) >= width:
                    first, _ = window_hashes(words, width)
                    hit = np.isin(first, gone[i].values.to_numpy().view(np.uint64))  # a window may repeat within the document
                    edge = np.zeros(len(words) + 1, np.int64)
                    edge[: len(hit)] += hit
                    edge[width: width + len(hit)] -= hit
                    covered = np.cumsum(edge)[:-1] > 0
                    removed = int(covered.sum())
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
                n_words.append(len(words) + removed)
                n_removed.append(removed)
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(strip, "id long, n_words long, n_removed long, kept string")


def kept_digest(rows: DataFrame, id_name: str = "doc_id") -> DataFrame:
    return rows.select(F.col("id").alias(id_name), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

"""Structure-aware chunking.

A document is one row; its sections and chunks are arrays inside the row and are exploded last, so
chunking adds no shuffle.  The splitter folds over fixed-size blocks of the text and carries only the
undecided tail, so its cost grows linearly with the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv
from guidemill.functions.matching import BLANKS, empty_array, explode_rows, let, rx, scan, strip

BLOCK_CHARS = 32768


@dataclass(frozen=True)
class ChunkSizes:
    """Sizes in characters."""

    target: int = 1200
    maximum: int = 2000
    overlap: int = 100
    min_content: int = 50
    heading_in_chunk: bool = True


def _cut_point(candidate: Column, size: int) -> Column:
    """Characters to cut from a full candidate window."""
    para = F.regexp_extract(candidate, rx(r"^(.*" + fv.PARAGRAPH_BREAK + ")", "s"), 1)
    sentence = F.regexp_extract(candidate, rx(r"^(.*[.!?]\s+)[A-Z]", "s"), 1)
    from_end = F.locate(" ", F.reverse(candidate))
    last_blank = F.when(from_end > 0, F.length(candidate) - from_end).otherwise(-1)
    return (
        F.when(candidate.contains("\n\n"), F.length(para))
        .when(F.length(sentence) > 0, F.length(sentence))
        .when(last_blank > size // 2, last_blank)
        .otherwise(size)
    )


def split_text(text: Column, size: int) -> Column:
    """Pieces of at most ``size`` characters cut at paragraph, else sentence, else blank.

    Text that already fits is returned unchanged.
    """
    piece_state = "struct<rem:string,cut:boolean,out:array<string>>"

    def cut_once(acc: Column, _: Column) -> Column:
        candidate = F.substring(acc["rem"], 1, size)

        def apply(cut: Column) -> Column:
            rest = F.substring(acc["rem"], cut + 1, F.length(acc["rem"]))
            return F.struct(
                F.ltrim(rest, F.lit(BLANKS)).alias("rem"),
                F.lit(True).alias("cut"),
                F.concat(acc["out"], F.array(strip(F.substring(candidate, F.lit(1), cut)))).alias("out"),
            )

        return F.when(F.length(acc["rem"]) > size, let(_cut_point(candidate, size), apply)).otherwise(acc)

    def add_block(acc: Column, block: Column) -> Column:
        joined = F.concat(acc["rem"], block)
        started = F.struct(
            F.when(acc["cut"], F.ltrim(joined, F.lit(BLANKS))).otherwise(joined).alias("rem"),
            acc["cut"].alias("cut"), empty_array("string").alias("out"))
        # Three cuts in a row always pass half a window, so this many rounds empty the buffer.
        rounds = F.sequence(F.lit(1), (F.length(joined) / size).cast("int") * 6 + 6)
        return let(
            F.aggregate(rounds, started.cast(piece_state), cut_once),
            lambda r: F.struct(
                r["rem"].alias("rem"), r["cut"].alias("cut"),
                F.concat(acc["out"], F.array(r["out"])).alias("out")),
        )

    def fold(body: Column) -> Column:
        blocks = F.regexp_extract_all(body, F.lit("(?s).{1," + str(BLOCK_CHARS) + "}"), F.lit(0))
        return F.aggregate(
            blocks,
            F.struct(
                F.lit("").alias("rem"), F.lit(False).alias("cut"),
                empty_array("array<string>").alias("out")),
            add_block,
            lambda acc: F.concat(F.flatten(acc["out"]), F.array(acc["rem"])),
        )

    def by_length(body: Column) -> Column:
        # Only trailing blanks exceed the window: one cut, and the stripped rest fits.
        once = let(_cut_point(F.substring(text, 1, size), size), lambda cut: F.array(
            strip(F.substring(text, F.lit(1), cut)), strip(F.substring(text, cut + 1, F.length(text)))))
        pieces = F.when(F.length(body) > size, fold(body)).otherwise(once)
        return F.filter(pieces, lambda p: p != "")

    return F.when(F.length(text) <= size, F.array(text)).otherwise(let(F.rtrim(text, F.lit(BLANKS)), by_length))


def overlap_text(previous: Column, size: int) -> Column:
    """Last whole sentences of the previous piece that fit ``size``, else its word-aligned tail."""
    tail = F.right(previous, F.lit(2 * size))
    sentences = F.reverse(F.split(tail, rx(fv.SENTENCE_BREAK, "")))
    taken = F.aggregate(
        sentences,
        F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), empty_array("string").alias("out")),
        lambda a, s: F.when(
            ~a["full"] & (a["n"] + F.length(s) <= size),
            F.struct((a["n"] + F.length(s)).alias("n"), F.lit(False).alias("full"),
                     F.concat(F.array(s), a["out"]).alias("out")),
        ).otherwise(F.struct(a["n"].alias("n"), F.lit(True).alias("full"), a["out"].alias("out"))),
        lambda a: a["out"],
    )
    end = F.right(previous, F.lit(size))
    blank = F.locate(" ", end)
    aligned = strip(F.when(blank > 1, F.substring(end, blank, F.lit(size))).otherwise(end))
    return let(taken, lambda t: F.when(F.size(t) > 0, strip(F.array_join(t, " "))).otherwise(aligned))


def with_heading(section: Column) -> Column:
    return F.when(
        F.length(section["heading"]) > 0,
        F.concat(F.lit("## "), section["heading"], F.lit("\n\n"), section["content"]),
    ).otherwise(section["content"])


def with_offsets(pieces: Column) -> Column:
    """(i, piece, char_start, char_end): running sum of piece lengths."""
    def rows(ends: Column) -> Column:
        return F.transform(pieces, lambda p, i: F.struct(
            i.alias("i"), p.alias("piece"), (F.get(ends, i) - F.length(p)).alias("char_start"), F.get(ends, i).alias("char_end")))

    return let(scan(F.transform(pieces, lambda p: F.length(p)), F.lit(0), lambda s, n: s + n, "int"), rows)


def chunk_section(section: Column, sizes: ChunkSizes) -> Column:
    """Array of chunks of one section struct(heading, level, content, heading_path)."""
    full = with_heading(section) if sizes.heading_in_chunk else section["content"]

    def build(text: Column) -> Column:
        pieces = F.when(F.length(text) <= sizes.maximum, F.array(text)).otherwise(split_text(text, sizes.target))

        def rows(ps: Column) -> Column:
            def one(x: Column) -> Column:
                follows = x["i"] > 0
                over = F.when(follows & F.lit(sizes.overlap > 0), overlap_text(F.get(ps, x["i"] - 1), sizes.overlap)) \
                    .otherwise(F.lit(""))
                return let(over, lambda o: F.struct(
                    F.when((o != "") & ~x["piece"].startswith(o), F.concat(F.lit("[...] "), x["piece"]))
                    .otherwise(x["piece"]).alias("content"),
                    x["char_start"].alias("char_start"), x["char_end"].alias("char_end"),
                    section["heading"].alias("section_title"), section["heading_path"].alias("heading_path"),
                    section["level"].alias("heading_level"), follows.alias("has_overlap_with_previous"),
                    o.alias("overlap_text")))

            return F.transform(with_offsets(ps), one)

        return F.when(F.length(text) < sizes.min_content, F.slice(let(F.array(F.lit("")), rows), 1, 0)) \
            .otherwise(let(pieces, rows))

    return let(full, build)


def explode_chunks(df: DataFrame, chunks: Column, keep: list[str]) -> DataFrame:
    """One row per chunk with its running index and the document's total."""
    return explode_rows(df, chunks, keep, pos="chunk_index", total="total_chunks")


def chunk_documents(parsed: DataFrame, key: list[str], sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """Chunks of parsed documents (column ``sections``), indexed across the sections of a document."""
    chunks = F.flatten(F.transform("sections", lambda s: chunk_section(s, sizes)))
    return explode_chunks(parsed, chunks, key)


def text_section(text: Column, title: Column, heading_path: Column | None = None) -> Column:
    path = title if heading_path is None else F.coalesce(heading_path, title)
    return F.struct(
        title.alias("heading"), F.lit(1).alias("level"), text.alias("content"), path.alias("heading_path"))


def chunk_texts(
    df: DataFrame, key: list[str], text: str = "text", title: Column | None = None,
    heading_path: Column | None = None, sizes: ChunkSizes = ChunkSizes(),
) -> DataFrame:
    """Chunks of plain text, no parsing."""
    section = text_section(F.col(text), F.lit("Document") if title is None else title, heading_path)
    return explode_chunks(df, let(section, lambda s: chunk_section(s, sizes)), key)


def estimate_tokens(text: Column) -> Column:
    """Four characters count as one token."""
    return (F.length(text) / 4).cast("bigint")


def chunk_stats(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sizes, token estimates, sections and overlaps in one aggregate."""
    size = F.length("content")
    tokens = estimate_tokens(F.col("content"))
    return chunks.groupBy(*(by or [])).agg(
        F.count("*").alias("chunk_count"),
        F.sum(size).alias("total_chars"),
        F.round(F.avg(size), 4).alias("avg_size"),
        F.min(size).cast("bigint").alias("min_size"),
        F.max(size).cast("bigint").alias("max_size"),
        F.sum(tokens).alias("est_total_tokens"),
        F.round(F.avg(tokens), 4).alias("est_avg_tokens"),
        F.count_distinct("section_title").alias("sections_covered"),
        F.count_if(F.col("has_overlap_with_previous")).alias("chunks_with_overlap"),
    )

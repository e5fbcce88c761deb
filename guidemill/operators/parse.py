"""Html pages to text, headings and sections.

Tokens, noise depth and sections are arrays inside the page's row, so parsing is one narrow stage
with no shuffle.  Only entity decoding has no built-in and goes through one Arrow batch function.
"""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guidemill.functions import fixed_values as fv
from guidemill.functions.matching import (
    empty_array, explode_rows, first_group, let, rx, scan, squeeze, strip,
)

_ENTITY = re.compile(r"&(?:amp;)*(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?")

# Marks between sections and between a heading and its content; html text cannot hold them.
_SEC, _LEVEL, _HEAD = "\x01", "\x02", "\x03"
_MARKS = "[\x01\x02\x03]"


def decode_entities(col: Column, markup: bool = False) -> Column:
    """Decode the entities of text; with ``markup`` the characters of tags and quotes stay escaped, for html that is cut later.

    Only the entities themselves go to Python, the text between them stays in the JVM: a worker's memory follows their
    number and not the length of the pages.  The function is built here so that it ships by value and executors need no
    copy of the package.
    """

    def batch(s: pd.Series) -> pd.Series:
        import html

        def one(entity: str) -> str:
            text = html.unescape(html.unescape(entity))
            return html.escape(text) if markup else text

        return s.map(lambda hits: [one(h) for h in hits] if hits is not None else None)

    decoded = F.pandas_udf(batch, T.ArrayType(T.StringType()))(F.regexp_extract_all(col, F.lit(_ENTITY.pattern), F.lit(0)))
    return F.array_join(F.zip_with(F.split(col, _ENTITY.pattern, -1), decoded, lambda gap, text: F.concat(gap, F.coalesce(text, F.lit("")))), "")


def decode_column(df: DataFrame, column: str) -> DataFrame:
    """Decode the entities of a text column in a step of its own.

    The optimizer would copy a function column into the lambdas of later expressions, where it cannot run.
    """
    pattern, names = _ENTITY, df.columns

    def run(batches):
        import html

        import pyarrow as pa

        one = lambda m: html.unescape(html.unescape(m.group(0)))
        for batch in batches:
            texts = [pattern.sub(one, x) if x is not None and "&" in x else x for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == column else batch.column(n) for n in names], names=names)

    return df.mapInArrow(run, df.schema)


def plain(col: Column) -> Column:
    """Undo the escapes that :func:`decode_entities` leaves in markup."""
    col = F.replace(F.replace(col, F.lit("&quot;"), F.lit('"')), F.lit("&#x27;"), F.lit("'"))
    col = F.replace(col, F.lit("&lt;"), F.lit("<"))
    col = F.replace(col, F.lit("&gt;"), F.lit(">"))
    return F.replace(col, F.lit("&amp;"), F.lit("&"))


def clean_lines(col: Column) -> Column:
    """Squeeze blanks and tabs, blank-line runs to one, strip each line and the whole."""
    one_blank = F.regexp_replace(col, r"[ \t]+", " ")
    paragraphs = F.regexp_replace(one_blank, rx(r"\n\s*\n", ""), "\n\n")
    return strip(F.array_join(F.transform(F.split(paragraphs, "\n", -1), strip), "\n"))


def _without_raw_blocks(html: Column) -> Column:
    """Comments, doctype, and elements whose content is not markup."""
    html = F.regexp_replace(html, _MARKS, "")
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    html = F.regexp_replace(html, r"<![^>]*>", "")
    html = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>", "")
    return F.regexp_replace(html, r"(?is)<style\b.*?</style\s*>", "")


# Quoted values may hold ">"; a tag whose quotes do not pair ends at its first ">".
TAG = r"</?[a-zA-Z](?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-zA-Z][^<>]*+>"


def tokens(html: Column) -> Column:
    """Tags and text pieces in order: array of struct(tok, tag, closing)."""
    parts = F.regexp_extract_all(_without_raw_blocks(html), F.lit(TAG + r"|[^<]+|<"), F.lit(0))
    return F.transform(parts, lambda t: F.struct(
        t.alias("tok"),
        F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1)).alias("tag"),
        t.startswith("</").alias("closing")))


def visible(toks: Column) -> Column:
    """Drop tokens inside noise elements.

    Depth counts open noise elements; an element that is never closed is still open at the end, which
    is the smallest depth from here on, so a token is noise when its depth exceeds that minimum.
    """
    noise = [t for t in fv.NOISE_ELEMENTS if t not in ("script", "style", "input")]

    def step(d: Column, t: Column) -> Column:
        counts = t["tag"].isin(*noise) & ~t["tok"].endswith("/>")
        return F.when(counts & t["closing"], F.greatest(d - 1, F.lit(0))).when(counts, d + 1).otherwise(d)

    def keep(ts: Column) -> Column:
        depth = scan(ts, F.lit(0), step, "int")

        def with_depth(d: Column) -> Column:
            floor = F.reverse(scan(F.reverse(d), F.lit(1 << 30), lambda s, x: F.least(s, x), "int"))
            return let(floor, lambda f: F.filter(
                ts, lambda t, i: (F.get(d, i) == F.get(f, i)) & ~t["tag"].isin(*noise, "input")))

        return let(depth, with_depth)

    return let(toks, lambda ts: F.when(F.exists(ts, lambda t: t["tag"].isin(*noise, "input")), keep(ts)).otherwise(ts))


def fragment(t: Column) -> Column:
    """Text a token contributes; text keeps one blank where it had white space at an end."""
    is_heading = t["tag"].isin(*fv.HEADING_ELEMENTS)
    level = F.substring(t["tag"], 2, 1)
    text = F.regexp_replace(t["tok"], rx(r"^\s+|\s+$", ""), " ")
    return (
        F.when(t["tag"] == "", text)
        .when(is_heading & ~t["closing"], F.concat(F.lit(_SEC), level, F.lit(_LEVEL)))
        .when(is_heading, F.lit(_HEAD + "\n\n"))
        .when((t["tag"] == "li") & ~t["closing"], F.lit("\n• "))
        .when(t["tag"].isin("br", "hr"), F.lit("\n"))
        .when(t["closing"] & t["tag"].isin(*fv.BLOCK_ELEMENTS), F.lit("\n"))
        .otherwise("")
    )


def marked_text(html: Column) -> Column:
    """Page text with section marks in front of headings; entities are still encoded."""
    return F.array_join(F.transform(visible(tokens(html)), fragment), "")


def full_text(marked: Column) -> Column:
    return clean_lines(F.regexp_replace(F.regexp_replace(marked, "\x01[0-9]\x02", ""), _MARKS, ""))


def _section_parts(marked: Column) -> Column:
    """(level, heading, content) for the text before the first heading (level 0) and for each heading."""

    def one(part: Column, i: Column) -> Column:
        body = F.regexp_replace(part, "(?s)^[^\x03]*\x03", "")
        heading = F.regexp_replace(F.regexp_extract(part, "(?s)^[0-9]\x02([^\x03]*)", 1), _MARKS, "")
        return F.when(i == 0, F.struct(
            F.lit(0).alias("level"), F.lit("").alias("heading"), clean_lines(part).alias("content"),
        )).otherwise(F.struct(
            F.substring(part, 1, 1).cast("int").alias("level"),
            clean_lines(heading).alias("heading"),
            F.when(part.contains(_HEAD), clean_lines(body)).otherwise(F.lit("")).alias("content")))

    return F.transform(F.split(marked, _SEC, -1), one)


def sections(marked: Column, title: Column, text: Column) -> Column:
    """Sections with content, each with its heading path below the title."""
    stack = "array<struct<level:int,heading:string>>"

    def step(path: Column, s: Column) -> Column:
        above = F.filter(path, lambda p: p["level"] < s["level"])
        pushed = F.concat(above, F.array(F.struct(s["level"].alias("level"), s["heading"].alias("heading"))))
        return F.when(s["level"] == 0, path).when(F.lower(s["heading"]) == F.lower(title), above).otherwise(pushed)

    def build(parts: Column) -> Column:
        paths = scan(parts, empty_array("struct<level:int,heading:string>"), step, stack)

        def rows(ps: Column) -> Column:
            all_rows = F.transform(parts, lambda s, i: F.struct(
                F.when(s["level"] == 0, title).otherwise(s["heading"]).alias("heading"),
                F.greatest(s["level"], F.lit(1)).alias("level"),
                s["content"].alias("content"),
                F.array_join(F.concat(F.array(title), F.transform(F.get(ps, i), lambda p: p["heading"])), " > ")
                .alias("heading_path")))
            return F.filter(all_rows, lambda r: r["content"] != "")

        return let(paths, rows)

    fallback = F.array(F.struct(
        title.alias("heading"), F.lit(1).alias("level"), text.alias("content"), title.alias("heading_path")))
    return let(
        let(_section_parts(marked), build),
        lambda s: F.when((F.size(s) == 0) & (text != ""), fallback).otherwise(s))


def headings(marked: Column) -> Column:
    """Headings in document order: array of struct(text, level, tag)."""
    return F.transform(
        F.filter(_section_parts(marked), lambda s: (s["level"] > 0) & (s["heading"] != "")),
        lambda s: F.struct(s["heading"].alias("text"), s["level"].alias("level"),
                           F.concat(F.lit("h"), s["level"]).alias("tag")))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, rx(r"\s+", "")), lambda w: w != "")).cast("bigint")


def page_title(html: Column) -> Column:
    """Text of the title element, else ``Document``."""
    t = squeeze(decode_entities(first_group(html, r"(?is)<title\b[^>]*>(.*?)</title", 1)))
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("Document"))


def parse_pages(
    pages: DataFrame, html: str = "html", title: str | None = None, decode: bool = True
) -> DataFrame:
    """Add title, full_text, sections, headings, word_count and has_content to a frame of pages.

    ``title`` names the title column; without one the page's own title element is used.
    """
    raw = F.coalesce(F.col(html), F.lit(""))
    df = pages.withColumn("doc_title", page_title(raw) if title is None else F.col(title)).withColumn("_marked", marked_text(raw))
    df = decode_column(df, "_marked") if decode else df
    df = df.withColumn("full_text", full_text(F.col("_marked")))
    df = df.withColumn("sections", sections(F.col("_marked"), F.col("doc_title"), F.col("full_text")))
    df = df.withColumn("headings", headings(F.col("_marked")))
    df = df.withColumn("word_count", word_count(F.col("full_text")))
    return df.withColumn("has_content", F.col("full_text") != "").drop("_marked")


def sections_frame(parsed: DataFrame, key: list[str]) -> DataFrame:
    """One row per section."""
    return explode_rows(parsed, F.col("sections"), key, pos="section_no")

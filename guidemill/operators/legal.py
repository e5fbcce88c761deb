"""Chunks with legal structure: manual ids, citations, condition lists kept whole, content flags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv
from guidemill.functions.matching import (
    any_of, contains_any, empty_array, explode_rows, first_case, first_group, let, rx, scan, spans, strip, window,
)
from guidemill.operators.chunk import estimate_tokens, split_text, text_section, with_heading, with_offsets

# Manual ids, looked for at their digits: few characters of a text are digits, and many begin one of the families.
ALL_IDS = r"[0-9]{5}\b(?<=\b(" + "|".join(p[3:-3] for p in fv.MANUAL_ID_PATTERNS.values()) + r"))"

# Repetitions in these would go into the stack once a word or figure and end the process on a long text.  What follows them
# cannot begin inside a repetition, so they never have to give anything back.
_DEFINITION = [(f, p.replace(r"(?:\s+[a-z]+)*)", r"(?:\s+[a-z]+)*+)"), *w) for f, p, *w in fv.DEFINITION_WORDING]
_PENALTY = [(f, p.replace(r"(?:,[0-9]+)*)", r"(?:,[0-9]+)*+)"), *w) for f, p, *w in fv.PENALTY_WORDING]


@dataclass(frozen=True)
class LegalSizes:
    """Sizes in characters."""

    minimum: int = 200
    target: int = 1500
    maximum: int = 3000
    max_list: int = 4000


_FAMILY_PREFIXES = [p[3:-3].split("[")[0].split("(")[0] for p in fv.MANUAL_ID_PATTERNS.values()]


def section_id(text: Column) -> Column:
    """First manual id, families in fixed order."""
    ids = F.regexp_extract_all(text, F.lit(rx(ALL_IDS)), F.lit(1))
    ranked = F.transform(ids, lambda c, i: let(F.upper(c), lambda u: F.struct(
        first_case(u, [(f"{n:02d}", u.startswith(p)) for n, p in enumerate(_FAMILY_PREFIXES)], "99").alias("family"),
        i.alias("at"), u.alias("id"))))
    return F.when(text.rlike("[0-9]{5}"), F.array_min(ranked)["id"])


def section_ids(text: Column) -> Column:
    """All distinct manual ids, sorted."""
    found = F.array_sort(F.array_distinct(F.transform(
        F.regexp_extract_all(text, F.lit(rx(ALL_IDS)), F.lit(1)), F.upper)))
    return F.when(text.rlike("[0-9]{5}"), found).otherwise(empty_array("string"))


def paragraph_number(text: Column) -> Column:
    return first_group(F.substring(text, 1, 200), rx(fv.PARAGRAPH_NUMBER, "m"))


def cross_references(text: Column, own: Column | None = None) -> Column:
    """Manual ids and section mentions, distinct and sorted, without the section's own id."""
    mentions = F.when(contains_any(F.lower(text), ["section", "paragraph", "chapter"]), F.concat(*[
        F.transform(F.regexp_extract_all(text, F.lit(rx(p)), F.lit(1)), lambda n: F.concat(F.lit("section "), n))
        for p in fv.SECTION_MENTIONS])).otherwise(empty_array("string"))
    refs = F.array_sort(F.array_distinct(F.concat(section_ids(text), mentions)))
    return refs if own is None else F.when(own.isNull(), refs).otherwise(F.array_except(refs, F.array(own)))


def has_condition_list(text: Column) -> Column:
    item = text.contains("(") & text.rlike(r"\([a-z]\)") & text.rlike(rx(fv.CONDITION_ITEM, "m"))
    return item & F.exists(F.split(text, r"\.", -1), lambda s: s.contains(":") & s.rlike(rx(fv.CONDITION_LEAD_IN, "im")))


def lead_in_starts(text: Column) -> Column:
    """Offsets of lead-ins.

    A lead-in goes on to a colon and holds no full stop, so only stretches between full stops that hold a colon are searched.
    """
    def located(parts: Column) -> Column:
        return let(scan(F.transform(parts, lambda p: F.length(p) + 1), F.lit(0), lambda s, n: s + n, "int"), lambda ends: F.flatten(F.transform(
            parts, lambda p, i: F.when(p.contains(":"), F.transform(
                spans(p, rx(fv.CONDITION_LEAD_IN, "im")), lambda s: s["start"] + F.get(ends, i) - F.length(p) - 1)).otherwise(empty_array("int")))))

    return let(F.split(text, r"\.", -1), located)


def has_definition(text: Column) -> Column:
    return any_of(text, _DEFINITION)


def has_example(text: Column) -> Column:
    return any_of(text, fv.EXAMPLE_WORDING)


def has_deadline(text: Column) -> Column:
    return any_of(text, fv.DEADLINE_WORDING)


def has_penalty(text: Column) -> Column:
    return any_of(text, _PENALTY)


def has_contact(text: Column) -> Column:
    return any_of(text, fv.CONTACT_WORDING)


def has_table_mention(text: Column) -> Column:
    return any_of(text, [("i", p, ("table",)) for p in fv.TABLE_MENTIONS])


def with_flags(df: DataFrame, text: str = "content") -> DataFrame:
    """Seven content flags, and the content type decided from them."""
    t = F.col(text)
    flagged = df.withColumns({
        "contains_condition_list": has_condition_list(t),
        "contains_definition": has_definition(t),
        "contains_example": has_example(t),
        "contains_table_reference": has_table_mention(t),
        "contains_deadline": has_deadline(t),
        "contains_penalty_info": has_penalty(t),
        "contains_contact_info": has_contact(t),
    })
    order = [("definition", "contains_definition"), ("condition_list", "contains_condition_list"),
             ("example", "contains_example"), ("contact", "contains_contact_info"),
             ("penalty", "contains_penalty_info"), ("deadline", "contains_deadline")]
    return flagged.withColumn(
        "content_type", first_case(t, [(label, F.col(c)) for label, c in order], "general"))


def manual_name(code: Column) -> Column:
    return first_case(code, [(name, code.startswith(prefix)) for prefix, name in fv.MANUAL_NAMES.items()], "Manual")


def citation(title: Column, section_title: Column, heading_path: Column, code: Column, para: Column) -> Column:
    """``HMRC <manual>, <id>, Para n`` or ``GOV.UK, <path or title>, Para n``."""
    para_part = F.when(para.isNotNull(), F.concat(F.lit("Para "), para))
    path = F.when((heading_path != "") & (heading_path != title), heading_path) \
        .when(section_title != "", section_title)
    return F.when(
        code.isNotNull(), F.concat_ws(", ", F.concat(F.lit("HMRC "), manual_name(code)), code, para_part)
    ).otherwise(F.concat_ws(", ", F.lit("GOV.UK"), path, para_part))


def condition_list_spans(text: Column, known: bool = False) -> Column:
    """(start, end) of lists: from each lead-in to the blank line after the last lettered item.

    ``known``: the text is known to hold a list.
    """
    ddl = "struct<start:int,end:int>"

    def bound(last: Column) -> Column:
        blank_line = F.locate("\n\n", F.substring(text, last["end"] + 1, F.length(text)))
        end = F.when(blank_line > 0, last["end"] + blank_line - 1).otherwise(F.length(text))
        leads = F.filter(lead_in_starts(text), lambda s: s < last["end"])
        return let(end, lambda e: F.transform(leads, lambda s: F.struct(s.alias("start"), e.alias("end"))))

    items = spans(text, rx(fv.CONDITION_ITEM, "m"))
    out = let(items, lambda it: F.when(F.size(it) > 0, bound(F.element_at(it, -1))).otherwise(empty_array(ddl)))
    return out if known else F.when(has_condition_list(text), out).otherwise(empty_array(ddl))


def split_keeping_lists(text: Column, sizes: LegalSizes, known: bool = False) -> Column:
    """Pieces that do not cut a condition list unless it exceeds its own limit; ``known``: the text is known to hold one."""
    top = sizes.maximum
    state = "struct<pos:int,held:array<string>,size:int,out:array<string>>"

    def packed(a: Column) -> Column:
        return F.when(F.size(a["held"]) > 0, F.concat(a["out"], F.array(F.array_join(a["held"], "\n")))) \
            .otherwise(a["out"])

    def make(pos: Column, held: Column, size: Column, out: Column) -> Column:
        return F.struct(pos.alias("pos"), held.alias("held"), size.cast("int").alias("size"), out.alias("out"))

    none = empty_array("string")

    def add_before(a: Column, part: Column) -> Column:
        full = (a["size"] + F.length(part) > top) & (F.size(a["held"]) > 0)
        return F.when(part == "", a) \
            .when(full, make(a["pos"], F.array(part), F.length(part), packed(a))) \
            .otherwise(make(a["pos"], F.concat(a["held"], F.array(part)), a["size"] + F.length(part), a["out"]))

    def add_list(a: Column, part: Column, end: Column) -> Column:
        own = F.when(F.length(part) > sizes.max_list, split_text(part, top)).otherwise(F.array(part))
        return F.when(
            a["size"] + F.length(part) > top, make(end, none, F.lit(0), F.concat(packed(a), own))
        ).otherwise(make(end, F.concat(a["held"], F.array(part)), a["size"] + F.length(part), a["out"]))

    def step(a: Column, s: Column) -> Column:
        before = strip(window(text, a["pos"], s["start"]))
        whole = strip(window(text, s["start"], s["end"]))
        return let(let(before, lambda b: add_before(a, b)),
                   lambda n: let(whole, lambda w: add_list(n, w, s["end"])))

    def finish(a: Column) -> Column:
        def with_rest(rest: Column) -> Column:
            full = (a["size"] + F.length(rest) > top) & (F.size(a["held"]) > 0)
            return F.when(rest == "", packed(a)) \
                .when(full, F.concat(packed(a), split_text(rest, top))) \
                .otherwise(F.concat(a["out"], F.array(F.array_join(F.concat(a["held"], F.array(rest)), "\n"))))

        return let(strip(F.substring(text, a["pos"] + 1, F.length(text))), with_rest)

    def pack(lists: Column) -> Column:
        start = make(F.lit(0), none, F.lit(0), none).cast(state)
        return F.aggregate(lists, start, step, finish)

    pieces = let(condition_list_spans(text, known), lambda ls: F.when(F.size(ls) == 0, split_text(text, top)).otherwise(pack(ls)))
    return F.when(F.length(text) <= top, F.array(text)).otherwise(F.filter(pieces, lambda p: strip(p) != ""))


def chunk_section(section: Column, sizes: LegalSizes) -> Column:
    """Array of pieces of one section with position and the section's own id."""

    def build(text: Column) -> Column:
        pieces = F.when(has_condition_list(text), split_keeping_lists(text, sizes, known=True)) \
            .otherwise(split_text(text, sizes.target))
        rows = let(section_id(text), lambda code: F.transform(
            let(pieces, with_offsets), lambda x: F.struct(
                x["piece"].alias("content"), x["char_start"].alias("char_start"), x["char_end"].alias("char_end"),
                section["heading"].alias("section_title"), section["heading_path"].alias("heading_path"),
                section["level"].alias("heading_level"), code.alias("section_id"),
                (x["i"] > 0).alias("has_overlap_with_previous"))))
        return F.when(F.length(text) >= sizes.minimum, rows).otherwise(empty_array(
            "struct<content:string,char_start:int,char_end:int,section_title:string,heading_path:string,"
            "heading_level:int,section_id:string,has_overlap_with_previous:boolean>"))

    return let(with_heading(section), build)


def _finish(chunks: DataFrame, title: str) -> DataFrame:
    c = chunks.withColumn("paragraph_number", paragraph_number(F.col("content")))
    c = c.withColumn("citable_reference", citation(
        F.col(title), F.col("section_title"), F.col("heading_path"), F.col("section_id"), F.col("paragraph_number")))
    c = with_flags(c)
    return c.withColumn("cross_references", cross_references(F.col("content"), F.col("section_id")))


def chunk_documents(
    parsed: DataFrame, key: list[str], title: str = "doc_title", sizes: LegalSizes = LegalSizes()
) -> DataFrame:
    """Legal chunks of parsed documents (column ``sections``)."""
    arr = F.flatten(F.transform("sections", lambda s: chunk_section(s, sizes)))
    keep = list(dict.fromkeys([*key, title]))
    return _finish(explode_rows(parsed, arr, keep, pos="chunk_index", total="total_chunks"), title)


def chunk_texts(
    df: DataFrame, key: list[str], text: str = "text", title: Column | None = None,
    heading_path: Column | None = None, sizes: LegalSizes = LegalSizes(),
) -> DataFrame:
    """Legal chunks of plain text."""
    titled = df.withColumn("_title", F.lit("Document") if title is None else title)
    section = text_section(F.col(text), F.col("_title"), heading_path)
    arr = let(section, lambda s: chunk_section(s, sizes))
    out = explode_rows(titled, arr, [*key, "_title"], pos="chunk_index", total="total_chunks")
    return _finish(out, "_title").drop("_title")


FLAG_COUNTS = {
    "with_condition_lists": "contains_condition_list",
    "with_definitions": "contains_definition",
    "with_examples": "contains_example",
    "with_deadlines": "contains_deadline",
    "with_penalties": "contains_penalty_info",
    "with_contacts": "contains_contact_info",
}


def chunk_stats(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sizes, tokens, sections, flag counts and cross-reference total in one aggregate."""
    size = F.length("content")
    return chunks.groupBy(*(by or [])).agg(
        F.count("*").alias("chunk_count"),
        F.sum(size).alias("total_chars"),
        F.round(F.avg(size), 4).alias("avg_size"),
        F.min(size).cast("bigint").alias("min_size"),
        F.max(size).cast("bigint").alias("max_size"),
        F.sum(estimate_tokens(F.col("content"))).alias("est_total_tokens"),
        F.count_distinct("section_title").alias("sections_covered"),
        F.count("section_id").alias("with_section_ids"),
        *[F.count_if(F.col(c)).alias(n) for n, c in FLAG_COUNTS.items()],
        F.sum(F.size("cross_references").cast("bigint")).alias("total_cross_refs"),
    )


def content_type_counts(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    return chunks.groupBy(*(by or []), "content_type").agg(F.count("*").alias("chunk_count"))


def chunk_json(chunks: DataFrame) -> DataFrame:
    """One json document per chunk; every field is kept, also nulls."""
    names = ["content", "chunk_index", "total_chunks", "char_start", "char_end", "section_title", "heading_path",
             "heading_level", "section_id", "paragraph_number", "citable_reference", "content_type",
             "contains_condition_list", "contains_definition", "contains_example", "contains_table_reference",
             "contains_deadline", "contains_penalty_info", "contains_contact_info", "cross_references",
             "has_overlap_with_previous"]
    return chunks.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("chunk_json"), *[
        c for c in chunks.columns if c not in names])

"""Cross-references in text and links in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv
from guidemill.functions.matching import (
    contains_any, empty_array, explode_rows, first_case, first_per_key, folded, gaps, gated, let, rx, scan, squeeze, tagged_spans, window,
)
from guidemill.operators.legal import ALL_IDS
from guidemill.operators.parse import plain

_STRIDE = 1 << 32

REFERENCE_DDL = (
    "struct<key:struct<type:string,target:string>,ord:bigint,reference_type:string,reference_text:string,"
    "target_normalized:string,target_url:string,context:string,position:int,relationship_type:string,strength:string>"
)


def has_references(text: Column) -> Column:
    """Probe; as wide as the detectors, so skipping a text never loses a reference."""
    wide = (
        "|".join(fv.MANUAL_ID_PATTERNS.values())
        + r"|(?:see|refer\s+to|section|paragraph|para\.?|explained\s+in|described\s+in|set\s+out\s+in)\s+"
        + r"|\bAct\s+[0-9]{4}|S\.?I\.?\s*[0-9]{4}/[0-9]+|(?:Regulation|Directive)\s+[0-9]+/[0-9]+"
        + r"|['\"]\s+(?:as\s+defined|has\s+the\s+meaning|means|is\s+defined)|within\s+the\s+meaning\s+of"
    )
    return text.rlike(rx(wide))


def relationship(context: Column) -> Column:
    return let(F.lower(context), lambda c: first_case(
        c, [(label, contains_any(c, words)) for label, words in fv.RELATIONSHIP_WORDS], "references"))


def _underscored(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


# Detector order: manual families share one pass (their ids cannot overlap), the rest follow.
_MANUAL, _SECTION, _LEGISLATION, _TERM, _LINK = 0, 20, 30, 40, 50
_PREFIXES = [p[3:-3].split("[")[0].split("(")[0] for p in fv.MANUAL_ID_PATTERNS.values()]


def _manual_spans(text: Column) -> Column:
    """Manual ids as tagged spans; the pattern matches their five digits and sees the whole id."""
    ddl = "struct<tag:int,start:int,end:int,hit:string,g1:string,g2:string>"

    def located(ids: Column) -> Column:
        ends = let(gaps(text, rx(ALL_IDS)), lambda between: scan(F.transform(ids, lambda h, i: F.length(F.get(between, i)) + 5), F.lit(0), lambda s, n: s + n, "int"))
        return let(ends, lambda e: F.transform(ids, lambda h, i: F.struct(
            F.lit(_MANUAL).alias("tag"), (F.get(e, i) - F.length(h)).alias("start"), F.get(e, i).alias("end"), h.alias("hit"), h.alias("g1"),
            F.lit(None).cast("string").alias("g2")).cast(ddl)))

    found = let(F.regexp_extract_all(text, F.lit(rx(ALL_IDS)), F.lit(1)), lambda ids: gated(F.size(ids) > 0, located(ids), ddl))
    return gated(text.rlike("[0-9]{5}"), found, ddl)


def _patterns(text: Column, words: Column) -> list[tuple[int, str, int, Column]]:
    """(tag, pattern, groups, cheap condition) per detector."""
    # ``plain`` also finds what a pattern without case finds, so the further words lose nothing.
    low, plain = words["low"], words["plain"]
    digit, quoted = words["digit"], text.rlike("['\"]")
    held = [contains_any(plain, ws) for ws in (["see", "refer"], ["explained", "described", "set"], ["above", "below", "explain"])]
    sections = [words["section"] & h for h in held]
    act, fraction = words["act"], digit & text.contains("/") & text.rlike("[0-9]/[0-9]")
    acts = {"uk_act": act, "act_section": act, "statutory_instrument": fraction, "eu_regulation": fraction & contains_any(low, ["regulation", "directive"])}
    terms = [contains_any(low, ["defined", "meaning", "means"]) & h for h in (quoted, quoted, plain.contains("within"))]
    out = [(_SECTION + i, rx(p), 1, sections[i]) for i, p in enumerate(fv.SECTION_REFERENCES)]
    out += [(_LEGISLATION + i, rx(p), 2 if kind == "act_section" else 1, acts[kind])
            for i, (kind, p) in enumerate(fv.LEGISLATION_REFERENCES)]
    return out + [(_TERM + i, rx(p), 1, terms[i]) for i, p in enumerate(fv.TERM_REFERENCES)]


def text_references(text: Column) -> Column:
    """All references of the four text detectors, as reference rows."""
    families = list(fv.MANUAL_ID_PATTERNS)

    def row(s: Column) -> Column:
        tag, g1 = s["tag"], s["g1"]
        is_manual, is_section, is_term = tag == _MANUAL, (tag >= _SECTION) & (tag < _LEGISLATION), tag >= _TERM
        two = s["g2"].isNotNull()
        code = F.upper(g1)
        family = first_case(code, [(str(i), code.startswith(p)) for i, p in enumerate(_PREFIXES)], None).cast("int")
        has_url = family.isin([i for i, f in enumerate(families) if f in fv.MANUALS_WITH_ADDRESS])
        label = F.when(is_manual, code).when(is_section, F.concat(F.lit("section "), g1)) \
            .when(two, F.concat(F.lit("s."), g1, F.lit(" "), s["g2"])).otherwise(g1)
        target = F.when(is_manual, F.lower(g1)).when(is_section, F.concat(F.lit("section_"), g1)) \
            .when(two, F.concat(_underscored(s["g2"]), F.lit("_s"), g1)).otherwise(_underscored(g1))
        kind = F.when(is_manual, "hmrc_manual").when(is_section, "section").when(is_term, "definition") \
            .otherwise("legislation")
        margin = F.when(is_manual, 50).otherwise(30)
        context = window(text, s["start"] - margin, s["end"] + F.when(is_manual | is_term, 50).otherwise(30))
        rel = F.when(is_manual, relationship(context)).when(is_section, "references").when(is_term, "defines") \
            .otherwise("cites")
        return let(F.struct(kind.alias("k"), target.alias("t")), lambda key: F.struct(
            F.struct(key["k"].alias("type"), key["t"].alias("target")).alias("key"),
            ((tag + F.when(is_manual, family).otherwise(0)) * F.lit(_STRIDE) + s["start"]).alias("ord"),
            key["k"].alias("reference_type"), label.alias("reference_text"), key["t"].alias("target_normalized"),
            F.when(is_manual & has_url, F.concat(F.lit(fv.MANUAL_ADDRESS), F.lower(g1))).alias("target_url"),
            context.alias("context"), s["start"].alias("position"), rel.alias("relationship_type"),
            F.lit("explicit").alias("strength")).cast(REFERENCE_DDL))

    # A figure follows the word "act" and, as a number or a full stop, those for sections.
    tests = lambda t: F.struct(
        t["low"].alias("low"), t["plain"].alias("plain"), t["digit"].alias("digit"),
        (t["digit"] & t["low"].contains("act") & t["plain"].rlike(r"(?U)act\s+[0-9]{4}")).alias("act"),
        (contains_any(t["low"], ["section", "para"]) & t["plain"].rlike(r"(?U)(?:section|para|paragraph)\.?\s+[0-9.]")).alias("section"))
    looked = let(F.struct(F.lower(text).alias("low"), folded(text).alias("plain"), text.rlike("[0-9]").alias("digit")), tests)
    return F.transform(let(looked, lambda words: F.concat(
        _manual_spans(text), tagged_spans(text, _patterns(text, words)))), row)


def anchors(html: Column) -> Column:
    """Anchors with an address: array of struct(href, label)."""
    body = F.regexp_replace(html, r"(?s)<!--.*?-->|(?i)<script\b.*?</script\s*>", "")
    pat = F.lit(r"(?is)<a\b([^>]*)>(.*?)(?=</a\s*>|<a\b|\z)")
    pairs = F.arrays_zip(
        F.regexp_extract_all(body, pat, F.lit(1)).alias("attrs"),
        F.regexp_extract_all(body, pat, F.lit(2)).alias("inner"))
    href = r"(?i)(?:^|\s)href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
    with_href = F.filter(pairs, lambda a: a["attrs"].rlike(href))
    return F.transform(with_href, lambda a: F.struct(
        plain(F.concat(*[F.regexp_extract(a["attrs"], href, g) for g in (1, 2, 3)])).alias("href"),
        squeeze(plain(F.regexp_replace(a["inner"], "<[^>]*>", ""))).alias("label")))


def internal_links(html: Column) -> Column:
    """Links inside the guidance site, as reference rows."""
    inside = F.filter(anchors(html), lambda a: (
        (a["href"].startswith("/") | a["href"].contains("gov.uk")) & ~contains_any(a["href"], fv.SKIPPED_LINKS)))
    return F.transform(inside, lambda a, i: F.struct(
        F.struct(F.lit("internal_link").alias("type"), F.lower(a["href"]).alias("target")).alias("key"),
        (F.lit(_LINK) * F.lit(_STRIDE) + i).alias("ord"),
        F.lit("internal_link").alias("reference_type"),
        F.coalesce(F.nullif(a["label"], F.lit("")), a["href"]).alias("reference_text"),
        F.lower(a["href"]).alias("target_normalized"),
        F.when(a["href"].startswith("/"), F.concat(F.lit(fv.SITE_ADDRESS), a["href"])).otherwise(a["href"])
        .alias("target_url"),
        a["label"].alias("context"), F.lit(0).alias("position"), F.lit("links_to").alias("relationship_type"),
        F.lit("explicit").alias("strength"),
    ).cast(REFERENCE_DDL))


def references(text: Column, html: Column | None = None) -> Column:
    """First reference per (type, target), in detector order."""
    found = text_references(text)
    if html is not None:
        links = F.when(F.length(text) > 0, internal_links(html)).otherwise(empty_array(REFERENCE_DDL))
        found = F.concat(found, links)
    firsts = first_per_key(found)
    return F.array_sort(firsts, lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))


def reference_rows(df: DataFrame, key: list[str], text: str = "text", html: str | None = None) -> DataFrame:
    rows = explode_rows(df, references(F.col(text), None if html is None else F.col(html)), key, pos="item_no")
    return rows.drop("key", "ord")


def link_rows(pages: DataFrame, key: list[str], html: str = "html") -> DataFrame:
    """Internal links of pages, first per target."""
    from guidemill.operators.parse import decode_entities

    df = pages.withColumn("_decoded", decode_entities(F.col(html), markup=True))
    return explode_rows(df, first_per_key(internal_links(F.col("_decoded"))), key, pos="item_no").drop("key", "ord")

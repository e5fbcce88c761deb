"""Document and chunk metadata: thresholds, tax years, forms, key dates, keywords, topics, business types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv
from guidemill.functions.matching import (
    around, contains_any, empty_array, explode_rows, first_case, first_per_key, folded, gated, let, literal_map,
    literal_strings, rx, spans,
)
from guidemill.functions.values import number, tax_years

_PATTERN_STRIDE = 1 << 32
# Words of which every match of the threshold patterns holds one, in pattern order.
_THRESHOLD_WORDS = [("registration",), ("turnover",), ("personal",), ("allowance",), ("basic",), ("higher",), ("additional",), ("small",),
                    ("main", "upper"), ("primary",), ("secondary",), ("earnings",), ("threshold",), ("threshold",)]
# Further words and signs that every match holds.
_THRESHOLD_MORE = [("threshold",), ("\u00a3",), ("allowance",), ("tax",), ("rate",), ("rate",), ("rate",), ("profits",),
                   ("limit", "threshold"), ("threshold",), ("threshold",), ("limit",), ("\u00a3",), ("\u00a3",)]


def thresholds(text: Column) -> Column:
    """Typed amounts, one per distinct value: array of struct(value, type, context, formatted)."""

    def of_pattern(i: int, kind: str, pattern: str, low: Column, plain: Column) -> Column:
        held = contains_any(low, _THRESHOLD_WORDS[i]) & contains_any(plain, _THRESHOLD_MORE[i])
        return F.transform(spans(text, rx(pattern), 1, held), lambda s: F.struct(
            number(s["g1"], "bigint").alias("key"),
            (F.lit(i) * F.lit(_PATTERN_STRIDE) + s["start"]).alias("ord"),
            F.lit(kind).alias("type"), around(text, s, 50, 50).alias("context")))

    # An amount without a digit has no value, so a text without one holds none.
    ddl = "struct<key:bigint,ord:bigint,type:string,context:string>"
    found = gated(text.rlike("[0-9]"), let(F.struct(F.lower(text).alias("low"), folded(text).alias("plain")), lambda t: F.concat(*[
        of_pattern(i, kind, p, t["low"], t["plain"]) for i, (kind, p) in enumerate(fv.THRESHOLD_PATTERNS)])).cast(f"array<{ddl}>"), ddl)
    firsts = first_per_key(F.filter(found, lambda x: x["key"].isNotNull()))
    in_order = F.array_sort(F.transform(firsts, lambda x: F.struct(
        x["ord"].alias("ord"), x["key"].alias("value"), x["type"].alias("type"), x["context"].alias("context"))))
    out = F.transform(in_order, lambda x: F.struct(
        x["value"].alias("value"), x["type"].alias("type"), x["context"].alias("context"),
        F.concat(F.lit("£"), F.format_number(x["value"], 0)).alias("formatted")))
    return out


def form_mentions(text: Column) -> Column:
    """Form codes as written, with repeats; all but three hold a digit."""
    found = F.regexp_extract_all(text, F.lit(rx(r"(?=[scvprfe])" + fv.FORM_CODE_WIDE)), F.lit(1))
    return F.when(text.isNotNull(), gated(text.rlike("[0-9]") | contains_any(folded(text), ["rti", "fps", "eps"]), found, "string"))


def forms(text: Column, mentions: Column | None = None) -> Column:
    """Distinct form codes in order of appearance: array of struct(code, name)."""
    codes = F.array_distinct(F.transform(form_mentions(text) if mentions is None else mentions, F.upper))
    return F.transform(codes, lambda c: F.struct(
        c.alias("code"),
        F.coalesce(F.try_element_at(literal_map(fv.FORM_NAMES), c), F.lit(fv.FORM_NAME_DEFAULT)).alias("name")))


def date_type(context: Column) -> Column:
    return let(F.lower(context), lambda c: first_case(
        c, [(label, contains_any(c, words)) for label, words in fv.DATE_WORDS], "date"))


def key_dates(text: Column) -> Column:
    """First mention of each day and month: array of struct(day, month, context, type)."""
    found = F.transform(spans(text, rx(fv.DAY_MONTH), 2, text.rlike(r"[0-9]")), lambda s: F.struct(
        F.struct(s["g1"].cast("int").alias("day"), F.initcap(s["g2"]).alias("month")).alias("key"),
        s["start"].alias("ord"), around(text, s, 100, 50).alias("context")))
    in_order = F.array_sort(F.transform(first_per_key(found), lambda x: F.struct(
        x["ord"].alias("ord"), x["key"].alias("key"), x["context"].alias("context"))))
    return F.transform(in_order, lambda x: F.struct(
        x["key"]["day"].alias("day"), x["key"]["month"].alias("month"), x["context"].alias("context"),
        date_type(x["context"]).alias("type")))


def _by_part(words: list[str]) -> dict[str, list[str]]:
    """Words under a part of four letters (shorter words: all of it) that several of them share."""
    left, parts = set(words), {}
    while left:
        shared = {w[k: k + 4] for w in left for k in range(max(1, len(w) - 3))}
        best = max(sorted(shared), key=lambda p: sum(p in w for w in left))
        parts[best] = sorted(w for w in left if best in w)
        left -= set(parts[best])
    return parts


def words_found(text: Column) -> Column:
    """Topic and business words in the text, sorted; one scan serves keywords, topics and business types."""
    words = sorted({w for group in (fv.TOPIC_WORDS, fv.BUSINESS_WORDS) for ws in group.values() for w in ws})

    def held(low: Column) -> Column:
        return F.array_sort(F.concat(*[
            gated(low.contains(part), F.filter(literal_strings(ws), lambda w: F.contains(low, w)), "string") for part, ws in _by_part(words).items()]))

    return F.when(text.isNotNull(), let(F.lower(text), held)).otherwise(empty_array("string"))


def keywords(text: Column, found: Column, mentions: Column | None = None) -> Column:
    """Topic and business words and form codes found, sorted."""
    codes = F.transform(form_mentions(text) if mentions is None else mentions, F.lower)
    return F.array_sort(F.array_distinct(F.concat(found, codes)))


def _labels(found: Column, dictionary: dict[str, list[str]], at_least: int) -> Column:
    table = F.array(*[
        F.struct(F.lit(k).alias("label"), literal_strings(ws).alias("words")) for k, ws in dictionary.items()])
    # Bound first: the optimizer may put the expression behind ``found`` in its place, once per topic.
    hits = let(found, lambda f: F.filter(table, lambda t: F.size(F.array_intersect(t["words"], f)) >= at_least))
    return F.transform(hits, lambda t: t["label"])


def topics(found: Column) -> Column:
    """Topics with at least two of their words among the words found."""
    return _labels(found, fv.TOPIC_WORDS, 2)


def business_types(found: Column) -> Column:
    """Business types with any of their words among the words found."""
    return _labels(found, fv.BUSINESS_WORDS, 1)


def with_metadata(df: DataFrame, text: str = "text") -> DataFrame:
    """All metadata columns, at document or chunk grain."""
    t, found, codes = F.col(text), F.col("_found"), F.col("_codes")
    return df.withColumns({"_found": words_found(t), "_codes": form_mentions(t)}).withColumns({
        "thresholds": thresholds(t), "tax_years": tax_years(t), "forms": forms(t, codes), "key_dates": key_dates(t),
        "keywords": keywords(t, found, codes), "topics": topics(found), "business_types": business_types(found),
    }).drop("_found", "_codes")


def merge_pair(left: str, right: str) -> dict[str, Column]:
    """Merged metadata of two struct columns: lists joined, label sets united."""
    a, b = F.col(left), F.col(right)
    joined = {n: F.concat(a[n], b[n]) for n in ("thresholds", "forms", "key_dates")}
    united = {n: F.array_union(a[n], b[n]) for n in ("tax_years", "keywords", "topics", "business_types")}
    return joined | united


def _tag(name: str) -> Column:
    return F.transform(name, lambda x: F.struct(F.lit(name).alias("name"), x.alias("label")))


def merge_labels(df: DataFrame, by: list[str]) -> DataFrame:
    """Union of the label sets per group.

    Single labels are made distinct before they meet: the first aggregate combines map-side, so a hot
    group ships each of its labels once per task, and the sets are bounded by the dictionaries.
    """
    names = ("tax_years", "keywords", "topics", "business_types")
    single = df.select(*by, F.explode_outer(F.concat(*[_tag(n) for n in names])).alias("l")).select(*by, "l.name", "l.label").distinct()
    return single.groupBy(*by).agg(*[
        F.array_sort(F.collect_set(F.when(F.col("name") == n, F.col("label")))).alias(n) for n in names])


def threshold_rows(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    return explode_rows(df, thresholds(F.col(text)), key, pos="item_no")


def form_rows(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    return explode_rows(df, forms(F.col(text)), key, pos="item_no")


def key_date_rows(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    return explode_rows(df, key_dates(F.col(text)), key, pos="item_no")


def chunk_hints(df: DataFrame, text: str = "text") -> DataFrame:
    """Rule-based hints per chunk: threshold values and type, forms, dates, penalty and deadline relevance."""
    from guidemill.operators.legal import has_deadline, has_penalty

    t = F.col(text)
    base = df.withColumns({"_thresholds": thresholds(t), "_forms": forms(t), "_dates": key_dates(t)})
    return base.withColumns({
        "tax_years": tax_years(t),
        "threshold_values": F.transform("_thresholds", lambda x: x["value"]),
        "threshold_type": F.get("_thresholds", F.lit(0))["type"],
        "form_references": F.transform("_forms", lambda x: x["code"]),
        "deadlines_mentioned": F.transform("_dates", lambda d: F.concat_ws(" ", d["day"].cast("string"), d["month"])),
        "penalty_relevant": has_penalty(t),
        "deadline_sensitive": has_deadline(t),
    }).drop("_thresholds", "_forms", "_dates")

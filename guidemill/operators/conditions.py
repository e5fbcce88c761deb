"""Condition lists: lead-in, items, AND / OR, outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv
from guidemill.functions.matching import (
    contains_any, empty_array, explode_rows, first_at, first_case, first_group, folded, let, literal_map, rx, spans, squeeze, tagged_spans, window,
)

VARIABLE_DDL = "struct<type:string,value:string,context:string>"
ITEM_DDL = f"struct<id:string,text:string,variables:array<{VARIABLE_DDL}>>"
LIST_DDL = (
    f"struct<condition_name:string,condition_type:string,logical_operator:string,conditions:array<{ITEM_DDL}>,"
    "outcome_if_met:string,context_text:string>"
)


def has_condition_lists(text: Column) -> Column:
    """Probe: a lead-in has to be there for a list to be found."""
    return let(folded(text), lambda low: (low.contains("if") & text.rlike(rx(r"(?=if)(?:\bif\b|if[:\s])")))
               | (contains_any(low, ["unless", "following"]) & text.rlike(rx(r"\bunless\b|of\s+the\s+following"))))


def item_variables(text: Column) -> Column:
    """Pound amounts with 20 characters around them, then percentages."""
    pounds = F.transform(spans(text, rx(fv.POUND_AMOUNT, ""), 1), lambda s: F.struct(
        F.lit("currency_gbp").alias("type"), s["g1"].alias("value"),
        window(text, s["start"] - 20, s["end"] + 20).alias("context")).cast(VARIABLE_DDL))
    percents = F.transform(F.regexp_extract_all(text, F.lit(rx(fv.PERCENT, "")), F.lit(1)), lambda v: F.struct(
        F.lit("percentage").alias("type"), v.alias("value"), F.lit(None).cast("string").alias("context")).cast(VARIABLE_DDL))
    return F.concat(pounds, percents)


def _item(id_: Column, text: Column) -> Column:
    return F.struct(id_.alias("id"), squeeze(text).alias("text"), item_variables(text).alias("variables")).cast(ITEM_DDL)


def list_items(text: Column) -> Column:
    """Lettered items, else numbered ones, else bullets (named a, b, ..)."""

    def pairs(pattern: str) -> Column:
        p = F.lit(rx(pattern, "ms"))
        return F.transform(
            F.arrays_zip(F.regexp_extract_all(text, p, F.lit(1)).alias("id"), F.regexp_extract_all(text, p, F.lit(2)).alias("t")),
            lambda x: _item(x["id"], x["t"]))

    bullets = F.transform(
        F.regexp_extract_all(text, F.lit(rx(fv.BULLET_ITEM, "ms")), F.lit(1)),
        lambda t, i: _item(F.chr(i + 97), t))
    return F.when(text.rlike(rx(fv.LETTERED_ITEM, "ms")), pairs(fv.LETTERED_ITEM)) \
        .when(text.rlike(rx(fv.NUMBERED_ITEM, "ms")), pairs(fv.NUMBERED_ITEM)) \
        .otherwise(bullets)


def list_end(rest: Column) -> Column:
    """Earliest terminator past character 50; a numbered line does not end a numbered list."""

    def beyond(pattern: str) -> Column:
        return let(first_at(rest, rx(pattern, "")), lambda at: F.when(at > 50, at))

    numbered = rest.rlike(rx(r"^\s*[0-9]+\.", "m")) & ~rest.rlike(rx(r"^\s*\([a-z]\)", "m"))
    return F.least(
        F.length(rest), beyond(r"\n\n(?=[A-Z])"), beyond(r"\n##"), F.when(~numbered, beyond(r"\n[0-9]+\.")))


def logical_operator(intro: Column) -> Column:
    return first_case(intro, [("OR", intro.rlike(rx(fv.OR_WORDS))), ("AND", intro.rlike(rx(fv.AND_WORDS)))], "OR")


def outcome(intro: Column, kind: Column) -> Column:
    said = F.coalesce(*[first_group(intro, rx(p)) for p in fv.OUTCOME_PATTERNS])
    return F.coalesce(F.concat(F.lit("You must "), said), F.try_element_at(literal_map(fv.OUTCOME_BY_TYPE), kind))


def condition_lists(text: Column) -> Column:
    """Lists of at least two items."""
    def starts(low: Column) -> list[tuple]:
        return [(i, rx(p, "is"), 1 if has_subject else 0, low.contains("you" if has_subject else "following"))
                for i, (_, _, has_subject, p) in enumerate(fv.CONDITION_STARTS)]

    def row(s: Column) -> Column:
        kind = first_case(s["tag"], [(k, s["tag"] == i) for i, (k, *_) in enumerate(fv.CONDITION_STARTS)], None)
        hint = first_case(s["tag"], [(h, s["tag"] == i) for i, (_, h, *_) in enumerate(fv.CONDITION_STARTS)], None)
        rest = window(text, s["end"], s["end"] + 2000)
        parts = F.struct(
            F.lower(window(text, s["start"] - 50, s["end"])).alias("intro"), kind.alias("kind"),
            let(rest, lambda r: F.substring(r, F.lit(1), list_end(r))).alias("body"))
        return let(parts, lambda p: F.struct(
            F.concat(F.initcap(p["kind"]), F.lit(" conditions for "), F.coalesce(F.nullif(s["g1"], F.lit("")), hint))
            .alias("condition_name"),
            p["kind"].alias("condition_type"), logical_operator(p["intro"]).alias("logical_operator"),
            list_items(p["body"]).alias("conditions"), outcome(p["intro"], p["kind"]).alias("outcome_if_met"),
            window(text, s["start"], s["end"] + F.length(p["body"])).alias("context_text")).cast(LIST_DDL))

    found = F.filter(F.transform(let(folded(text), lambda low: tagged_spans(text, starts(low))), row), lambda c: F.size(c["conditions"]) >= 2)
    # Items begin with a letter in brackets, a figure or a bullet.
    return F.when(text.rlike(r"[(0-9\u2022*\-]") & has_condition_lists(text), found).otherwise(empty_array(LIST_DDL))


def condition_list_rows(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    return explode_rows(df, condition_lists(F.col(text)), key, pos="item_no")

"""Contact points in text: phone numbers, official e-mail addresses, opening hours, known helplines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv
from guidemill.functions.matching import (
    around, contains_any, empty_array, explode_rows, first_group, folded, gated, let, literal_map, rx, spans, window,
)

# A word or sign that every match of a pattern holds, in pattern order.
_INDICATOR_WORDS = ["contact", "helpline", "telephone", "call", "help", "phone"]
_PHONE_SIGNS = ["0", "+44"]

METHOD_DDL = "struct<type:string,value:string,hours:string,name:string>"


def _has_methods(text: Column) -> Column:
    """A phone or address, of any owner: what a window holds the text holds, too."""
    phone = contains_any(text, _PHONE_SIGNS) & text.rlike(rx("(?=[0+])(?:" + "|".join(fv.PHONE_PATTERNS) + ")"))
    email = text.contains("@") & text.rlike(rx(fv.EMAIL, ""))
    return phone | email


def has_contacts(text: Column) -> Column:
    """Probe; as wide as the extractor."""
    return _has_methods(text) | (contains_any(folded(text), _INDICATOR_WORDS) & text.rlike(rx("(?=[cthgp])(?:" + "|".join(fv.CONTACT_INDICATORS) + ")")))


def normalize_phone(phone: Column) -> Column:
    """11 digits as 4-3-4; other forms stay."""
    digits = F.regexp_replace(phone, rx(r"[\s.\-]", ""), "")
    return F.when(
        digits.startswith("0") & (F.length(digits) == 11),
        F.concat_ws(" ", F.substring(digits, 1, 4), F.substring(digits, 5, 3), F.substring(digits, 8, 4)),
    ).otherwise(phone)


def hours_near(text: Column, start: Column) -> Column:
    return let(window(text, start - 100, start + 200), lambda c: F.nullif(F.concat_ws(
        ", ", first_group(c, rx(fv.OPENING_HOURS)), first_group(c, rx(fv.OPENING_DAYS))), F.lit("")))


def contact_methods(text: Column) -> Column:
    """Phones, then official e-mail addresses."""
    names = literal_map({k: v[0] for k, v in fv.HELPLINES.items()})
    phones = [F.transform(spans(text, rx(p), 1, text.contains(sign)), lambda s: let(normalize_phone(s["g1"]), lambda n: F.struct(
        F.lit("phone").alias("type"), n.alias("value"), hours_near(text, s["start"]).alias("hours"),
        F.try_element_at(names, n).alias("name")).cast(METHOD_DDL))) for p, sign in zip(fv.PHONE_PATTERNS, _PHONE_SIGNS)]
    official = F.filter(
        F.when(text.isNotNull(), gated(text.contains("@"), F.regexp_extract_all(text, F.lit(fv.EMAIL), F.lit(1)), "string")),
        lambda e: e.contains("gov.uk") | F.lower(e).contains("hmrc"))
    emails = F.transform(official, lambda e: F.struct(
        F.lit("email").alias("type"), e.alias("value"), F.lit(None).cast("string").alias("hours"),
        F.lit(None).cast("string").alias("name")).cast(METHOD_DDL))
    return F.concat(*phones, emails)


def contact_windows(text: Column) -> Column:
    """50 characters before to 500 after each indicator; the whole text when there is none."""
    found = let(folded(text), lambda low: F.concat(*[
        F.transform(spans(text, rx(p), 0, low.contains(w)), lambda s: around(text, s, 50, 500)) for p, w in zip(fv.CONTACT_INDICATORS, _INDICATOR_WORDS)]))
    return let(found, lambda w: F.when(F.size(w) > 0, w).otherwise(F.array(text)))


def contacts(text: Column) -> Column:
    """One contact per window that holds a phone or address; exact repeats dropped."""
    categories = literal_map({k: v[1] for k, v in fv.HELPLINES.items()})

    def build(w: Column) -> Column:
        def named(methods: Column) -> Column:
            known = F.get(F.filter(methods, lambda m: m["name"].isNotNull()), F.lit(0))
            return F.struct(
                F.coalesce(known["name"], F.lit(fv.CONTACT_DEFAULT_NAME)).alias("service_name"),
                F.try_element_at(categories, known["value"]).alias("service_category"),
                methods.alias("contact_methods"),
                F.when(F.length(w) > 200, F.concat(F.substring(w, 1, 200), F.lit("..."))).otherwise(w).alias("description"))

        return let(contact_methods(w), named)

    rows = F.filter(F.transform(contact_windows(text), build), lambda c: F.size(c["contact_methods"]) > 0)
    # Phones hold a digit and addresses an @; the probe also takes words alone, without which no row is lost.
    return F.when(text.rlike("[0-9@]") & _has_methods(text), F.array_distinct(rows)).otherwise(empty_array(
        f"struct<service_name:string,service_category:string,contact_methods:array<{METHOD_DDL}>,description:string>"))


def contact_rows(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    return explode_rows(df, contacts(F.col(text)), key, pos="item_no")

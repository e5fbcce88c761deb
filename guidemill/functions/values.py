"""Amounts, percentages, tax years, form codes, dates and column types read from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv
from guidemill.functions.matching import empty_array, first_group, rx, strip


def number(text: Column, kind: str = "double") -> Column:
    """Digits with thousands separators to a number; null when nothing is left."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast(kind)


def pound_amount(text: Column) -> Column:
    return number(first_group(text, rx(fv.POUND_AMOUNT, "")))


def pound_amounts(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(rx(fv.POUND_AMOUNT, "")), F.lit(1)), lambda x: number(x))


def percentage(text: Column) -> Column:
    return first_group(text, rx(fv.PERCENT, "")).try_cast("double")


def percentages(text: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(text, F.lit(rx(fv.PERCENT, "")), F.lit(1)), lambda x: x.try_cast("double"))


def _short_span(p: Column) -> Column:
    y2 = F.when(F.length(p["y2"]) == 4, F.right(p["y2"], F.lit(2))).otherwise(p["y2"])
    return F.concat(p["y1"], F.lit("-"), y2)


def _year_spans(text: Column) -> Column:
    """``YYYY-YY`` for spans of two consecutive years."""
    pat = F.lit(rx(fv.YEAR_SPAN, ""))
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, pat, F.lit(1)).alias("y1"), F.regexp_extract_all(text, pat, F.lit(2)).alias("y2"))
    consecutive = F.filter(
        pairs,
        lambda p: (p["y2"].cast("int") % 100) == ((p["y1"].cast("int") + 1) % 100),
    )
    return F.transform(consecutive, _short_span)


def tax_year(text: Column) -> Column:
    """First span of consecutive years, normalised."""
    return F.get(F.when(text.rlike(rx(fv.YEAR_SPAN, "")), _year_spans(text)), F.lit(0))


def tax_years(text: Column) -> Column:
    """Stated years and spans of consecutive years, newest first."""
    pat = F.lit(rx(fv.STATED_YEAR_SPAN))
    stated = F.transform(
        F.arrays_zip(
            F.regexp_extract_all(text, pat, F.lit(1)).alias("y1"),
            F.regexp_extract_all(text, pat, F.lit(2)).alias("y2")),
        _short_span,
    )
    found = F.sort_array(F.array_distinct(F.concat(stated, _year_spans(text))), asc=False)
    return F.when(text.rlike(rx(r"[0-9]{4}[/-][0-9]{2}", "")), found).otherwise(empty_array("string"))


def form_codes(text: Column) -> Column:
    return F.array_distinct(
        F.transform(F.regexp_extract_all(text, F.lit(rx(fv.FORM_CODE)), F.lit(1)), F.upper))


def day_month_year(text: Column) -> Column:
    """First date as struct(day, month, year); null when there is none."""
    p = rx(fv.DAY_MONTH_YEAR)
    return F.when(
        text.rlike(p),
        F.struct(
            F.regexp_extract(text, p, 1).cast("int").alias("day"),
            F.initcap(F.regexp_extract(text, p, 2)).alias("month"),
            F.nullif(F.regexp_extract(text, p, 3), F.lit("")).cast("int").alias("year"),
        ),
    )


def column_type(values: Column) -> Column:
    """currency_gbp, percentage, number or text by majority of the first ten values."""
    sample = F.slice(values, 1, 10)

    def share(pattern: str) -> Column:
        return F.size(F.filter(sample, lambda v: strip(v).rlike(pattern))) > F.size(sample) * 0.5

    return (
        F.when(share(rx(fv.POUND_AMOUNT, "")), "currency_gbp")
        .when(share(rx(fv.PERCENT, "")), "percentage")
        .when(share(rx(r"^[0-9,]+(?:\.[0-9]+)?$", "")), "number")
        .otherwise("text")
    )

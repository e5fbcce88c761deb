"""Deadlines in text: known calendar dates and periods after an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv
from guidemill.functions.matching import (
    contains_any, empty_array, explode_rows, first_at, first_case, first_group, folded, let, literal_strings, rx, spans, window,
)
from guidemill.functions.values import tax_year

DEADLINE_DDL = (
    "struct<deadline_name:string,deadline_type:string,tax_category:string,frequency:string,rule_type:string,"
    "rule_day:int,rule_month:int,rule_value:int,rule_unit:string,description:string,applies_to:array<string>,"
    "penalty_description:string,suggested_reminder_days:int>"
)


def has_deadlines(text: Column) -> Column:
    words = ["deadline", "due", "must", "within", *(m.lower() for m in fv.MONTHS)]
    return contains_any(folded(text), words) & text.rlike(rx(fv.DEADLINE_PROBE))


def _deadline(name, kind, category, frequency, rule_type, day, month, value, unit, description, applies, penalty,
              reminder) -> Column:
    values = [name, kind, category, frequency, rule_type, day, month, value, unit, description, applies, penalty, reminder]
    fields = ["deadline_name", "deadline_type", "tax_category", "frequency", "rule_type", "rule_day", "rule_month",
              "rule_value", "rule_unit", "description", "applies_to", "penalty_description", "suggested_reminder_days"]
    return F.struct(*[v.alias(f) for v, f in zip(values, fields)]).cast(DEADLINE_DDL)


def penalty_near(text: Column, start: Column) -> Column:
    """Penalty wording from 200 characters before to 300 after a position."""
    return let(window(text, start - 200, start + 300), lambda c: F.coalesce(
        *[first_group(c, rx(p), 0) for p in fv.PENALTY_NEAR_DATE]))


def known_deadlines(text: Column) -> Column:
    """Calendar dates with a fixed meaning; "15 April" does not count as "5 April"."""
    none = F.lit(None)

    def of_date(low: Column, key: str, day: int, month: int, name: str, kind: str, category: str, applies: list[str]) -> Column:
        p = rx(r"(?<![0-9])" + key)
        return F.when(low.contains(key) & text.rlike(p), let(first_at(text, p), lambda at: _deadline(
            F.lit(name), F.lit(kind), F.lit(category), F.lit("annual"), F.lit("fixed"), F.lit(day), F.lit(month),
            none, none, F.lit(f"{name} deadline is {day} {fv.MONTHS[month - 1]}"), literal_strings(applies),
            penalty_near(text, at), F.lit(30 if kind == "filing" else 14))))

    return let(folded(text), lambda low: F.array_compact(F.array(*[of_date(low, *d) for d in fv.KNOWN_DEADLINES])))


def relative_deadlines(text: Column) -> Column:
    """``within N days / weeks / months of, after or from``."""
    none = F.lit(None)

    def row(s: Column) -> Column:
        n = s["g1"].try_cast("int")
        unit = F.rtrim(F.lower(s["g2"]), F.lit("s"))
        kind = let(F.lower(window(text, s["start"] - 150, s["end"] + 50)), lambda c: first_case(
            c, [(k, contains_any(c, ws)) for k, ws in fv.RELATIVE_DEADLINE_WORDS], "notification"))
        return _deadline(
            F.concat(F.lit("Within "), n.cast("string"), F.lit(" "), unit, F.lit("s deadline")), kind, F.lit("general"),
            F.lit("event_based"), F.lit("relative"), none, none, n, unit,
            F.concat(F.lit("Must be completed within "), n.cast("string"), F.lit(" "), unit, F.lit("(s)")),
            empty_array("string"), none, F.least((n / 2).cast("int"), F.lit(14)))

    return F.filter(F.transform(spans(text, rx(fv.RELATIVE_DEADLINE), 2, folded(text).contains("within")), row), lambda d: d["rule_value"].isNotNull())


def deadlines(text: Column) -> Column:
    # Dates and periods hold a digit.  What they are made of is looked for one by one, so the probe would only repeat it.
    return F.when(text.rlike("[0-9]"), F.concat(known_deadlines(text), relative_deadlines(text))) \
        .otherwise(empty_array(DEADLINE_DDL))


def deadline_rows(df: DataFrame, key: list[str], text: str = "text", year: Column | None = None) -> DataFrame:
    df = df.withColumn("tax_year", tax_year(F.col(text)) if year is None else year)
    return explode_rows(df, deadlines(F.col(text)), [*key, "tax_year"], pos="item_no")

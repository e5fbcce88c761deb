"""Worked examples: scenario, steps, result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv
from guidemill.functions.matching import (
    empty_array, explode_rows, first_at, first_case, first_group, folded, let, literal_map, rx, spans, squeeze, window,
)
from guidemill.functions.values import number, tax_year

STEP_DDL = "struct<step:int,description:string,calculation:string,result:double>"
EXAMPLE_DDL = (
    "struct<example_name:string,example_category:string,name:string,income:bigint,turnover:bigint,profit:bigint,"
    f"scenario_description:string,steps:array<{STEP_DDL}>,result_value:double,result_label:string,"
    "result_formatted:string,formulas_used:array<string>,tables_used:array<string>,full_text:string>"
)


# A word that every match of a start holds, in pattern order.
_START_WORDS = ["example", "example", "suppose", "say", "consider"]


def has_examples(text: Column) -> Column:
    def test(low: Column) -> Column:
        hit = F.lit(False)
        for p, w in zip(fv.EXAMPLE_STARTS, _START_WORDS):
            hit = hit | (low.contains(w) & text.rlike(rx(p)))
        return hit

    return let(folded(text), test)


def example_windows(text: Column) -> Column:
    """Up to 1500 characters from each start phrase, cut at a later marker past character 100."""

    def cut(w: Column) -> Column:
        ends = [let(first_at(w, rx(p)), lambda at: F.when(at > 100, at)) for p in fv.EXAMPLE_ENDS]
        return F.substring(w, F.lit(1), F.least(F.length(w), *ends))

    return F.transform(let(folded(text), lambda low: F.concat(*[
        F.transform(spans(text, rx(p), 0, low.contains(w)), lambda s: window(text, s["start"], s["start"] + 1500))
        for p, w in zip(fv.EXAMPLE_STARTS, _START_WORDS)])), cut)


def scenario(text: Column) -> Column:
    """struct(name, income, turnover, profit); a later pattern for the same amount wins."""
    amounts: dict[str, list[Column]] = {}
    for key, p in fv.SCENARIO_AMOUNTS:
        amounts.setdefault(key, []).insert(0, number(first_group(text, rx(p)), "bigint"))
    low = F.lower(text)
    name = let(low, lambda t: F.get(F.filter(
        F.array(*[F.lit(n) for n in fv.EXAMPLE_NAMES]), lambda n: F.contains(t, F.lower(n))), F.lit(0)))
    return F.struct(name.alias("name"), *[F.coalesce(*v).alias(k) for k, v in amounts.items()])


def steps(text: Column) -> Column:
    p = F.lit(rx(fv.EXAMPLE_STEP, "ims"))
    found = F.arrays_zip(*[F.regexp_extract_all(text, p, F.lit(i)).alias(f"g{i}") for i in (1, 2, 3)])
    return F.transform(found, lambda s: let(squeeze(s["g3"]), lambda t: F.struct(
        F.coalesce(F.nullif(s["g1"], F.lit("")), s["g2"]).try_cast("int").alias("step"),
        F.substring(t, 1, 200).alias("description"), first_group(t, rx(fv.STEP_CALCULATION, "")).alias("calculation"),
        number(first_group(t, rx(fv.STEP_RESULT, ""))).alias("result")).cast(STEP_DDL)))


def final_result(text: Column) -> Column:
    return F.coalesce(*[number(first_group(text, rx(p))) for p in fv.FINAL_RESULTS])


def category(text: Column) -> Column:
    return let(F.lower(text), lambda t: first_case(t, [(k, t.rlike(rx(p, ""))) for k, p in fv.EXAMPLE_CATEGORIES], "general"))


def _money(amount: Column, label: str) -> Column:
    return F.concat(F.lit("£"), F.format_number(amount, 0), F.lit(label))


def example_name(sc: Column, cat: Column) -> Column:
    amount = F.when(sc["income"].isNotNull(), _money(sc["income"], " income")) \
        .when(sc["profit"].isNotNull(), _money(sc["profit"], " profit")) \
        .when(sc["turnover"].isNotNull(), _money(sc["turnover"], " turnover"))
    lead = F.concat_ws(" - ", sc["name"], amount)
    title = F.coalesce(F.try_element_at(literal_map(fv.EXAMPLE_CATEGORY_TITLES), cat), F.lit("Tax"))
    return F.when(lead != "", F.concat(lead, F.lit(" - "), title, F.lit(" Example"))) \
        .otherwise(F.concat(title, F.lit(" Calculation Example")))


def scenario_sentence(sc: Column) -> Column:
    income = F.when(sc["income"].isNotNull(), _money(sc["income"], ""))
    said = F.concat_ws(" ", sc["name"], F.concat(F.lit("has income of "), income))
    return F.coalesce(F.nullif(said, F.lit("")), F.lit("Example calculation"))


def _mentions(text: Column, table: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.lower(text).contains(k), F.lit(v)) for k, v in table.items()]))


def examples(text: Column) -> Column:
    """Examples with a scenario."""

    def build(w: Column) -> Column:
        parts = F.struct(scenario(w).alias("sc"), category(w).alias("cat"), final_result(w).alias("res"))
        return let(parts, lambda x: F.struct(
            example_name(x["sc"], x["cat"]).alias("example_name"), x["cat"].alias("example_category"),
            x["sc"]["name"].alias("name"), x["sc"]["income"].alias("income"), x["sc"]["turnover"].alias("turnover"),
            x["sc"]["profit"].alias("profit"), scenario_sentence(x["sc"]).alias("scenario_description"),
            steps(w).alias("steps"), x["res"].alias("result_value"),
            F.when(x["res"].isNotNull(), "Tax Due").otherwise("Result not extracted").alias("result_label"),
            F.when(x["res"].isNotNull(), F.concat(F.lit("£"), F.format_number(x["res"], 2))).alias("result_formatted"),
            _mentions(w, fv.EXAMPLE_FORMULAS).alias("formulas_used"), _mentions(w, fv.EXAMPLE_TABLES).alias("tables_used"),
            w.alias("full_text")).cast(EXAMPLE_DDL))

    rows = F.filter(F.transform(example_windows(text), build), lambda e: (
        e["name"].isNotNull() | e["income"].isNotNull() | e["turnover"].isNotNull() | e["profit"].isNotNull()))
    return F.when(has_examples(text), rows).otherwise(empty_array(EXAMPLE_DDL))


def example_rows(df: DataFrame, key: list[str], text: str = "text", year: Column | None = None) -> DataFrame:
    df = df.withColumn("tax_year", tax_year(F.col(text)) if year is None else year)
    return explode_rows(df, examples(F.col(text)), [*key, "tax_year"], pos="item_no")

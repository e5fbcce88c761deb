"""Calculation rules stated in text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv
from guidemill.functions.matching import (
    around, contains_any, empty_array, explode_rows, first_at, first_group, folded, let, literal_strings, rx, spans, squeeze, window,
)
from guidemill.functions.values import number, tax_year
from guidemill.operators.formula_program import INPUT_DDL, STEP_DDL, inputs_of, literal_value, steps_of

FORMULA_DDL = (
    "struct<formula_name:string,formula_type:string,formula_text:string,variables:array<string>,"
    f"formula_logic:string,tables_used:array<string>,context_text:string,inputs:array<{INPUT_DDL}>,steps:array<{STEP_DDL}>>"
)


# Words of the probe that count by themselves.
_PROBE_WORDS = ["formula", "multiply", "divide", "subtract", "add"]
# Words and signs of which every match of a known formula holds one.
_STATED = ["=", "calculated"]


def has_formulas(text: Column) -> Column:
    """``FORMULA_PROBE``, words first; its other parts begin with a word or hold a sign, and are tried where that is found."""
    rest = rx(r"calculated\s+(?:as|by)|=\s*[^=]|[0-9]+/[0-9]+\s*[×x*]")
    return let(folded(text), lambda low: contains_any(low, _PROBE_WORDS) | (contains_any(low, ["calculated", "=", "/"]) & text.rlike(rest)))


def _formula(name, kind, text, variables, logic, tables, context, inputs=None, steps=None) -> Column:
    """A found formula; ``inputs`` and ``steps`` are its definition for :mod:`guidemill.operators.formula_program`."""
    return F.struct(
        name.alias("formula_name"), kind.alias("formula_type"), text.alias("formula_text"),
        variables.alias("variables"), logic.alias("formula_logic"), tables.alias("tables_used"),
        context.alias("context_text"), (empty_array(INPUT_DDL) if inputs is None else inputs).alias("inputs"),
        (empty_array(STEP_DDL) if steps is None else steps).alias("steps")).cast(FORMULA_DDL)


def _first_match(text: Column, pattern: str, before: int, after: int, body, words: list[list[str]]) -> Column:
    """``body(match, context)`` for the first match, null when there is none; every match holds a word of each list of ``words``."""
    p = rx(pattern, "is")

    def at(start: Column) -> Column:
        hit = F.regexp_extract(text, p, 0)
        return let(F.struct(hit.alias("hit"), window(
            text, start - before, start + F.length(hit) + after).alias("context")), lambda m: body(m["hit"], m["context"]))

    def held(low: Column) -> Column:
        found = contains_any(low, words[0])
        for more in words[1:]:
            found = found & contains_any(low, more)
        return found

    return F.when(let(folded(text), held) & text.rlike(p), let(first_at(text, p), at))


def marginal_relief(text: Column) -> Column:
    """Fraction and upper limit of the relief; the limit is the amount inside the statement, else the default."""

    def body(hit: Column, context: Column) -> Column:
        fraction = F.regexp_extract(hit, r"[0-9]+/[0-9]+", 0)
        limit = F.coalesce(number(first_group(hit, r"£([0-9,]+)"), "bigint"), F.lit(fv.DEFAULT_UPPER_LIMIT).cast("bigint"))
        logic = F.to_json(F.struct(
            F.lit("marginal_relief").alias("type"), limit.alias("upper_limit"), fraction.alias("fraction"),
            literal_strings(["subtract: upper_limit, augmented_profits", "divide: taxable_profits, augmented_profits",
                             "multiply: excess, ratio", "multiply: product, fraction"]).alias("steps")))
        label = F.concat(
            F.lit("Marginal Relief = "), fraction, F.lit(" × (£"), F.format_number(limit, 0),
            F.lit(" - Augmented Profits) × (Taxable Profits / Augmented Profits)"))
        return _formula(
            F.lit("Corporation Tax Marginal Relief"), F.lit("marginal_relief"), label,
            literal_strings(["augmented_profits", "taxable_profits", "upper_limit", "fraction"]), logic,
            literal_strings(["Corporation Tax Rates"]), context, inputs_of(*[
                (n, u, limit if n == "upper_limit" else literal_value(fraction) if n == "fraction" else v) for n, u, v in fv.FORMULA_INPUTS["marginal_relief"]]),
            steps_of(*fv.FORMULA_STEPS["marginal_relief"]))

    return _first_match(text, fv.MARGINAL_RELIEF, 200, 200, body, [["/"], ["relief", "profits"]])


def _known(key: str, context: Column) -> Column:
    name, kind, text, variables, logic, table = fv.KNOWN_FORMULAS[key]
    extra = {"uses_table": table} if logic != "simple_multiplication" else {}
    return _formula(
        F.lit(name), F.lit(kind), F.lit(text), literal_strings(variables),
        F.lit(json.dumps({"type": logic, **extra})), literal_strings([table]), context, inputs_of(*fv.FORMULA_INPUTS[key]), steps_of(*fv.FORMULA_STEPS[key]))


def tax_calculation(text: Column) -> Column:
    """Income or corporation tax by the words near the statement; neither gives nothing."""
    return _first_match(text, fv.TAX_CALCULATION, 100, 100, lambda hit, c: F.when(
        F.lower(c).contains("income tax"), _known("income_tax", c)).when(
        F.lower(c).contains("corporation tax"), _known("corporation_tax", c)), [_STATED, ["tax"]])


def penalty_calculation(text: Column) -> Column:
    return _first_match(text, fv.PENALTY_CALCULATION, 100, 100, lambda hit, c: _known("penalty", c), [["penalty", "surcharge"], [*_STATED, "amount"]])


def vat_calculation(text: Column) -> Column:
    return _first_match(text, fv.VAT_CALCULATION, 100, 100, lambda hit, c: _known("vat", c), [_STATED, ["vat"]])


def formula_variables(text: Column) -> Column:
    """Kinds of quantities named in a formula."""
    named = [F.when(text.rlike(rx(p)), F.lit(n)) for n, p in fv.FORMULA_VARIABLES]
    return F.array_compact(F.array(*named))


def generic_formulas(text: Column) -> Column:
    """Sentence and arithmetic patterns of 10 to 300 characters, named from their context."""
    # The third pattern starts at every word and runs to the next mark, so it is tried only where its "=" can be.
    needs = [text.rlike("(?i)calculation|formula|equation"), text.rlike("(?i)calculated"), text.rlike(r"[a-zA-Z\s]="), text.contains("/")]
    out = []
    for pattern, when in zip(fv.GENERIC_FORMULAS, needs):
        p = rx(pattern)

        def row(s: Column) -> Column:
            def named(context: Column) -> Column:
                name = F.coalesce(*[F.initcap(first_group(context, rx(n))) for n in fv.FORMULA_NAMES], F.lit("Calculation"))
                logic = F.to_json(F.struct(F.lit("generic").alias("type"), s["hit"].alias("raw_text")))
                return _formula(name, F.lit("other"), squeeze(s["hit"]), formula_variables(s["hit"]), logic,
                                empty_array("string"), context)

            return let(around(text, s, 100, 100), named)

        hits = F.filter(spans(text, p, 0, when), lambda s: (F.length(s["hit"]) >= 10) & (F.length(s["hit"]) <= 300))
        out.append(F.transform(hits, row))
    return F.concat(*out)


def known_formulas(text: Column) -> Column:
    return F.array_compact(F.array(marginal_relief(text), tax_calculation(text), penalty_calculation(text), vat_calculation(text)))


def formulas(text: Column) -> Column:
    """All kinds; a generic one is dropped when its name or text was already taken.

    Whether one is taken depends on all before it, so the array is folded; names and texts taken are held as plain arrays, which are
    searched without a lambda per element.
    """
    ddl = f"struct<taken:array<{FORMULA_DDL}>,names:array<string>,texts:array<string>>"

    def add(acc: Column, f: Column) -> Column:
        seen = F.array_contains(acc["names"], f["formula_name"]) | F.array_contains(acc["texts"], f["formula_text"])
        return F.when(seen, acc).otherwise(F.struct(
            F.concat(acc["taken"], F.array(f)).alias("taken"), F.concat(acc["names"], F.array(f["formula_name"])).alias("names"),
            F.concat(acc["texts"], F.array(f["formula_text"])).alias("texts")).cast(ddl))

    everything = let(known_formulas(text), lambda known: F.aggregate(generic_formulas(text), F.struct(
        known.alias("taken"), F.transform(known, lambda k: k["formula_name"]).alias("names"), F.transform(known, lambda k: k["formula_text"]).alias("texts")).cast(ddl), add)["taken"])
    # Every formula holds one of these: generic ones a word, "=" or a fraction, known ones the words they are looked for by.
    may = let(folded(text), lambda low: contains_any(low, ["=", "/", "calculat", "formula", "equation", "penalty", "surcharge"]))
    return F.when(may & (has_formulas(text) | text.rlike(rx(r"amounts?\s+to|is\s+calculated|marginal\s+relief|small\s+profits\s+rate|="))),
                  everything).otherwise(empty_array(FORMULA_DDL))


def formula_rows(df: DataFrame, key: list[str], text: str = "text", year: Column | None = None) -> DataFrame:
    y = tax_year(F.col(text)) if year is None else year
    df = df.withColumn("tax_year", y)
    return explode_rows(df, formulas(F.col(text)), [*key, "tax_year"], pos="item_no")

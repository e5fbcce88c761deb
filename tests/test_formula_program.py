"""Stored formulas: compiling, running, faulty definitions."""

import random

import pytest
from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv
from guidemill.operators import formula_program as fp
from guidemill.operators.formulas import formulas, known_formulas


def definitions(spark, *rows):
    out = None
    for key, inputs, steps in rows:
        one = spark.range(1).select(F.lit(key).alias("formula_id"), fp.inputs_of(*inputs).alias("inputs"), fp.steps_of(*steps).alias("steps"))
        out = one if out is None else out.unionByName(one)
    return out


def run(spark, rows, asked):
    compiled = fp.compile_formulas(definitions(spark, *rows))
    requests = spark.createDataFrame([(i, k, g) for i, (k, g) in enumerate(asked)], "request_id int, formula_id int, given map<string,double>")
    return [(r["result"], r["error"]) for r in fp.run_formulas(requests, compiled).orderBy("request_id").collect()]


def test_income_tax_by_steps_and_bands(spark):
    """Taxable income is gross income less the allowance, then the bands: 60,000 gives 6,486 + 7,540 at 40 % above 37,700."""
    bands = fp.bands_of((0, 37700, 20), (37700, 125140, 40), (125140, None, 45))
    rows = [(1, [("gross_income", "currency_gbp", None), ("personal_allowance", "currency_gbp", 12570)],
             [("taxable_income", "subtract", ["gross_income", "personal_allowance"]), ("positive", "maximum", ["taxable_income", "0"]), ("tax", "banded", ["positive"], bands)])]
    assert run(spark, rows, [(1, {"gross_income": 60000.0}), (1, {"gross_income": 10000.0}), (1, {"gross_income": 60000.0, "personal_allowance": 0.0}), (1, {})]) == [
        (37700 * 0.2 + 9730 * 0.4, None), (0.0, None), (37700 * 0.2 + 22300 * 0.4, None), (None, "no value for gross_income")]


@pytest.mark.parametrize("steps, error", [
    ([], "no steps"), ([("a", "power", ["x", "2"])], "unknown operation: power"), ([("a", "add", ["x"])], "wrong number of operands: a"),
    ([("a", "subtract", ["x", "1", "2"])], "wrong number of operands: a"), ([("a", "add", ["x", "y"])], "unknown operand: y"), ([("a", "add", ["x", "12/"])], "unknown operand: 12/"),
    ([("a", "add", ["a", "x"])], "circular steps: a"), ([("a", "add", ["b", "x"]), ("b", "add", ["c", "1"]), ("c", "add", ["a", "1"]), ("d", "add", ["x", "1"])], "circular steps: a, b, c"),
    ([("a", "add", ["x", "1"]), ("a", "add", ["x", "2"])], "a name is defined twice"), ([("x", "add", ["1", "2"])], "a name is defined twice"), ([("a", "banded", ["x"])], "no bands: a")])
def test_faulty_definitions_are_rows(spark, steps, error):
    assert run(spark, [(1, [("x", None, None)], steps), (2, [("x", None, None)], [("y", "add", ["x", "1"])])], [(1, {"x": 1.0}), (2, {"x": 1.0}), (3, {})]) == [
        (None, error), (2.0, None), (None, "unknown formula")]


def test_operations(spark):
    steps = [("add", ["x", "y", "1"], 8.0), ("multiply", ["x", "y", "1/2"], 5.0), ("minimum", ["x", "y"], 2.0), ("maximum", ["x", "y", "7.5"], 7.5), ("subtract", ["x", "y"], 3.0), ("divide", ["x", "y"], 2.5),
             ("percent", ["x", "20"], 1.0), ("multiply", ["x", "20%"], 1.0), ("if_at_least", ["x", "5", "1", "0"], 1.0), ("if_above", ["x", "5", "1", "0"], 0.0), ("round", ["-2.25", "1"], -2.3), ("round", ["x", "0"], 5.0)]
    rows = [(k, [("x", None, 5), ("y", None, 2)], [("r", op, args)]) for k, (op, args, _) in enumerate(steps)]
    assert run(spark, rows, [(k, {}) for k in range(len(steps))]) == [(want, None) for *_, want in steps]
    assert run(spark, [(1, [("x", None, 0)], [("r", "divide", ["1", "x"]), ("s", "add", ["r", "1"])])], [(1, {}), (1, {"x": 4.0, "other": 9.0})]) == [(None, "division by zero: r"), (1.25, None)]


def test_steps_in_any_order_and_repeated_rows(spark):
    pick = random.Random(1)
    chain = [(f"s{k}", "add", [f"s{k - 1}" if k else "x", "1"]) for k in range(40)]
    pick.shuffle(chain)
    rows = [(1, [("x", None, None)], chain)]
    assert run(spark, [*rows, *rows], [(1, {"x": 2.0})]) == [(42.0, None)]
    nothing = definitions(spark, *rows).select("formula_id", F.lit(None).cast(f"array<{fp.INPUT_DDL}>").alias("inputs"), F.lit(None).cast(f"array<{fp.STEP_DDL}>").alias("steps"))
    assert [r["error"] for r in fp.compile_formulas(nothing).collect()] == ["no steps"]
    assert fp.compile_formulas(nothing.limit(0)).count() == 0


def test_worked_steps(spark):
    compiled = fp.compile_formulas(definitions(spark, (1, [("x", None, 3)], [("b", "add", ["a", "1"]), ("a", "multiply", ["x", "2"])])))
    asked = spark.createDataFrame([(1, 1, {})], "request_id int, formula_id int, given map<string,double>")
    assert [tuple(x) for x in fp.run_formulas(asked, compiled, steps=True).first()["worked"]] == [("a", 6.0), ("b", 7.0)]


def test_found_formulas_carry_their_definition(texts):
    rows = texts("Marginal relief is 3/200 × (£240,000 - profits). A late return gets a penalty of £100 plus daily penalties of £10.").select(F.explode(known_formulas(F.col("text"))).alias("f")).select("f.*").collect()
    relief = next(r for r in rows if r["formula_type"] == "marginal_relief")
    assert {i["name"]: (i["unit"], i["value"]) for i in relief["inputs"]} == {"augmented_profits": ("currency_gbp", None), "taxable_profits": ("currency_gbp", None), "upper_limit": ("currency_gbp", 240000.0), "fraction": ("fraction", 0.015)}
    assert [(s["result"], s["operation"], s["operands"]) for s in relief["steps"]] == [
        ("excess", "subtract", ["upper_limit", "augmented_profits"]), ("ratio", "divide", ["taxable_profits", "augmented_profits"]), ("product", "multiply", ["excess", "ratio"]), ("relief", "multiply", ["product", "fraction"])]


def test_every_fixed_formula_compiles(spark):
    rows = [(k, fv.FORMULA_INPUTS[name], fv.FORMULA_STEPS[name]) for k, name in enumerate(fv.FORMULA_STEPS)]
    assert all(r["error"] is None for r in fp.compile_formulas(definitions(spark, *rows)).collect())
    by_name = {n: k for k, n in enumerate(fv.FORMULA_STEPS)}
    asked = [(by_name["income_tax"], {"taxable_income": 22570.0, "tax_rate": 20.0}), (by_name["vat"], {"net_amount": 50.0}), (by_name["penalty"], {"base_penalty": 100.0, "daily_penalty": 10.0, "days_late": 3.0})]
    assert run(spark, rows, asked) == [(2000.0, None), (10.0, None), (130.0, None)]


def test_generic_formulas_are_taken_once_by_name_and_by_text(texts):
    """Whether one is taken depends on those taken before it only."""
    parts = [f"To calculate the {n} use total = {t} minus {t}." for n, t in [("net pay", "abc"), ("net pay", "defg"), ("gross pay", "defg"), ("late fee", "abc")]]
    names = [r["formula_name"] for r in texts(" ".join(f"{p} {'filler words here ' * 12}" for p in parts)).select(F.explode(formulas(F.col("text"))).alias("f")).select("f.*").collect()]
    assert len(names) == len(set(names))

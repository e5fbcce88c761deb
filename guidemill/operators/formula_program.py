"""Stored formulas as programs: definitions are rows, compiled once and run over any number of requests.

A definition names its inputs (with units and default values) and its steps; a step applies an operation to operands and names its
result.  An operand is an input, the result of another step in any order, or a number: ``250000``, ``3/200``, ``20%``.  Compiling
puts steps into an order in which every operand is known and replaces names by places; running folds the program over an
array of values.  Both are column expressions over rows, so definitions of any kind mix in one job, and a definition or request
that cannot be worked out gives an error row instead of failing the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidemill.functions.matching import empty_array, let

BAND_DDL = "struct<lo:double,hi:double,rate:double>"
INPUT_DDL = "struct<name:string,unit:string,value:double>"
STEP_DDL = f"struct<result:string,operation:string,operands:array<string>,bands:array<{BAND_DDL}>>"
PLACED_DDL = f"struct<result:string,operation:string,slots:array<struct<at:int,value:double>>,bands:array<{BAND_DDL}>>"

#: Operation: least and most number of operands (None: any number more).
OPERATIONS = {
    "add": (2, None), "multiply": (2, None), "minimum": (2, None), "maximum": (2, None),
    "subtract": (2, 2), "divide": (2, 2), "percent": (2, 2), "round": (2, 2), "banded": (1, 1),
    "if_at_least": (4, 4), "if_above": (4, 4),
}
_NUMBER = r"^-?[0-9]+(\.[0-9]+)?%?$"
_FRACTION = r"^-?[0-9]+(\.[0-9]+)?/[0-9]+(\.[0-9]+)?$"


def inputs_of(*rows: tuple) -> Column:
    """Inputs from (name, unit, default or None); a default may be a column."""
    made = [F.struct(F.lit(n).alias("name"), F.lit(u).alias("unit"), (v if isinstance(v, Column) else F.lit(v)).cast("double").alias("value")) for n, u, v in rows]
    return F.array(*made).cast(f"array<{INPUT_DDL}>") if made else empty_array(INPUT_DDL)


def steps_of(*rows: tuple) -> Column:
    """Steps from (result, operation, operands[, bands]); an operand may be a string column."""
    made = [F.struct(
        F.lit(r[0]).alias("result"), F.lit(r[1]).alias("operation"), F.array(*[o if isinstance(o, Column) else F.lit(str(o)) for o in r[2]]).alias("operands"),
        (r[3] if len(r) > 3 else F.lit(None)).cast(f"array<{BAND_DDL}>").alias("bands")) for r in rows]
    return F.array(*made).cast(f"array<{STEP_DDL}>") if made else empty_array(STEP_DDL)


def bands_of(*rows: tuple) -> Column:
    """Bands from (from, to or None, rate in percent); each may be a column."""
    def number(v):
        return (v if isinstance(v, Column) else F.lit(v)).cast("double")

    return F.array(*[F.struct(number(lo).alias("lo"), number(hi).alias("hi"), number(rate).alias("rate")) for lo, hi, rate in rows])


def literal_value(operand: Column) -> Column:
    """Number written as an operand, null if it is a name."""
    sides = F.split(operand, "/")
    whole = F.rtrim(operand, F.lit("%")).try_cast("double")
    return F.when(operand.rlike(_NUMBER), F.when(operand.endswith("%"), whole / 100).otherwise(whole)) \
        .when(operand.rlike(_FRACTION), F.try_divide(F.get(sides, F.lit(0)).try_cast("double"), F.get(sides, F.lit(1)).try_cast("double")))


def _faults(names: Column, steps: Column) -> Column:
    """The first thing that keeps a definition from being a program, short of circular steps."""
    results = F.transform(steps, lambda s: s["result"])
    every = F.concat(names, results)
    arity = [(s, least, most) for s, (least, most) in OPERATIONS.items()]

    def wrong_count(s: Column) -> Column:
        bad = F.lit(False)
        for op, least, most in arity:
            size = F.size(s["operands"])
            bad = bad | ((s["operation"] == op) & ((size < least) | (F.lit(False) if most is None else size > most)))
        return bad

    operands = F.flatten(F.transform(steps, lambda s: F.coalesce(s["operands"], empty_array("string"))))
    unknown = F.filter(operands, lambda o: o.isNull() | (literal_value(o).isNull() & ~F.coalesce(F.array_contains(every, o), F.lit(False))))
    strange = F.filter(steps, lambda s: s["operation"].isNull() | ~s["operation"].isin(*OPERATIONS))
    counts = F.filter(steps, wrong_count)
    bare = F.filter(steps, lambda s: (s["operation"] == "banded") & F.coalesce(F.size(s["bands"]) < 1, F.lit(True)))
    first = lambda a, f: F.get(F.transform(a, f), F.lit(0))
    return F.coalesce(
        F.when(F.size(steps) < 1, F.lit("no steps")),
        F.when(F.exists(every, lambda n: n.isNull()), F.lit("a name is missing")),
        F.when(F.size(F.array_distinct(every)) < F.size(every), F.lit("a name is defined twice")),
        F.concat(F.lit("unknown operation: "), first(strange, lambda s: F.coalesce(s["operation"], F.lit("")))),
        F.concat(F.lit("wrong number of operands: "), first(counts, lambda s: s["result"])),
        F.concat(F.lit("no bands: "), first(bare, lambda s: s["result"])),
        F.concat(F.lit("unknown operand: "), first(unknown, lambda o: F.coalesce(o, F.lit("")))))


def compile_formulas(definitions: DataFrame) -> DataFrame:
    """(formula_id, inputs, program, result, error) of rows (formula_id, inputs, steps).

    ``result`` is the last written step that no other step uses.  Steps are placed one after the other, each as soon as all its operands
    are known; steps that never are form a circle.  Missing arrays count as empty; of several rows with one id the first by
    their values is taken.
    """
    rows = definitions.select("formula_id", F.coalesce("inputs", empty_array(INPUT_DDL)).alias("inputs"), F.coalesce("steps", empty_array(STEP_DDL)).alias("steps"))
    once = rows.groupBy("formula_id").agg(F.min_by(F.struct("inputs", "steps"), F.to_json(F.struct("inputs", "steps"))).alias("d")).select("formula_id", "d.*")
    names = F.transform("inputs", lambda i: i["name"])

    def place(acc: Column, _: Column) -> Column:
        ready = F.filter(F.col("steps"), lambda s: ~F.array_contains(acc["names"], s["result"]) & F.forall(
            s["operands"], lambda o: literal_value(o).isNotNull() | F.array_contains(acc["names"], o)))

        def put(s: Column) -> Column:
            slots = F.transform(s["operands"], lambda o: F.struct((F.array_position(acc["names"], o).cast("int") - 1).alias("at"), literal_value(o).alias("value")))
            step = F.struct(s["result"].alias("result"), s["operation"].alias("operation"), slots.alias("slots"), s["bands"].alias("bands")).cast(PLACED_DDL)
            return F.struct(F.concat(acc["names"], F.array(s["result"])).alias("names"), F.concat(acc["program"], F.array(step)).alias("program"))

        return F.when(F.size(ready) > 0, let(F.get(ready, F.lit(0)), put)).otherwise(acc)

    start = F.struct(names.alias("names"), empty_array(PLACED_DDL).alias("program"))
    checked = once.withColumn("_fault", _faults(names, F.col("steps")))
    placed = checked.withColumn("_p", F.when(F.col("_fault").isNull(), F.aggregate("steps", start, place)))
    results, used = F.transform("steps", lambda s: s["result"]), F.flatten(F.transform("steps", lambda s: s["operands"]))
    left = F.filter(results, lambda r: ~F.array_contains(F.col("_p.names"), r))
    ends = F.filter(results, lambda r: ~F.array_contains(used, r))
    return placed.select(
        "formula_id", "inputs", F.col("_p.program").alias("program"), F.try_element_at(ends, F.lit(-1)).alias("result"),
        F.coalesce("_fault", F.when(F.size(left) > 0, F.concat(F.lit("circular steps: "), F.array_join(left, ", ")))).alias("error"))


def banded_amount(value: Column, bands: Column) -> Column:
    """Sum over bands of the part of ``value`` inside the band times its rate (percent); an open band has no end."""
    return F.aggregate(bands, F.lit(0.0), lambda acc, b: acc + F.greatest(F.least(value, F.coalesce(b["hi"], value)) - b["lo"], F.lit(0.0)) * b["rate"] / 100)


def _apply(step: Column, v: Column) -> Column:
    """Value of a step from the values of its operands."""
    a, b = F.get(v, F.lit(0)), F.get(v, F.lit(1))
    third, fourth = F.get(v, F.lit(2)), F.get(v, F.lit(3))
    op, scale = step["operation"], F.pow(F.lit(10.0), b)
    return F.when(op == "add", F.aggregate(v, F.lit(0.0), lambda s, x: s + x)) \
        .when(op == "multiply", F.aggregate(v, F.lit(1.0), lambda s, x: s * x)) \
        .when(op == "minimum", F.array_min(v)).when(op == "maximum", F.array_max(v)) \
        .when(op == "subtract", a - b).when(op == "divide", F.try_divide(a, b)).when(op == "percent", a * b / 100) \
        .when(op == "round", F.signum(a) * F.floor(F.abs(a) * scale + 0.5) / scale).when(op == "banded", banded_amount(a, step["bands"])) \
        .when(op == "if_at_least", F.when(a >= b, third).otherwise(fourth)).when(op == "if_above", F.when(a > b, third).otherwise(fourth))


def run_formulas(requests: DataFrame, compiled: DataFrame, steps: bool = False) -> DataFrame:
    """(request_id, formula_id, result, error) for rows (request_id, formula_id, given map<string,double>).

    A given value replaces the default of its input; names that the formula does not know are ignored.  A missing value, a division
    by zero, a faulty or an unknown formula gives an error and no result.  With ``steps`` the column ``worked`` lists
    (name, value) of all steps in the order they were worked out.
    """
    joined = requests.select("request_id", "formula_id", "given").join(compiled, "formula_id", "left")
    value = lambda i: F.coalesce(F.try_element_at(F.col("given"), i["name"]), i["value"])
    start = F.struct(F.transform("inputs", value).alias("values"), F.lit(None).cast("string").alias("error"))

    def step(acc: Column, s: Column) -> Column:
        taken = F.transform(s["slots"], lambda o: F.coalesce(o["value"], F.get(acc["values"], o["at"])))

        def work(v: Column) -> Column:
            result = F.when(acc["error"].isNull() & ~F.exists(v, lambda x: x.isNull()), _apply(s, v))
            name = F.get(F.transform("inputs", lambda i: i["name"]), F.get(F.filter(s["slots"], lambda o: o["value"].isNull() & F.get(acc["values"], o["at"]).isNull()), F.lit(0))["at"])
            error = F.coalesce(acc["error"], F.when(F.exists(v, lambda x: x.isNull()), F.concat(F.lit("no value for "), name)).when(
                (s["operation"] == "divide") & (F.get(v, F.lit(1)) == 0), F.concat(F.lit("division by zero: "), s["result"])))
            return F.struct(F.concat(acc["values"], F.array(result)).alias("values"), error.alias("error"))

        return let(taken, work)

    ran = joined.withColumn("_r", F.when(F.col("error").isNull() & F.col("program").isNotNull(), F.aggregate("program", start, step)))
    at = F.size("inputs") + F.array_position(F.transform("program", lambda s: s["result"]), F.col("result")).cast("int") - 1
    error = F.coalesce("error", F.when(F.col("program").isNull(), F.lit("unknown formula")), F.col("_r.error"))
    worked = F.when(error.isNull(), F.transform("program", lambda s, i: F.struct(s["result"].alias("name"), F.get(F.col("_r.values"), F.size("inputs") + i).alias("value"))))
    return ran.select("request_id", "formula_id", F.when(error.isNull(), F.get("_r.values", at)).alias("result"), error.alias("error"), *([worked.alias("worked")] if steps else []))


def explain_formulas(definitions: DataFrame) -> DataFrame:
    """One row per step: (formula_id, step_no, result, operation, operands joined by a bar)."""
    return definitions.select("formula_id", F.posexplode_outer("steps").alias("step_no", "s")).where("step_no IS NOT NULL").select(
        "formula_id", "step_no", "s.result", "s.operation", F.array_join("s.operands", "|").alias("operands"))

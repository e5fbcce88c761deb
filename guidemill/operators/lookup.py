"""Lookups over extracted tables, and evaluation of stored rules for many rows at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidemill.functions.matching import let
from guidemill.operators.formula_program import banded_amount  # noqa: F401  also a plain column function


def current_tables(tables: DataFrame, name_part: Column | None = None) -> DataFrame:
    """Per type the table with the latest start (missing last), then the newest."""
    df = tables if name_part is None else tables.where(name_part)
    best = F.max_by(
        F.struct(*[c for c in df.columns if c != "table_type"]),
        F.struct(F.col("effective_from").isNotNull(), F.col("effective_from"), F.col("created_at"), F.col("table_id")))
    return df.groupBy("table_type").agg(best.alias("t")).select("table_type", "t.*")


def lookup_value(requests: DataFrame, cells: DataFrame, lookup_column: str, return_column: str) -> DataFrame:
    """First row of the table whose ``lookup_column`` equals the wanted value: (request_id, result).

    ``requests``: request_id, table_id, wanted.  ``cells``: table_id, row_idx, header, raw.
    """
    rows = cells.where(F.col("header").isin(lookup_column, return_column)).groupBy("table_id", "row_idx").agg(
        F.max(F.when(F.col("header") == lookup_column, F.col("raw"))).alias("wanted"),
        F.max(F.when(F.col("header") == return_column, F.col("raw"))).alias("ret"))
    first = rows.where(F.col("wanted").isNotNull()).groupBy("table_id", "wanted").agg(F.min_by("ret", "row_idx").alias("result"))
    return requests.join(first, ["table_id", "wanted"], "left").select("request_id", "result")


def lookup_range(requests: DataFrame, bands: DataFrame) -> DataFrame:
    """First band with lo <= value and (hi missing or value <= hi): (request_id, result).

    ``requests``: request_id, table_id, value.  ``bands``: table_id, row_idx, lo, hi, result.  Bands of
    one table come from one document, so a request meets few of them; requests of a hot table are
    split by the broadcast or by the adaptive skew join.
    """
    b = bands.withColumnRenamed("table_id", "_t")
    hit = requests.join(
        b, (F.col("table_id") == F.col("_t")) & (F.col("value") >= F.col("lo"))
        & (F.col("hi").isNull() | (F.col("value") <= F.col("hi"))), "left")
    return hit.groupBy("request_id").agg(F.min_by("result", "row_idx").alias("result"))


def walk_trees(cases: DataFrame, trees: DataFrame) -> DataFrame:
    """Walk a decision tree per case: path, outcome, action, severity.

    ``cases``: case_id, tree_id, answers map<string,double>.  ``trees``: tree_id, entry_node_id, nodes
    array<struct<id,type,variable,operator,value,yes_next,no_next,result,text,severity,action_required>>.
    The walk is a fold over at most as many steps as there are nodes; an unanswered question ends it.
    """
    joined = cases.join(trees, "tree_id")

    def node(nodes: Column, id_: Column) -> Column:
        return F.get(F.filter(nodes, lambda n: n["id"] == id_), F.lit(0))

    def step(acc: Column, _: Column) -> Column:
        def move(n: Column) -> Column:
            answer = F.try_element_at(F.col("answers"), n["variable"])
            nxt = F.when(answer.isNull(), F.lit(None).cast("string")) \
                .when(holds(answer, n["operator"], n["value"]), n["yes_next"]).otherwise(n["no_next"])
            return F.struct(
                F.when(n["type"] == "question", nxt).alias("at"),
                F.concat(acc["path"], F.array(acc["at"])).alias("path"),
                F.when(n["type"] == "outcome", acc["at"]).otherwise(acc["end"]).alias("end"))

        return F.when(acc["at"].isNull(), acc).otherwise(let(node(F.col("nodes"), acc["at"]), move))

    walked = F.aggregate(
        F.sequence(F.lit(1), F.size("nodes")),
        F.struct(F.col("entry_node_id").alias("at"), F.array().cast("array<string>").alias("path"),
                 F.lit(None).cast("string").alias("end")).cast("struct<at:string,path:array<string>,end:string>"),
        step)
    out = joined.withColumn("_w", walked).withColumn("_n", node(F.col("nodes"), F.col("_w.end")))
    return out.select(
        "case_id", "tree_id", F.col("_w.path").alias("path_taken"), F.col("_n.result").alias("final_outcome"),
        F.col("_n.text").alias("outcome_text"), F.coalesce("_n.action_required", F.lit(False)).alias("action_required"),
        F.col("_n.severity").alias("severity"))


def holds(value: Column, operator: Column, threshold: Column) -> Column:
    """Comparison named by a column."""
    return F.when(operator == ">", value > threshold).when(operator == ">=", value >= threshold) \
        .when(operator == "<", value < threshold).when(operator == "<=", value <= threshold) \
        .when(operator == "==", value == threshold).when(operator == "!=", value != threshold).otherwise(F.lit(False))


def deadline_dates(requests: DataFrame, as_of: Column) -> DataFrame:
    """Date of a deadline, days left, overdue.

    ``requests`` holds the rule (rule_type, rule_day, rule_month, rule_value, rule_unit) with a tax_year
    for fixed rules or an event_date for relative ones.  A fixed rule means the first such day on or
    after the end of the tax year (5 April).
    """
    end_year = F.left("tax_year", F.lit(4)).cast("int") + 1
    same_year = F.make_date(end_year, F.col("rule_month"), F.col("rule_day"))
    year_end = F.make_date(end_year, F.lit(4), F.lit(5))
    fixed = F.when(same_year >= year_end, same_year).otherwise(F.make_date(end_year + 1, F.col("rule_month"), F.col("rule_day")))
    relative = F.when(F.col("rule_unit") == "day", F.date_add("event_date", F.col("rule_value"))) \
        .when(F.col("rule_unit") == "week", F.date_add("event_date", F.col("rule_value") * 7)) \
        .when(F.col("rule_unit") == "month", F.add_months("event_date", F.col("rule_value")))
    df = requests.withColumn("calculated_date", F.when(F.col("rule_type") == "fixed", fixed).otherwise(relative))
    df = df.withColumn("days_remaining", F.datediff("calculated_date", as_of))
    return df.withColumn("is_overdue", F.coalesce(F.col("days_remaining") < 0, F.lit(False)))


def evaluate_conditions(requests: DataFrame, lists: DataFrame) -> DataFrame:
    """Evaluate condition lists: ids met and not met, overall result, outcome.

    ``requests``: request_id, list_id, answers map<string,double>.  ``lists``: list_id, logical_operator,
    conditions array<struct<id,variable,operator,threshold>>, outcome_if_met, outcome_if_not_met.
    A value that is not given does not meet its condition.
    """
    def met(c: Column) -> Column:
        return F.coalesce(holds(F.try_element_at(F.col("answers"), c["variable"]), c["operator"], c["threshold"]), F.lit(False))

    df = requests.join(lists, "list_id")
    df = df.withColumn("conditions_met", F.transform(F.filter("conditions", met), lambda c: c["id"]))
    df = df.withColumn("conditions_not_met", F.array_except(F.transform("conditions", lambda c: c["id"]), F.col("conditions_met")))
    overall = F.when(F.col("logical_operator") == "AND", F.size("conditions_not_met") == 0) \
        .when(F.col("logical_operator") == "AND_NOT", F.size("conditions_met") == 0).otherwise(F.size("conditions_met") > 0)
    df = df.withColumn("overall_result", overall)
    return df.withColumn("outcome", F.when(F.col("overall_result"), F.col("outcome_if_met")).otherwise(F.col("outcome_if_not_met"))) \
        .select("request_id", "list_id", "conditions_met", "conditions_not_met", "overall_result", "outcome")


def marginal_relief(profits: Column, augmented: Column, upper_limit: Column, numerator: Column, denominator: Column) -> Column:
    """(upper limit - augmented profits) x (profits / augmented profits) x fraction, zero above the limit."""
    return F.when(augmented >= upper_limit, F.lit(0.0)).otherwise(
        (upper_limit - augmented) * (profits / augmented) * (numerator / denominator))


def tiered_penalty(base: Column, daily: Column, days_late: Column) -> Column:
    return F.when(days_late > 0, base + daily * days_late).otherwise(F.lit(0.0))


def entry_nodes(trees: DataFrame) -> DataFrame:
    """Entry node of each tree."""
    return trees.select("tree_id", F.get(F.filter("nodes", lambda n: n["id"] == F.col("entry_node_id")), F.lit(0)).alias("node")) \
        .select("tree_id", "node.*")


def first_phone(contacts: DataFrame, key: str) -> DataFrame:
    """Primary phone of each contact."""
    phone = F.get(F.filter("contact_methods", lambda m: m["type"] == "phone"), F.lit(0))["value"]
    return contacts.select(key, phone.alias("phone"))

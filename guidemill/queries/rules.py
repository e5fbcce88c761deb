"""Lookups over tables, decision trees, deadlines, condition lists, stored formulas, vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from guidemill.operators import formula_program as fp
from guidemill.operators import lookup, similarity, vector_index
from guidemill.sources.tables import read_table, spread

# --- table lookups: customers hold a five-band price table, orders ask it -------------------------------

_BANDS = ["c_custkey AS table_id", "b AS row_idx", "b * 100000.0 AS lo", "CASE WHEN b < 4 THEN b * 100000.0 + 90000 END AS hi",
          "cast(c_nationkey + b * 10 as bigint) AS result"]
_BANDS_SQL = f"bands AS (SELECT {', '.join(_BANDS)} FROM customer, (SELECT unnest(range(0, 5)) AS b))"


def _bands(spark, path):
    c = read_table(spark, path, "customer").select("c_custkey", "c_nationkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("b"))
    return c.selectExpr(*_BANDS)


def range_lookup(spark, path):
    """Rate of each order's amount in the band table of its customer; amounts between bands get none."""
    o = read_table(spark, path, "orders").selectExpr("o_orderkey AS request_id", "o_custkey AS table_id", "o_totalprice AS value")
    return lookup.lookup_range(o, _bands(spark, path))


def value_lookup(spark, path):
    """Cell next to a wanted value: table per nation, one row per customer and segment."""
    c = read_table(spark, path, "customer").selectExpr("c_nationkey AS table_id", "c_custkey AS row_idx", "c_mktsegment", "c_name")
    cells = c.selectExpr("table_id", "row_idx", "stack(2, 'Segment', c_mktsegment, 'Name', c_name) AS (header, raw)")
    s = read_table(spark, path, "orders").selectExpr(
        "o_orderkey AS request_id", "cast(o_custkey % 25 as int) AS table_id",
        "CASE o_orderstatus WHEN 'F' THEN 'MACHINERY' WHEN 'O' THEN 'HOUSEHOLD' ELSE 'NOTHING' END AS wanted")
    return lookup.lookup_value(s, cells, "Segment", "Name")


# --- decision trees: one registration tree per nation, customers are the cases -----------------------------

def _trees(spark, path):
    node = lambda **k: F.struct(*[
        (k.get(f, F.lit(None)) if not isinstance(k.get(f), (str, float, bool)) else F.lit(k[f])).cast(t).alias(f)
        for f, t in (("id", "string"), ("type", "string"), ("variable", "string"), ("operator", "string"), ("value", "double"), ("yes_next", "string"),
                     ("no_next", "string"), ("result", "string"), ("text", "string"), ("severity", "string"), ("action_required", "boolean"))])
    n = read_table(spark, path, "nation")
    nodes = F.array(
        node(id="q1", type="question", variable="guests", operator=">", value=F.lit(3000) + F.col("n_nationkey") * 100, yes_next="o1", no_next="q2"),
        node(id="q2", type="question", variable="late_guests", operator=">", value=500.0, yes_next="o2", no_next="o3"),
        node(id="o1", type="outcome", result="book_hall", text="Book the large hall", severity="mandatory", action_required=True),
        node(id="o2", type="outcome", result="book_tent", text="Order a tent today", severity="urgent", action_required=True),
        node(id="o3", type="outcome", result="stay_outside", text="Meet outside", severity="info", action_required=False))
    return n.select(F.col("n_nationkey").alias("tree_id"), F.lit("q1").alias("entry_node_id"), nodes.alias("nodes"), "n_name")


def decision_walks(spark, path):
    cases = read_table(spark, path, "customer").select(
        F.col("c_custkey").alias("case_id"), F.col("c_nationkey").alias("tree_id"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.create_map(F.lit("guests"), F.col("c_acctbal")))
        .otherwise(F.create_map(F.lit("guests"), F.col("c_acctbal"), F.lit("late_guests"), F.col("c_acctbal") / 2)).alias("answers"))
    w = lookup.walk_trees(cases, _trees(spark, path))
    return w.select("case_id", F.array_join("path_taken", ">").alias("path"), "final_outcome", "action_required", "severity")


_WALK_SQL = """SELECT case_id, CASE o WHEN 1 THEN 'q1>o1' WHEN 2 THEN 'q1>q2>o2' WHEN 3 THEN 'q1>q2>o3' ELSE 'q1>q2' END AS path,
  CASE o WHEN 1 THEN 'book_hall' WHEN 2 THEN 'book_tent' WHEN 3 THEN 'stay_outside' END AS final_outcome,
  o IN (1, 2) AS action_required, CASE o WHEN 1 THEN 'mandatory' WHEN 2 THEN 'urgent' WHEN 3 THEN 'info' END AS severity
FROM (SELECT c_custkey AS case_id, CASE WHEN c_acctbal > 3000 + c_nationkey * 100 THEN 1 WHEN c_mktsegment = 'MACHINERY' THEN 0
  WHEN c_acctbal / 2 > 500 THEN 2 ELSE 3 END AS o FROM customer)"""


def decision_entry_nodes(spark, path):
    return lookup.entry_nodes(_trees(spark, path)).select("tree_id", F.col("id").alias("node_id"), "variable", "value")


def decision_trees_by_name(spark, path):
    from guidemill.operators.store import name_contains

    return _trees(spark, path).where(name_contains("n_name", "a")).select("tree_id")


# --- deadlines ------------------------------------------------------------------------------------------------

def deadline_dates(spark, path):
    """A fixed deadline by the order's tax year, or one relative to the order date."""
    year = F.year("o_orderdate")
    o = read_table(spark, path, "orders").select(
        F.col("o_orderkey").alias("deadline_id"), F.when(F.col("o_orderstatus") == "F", "fixed").otherwise("relative").alias("rule_type"),
        (1 + F.col("o_orderkey") % 28).cast("int").alias("rule_day"), (1 + F.col("o_custkey") % 12).cast("int").alias("rule_month"),
        (1 + F.col("o_orderkey") % 40).cast("int").alias("rule_value"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "day").when(F.col("o_orderpriority") == "2-HIGH", "week").otherwise("month").alias("rule_unit"),
        F.concat(year.cast("string"), F.lit("-"), F.right((year + 1).cast("string"), F.lit(2))).alias("tax_year"), F.to_date("o_orderdate").alias("event_date"))
    d = lookup.deadline_dates(o, F.lit("1997-06-30").cast("date"))
    return d.select("deadline_id", F.date_format("calculated_date", "yyyy-MM-dd").alias("calculated"), F.col("days_remaining").cast("bigint").alias("days_remaining"), "is_overdue")


_DEADLINE_SQL = """WITH a AS (SELECT *, CAST(year(o_orderdate) + 1 AS BIGINT) AS y, 1 + o_orderkey % 28 AS d, 1 + o_custkey % 12 AS m, CAST(1 + o_orderkey % 40 AS INT) AS n FROM orders),
b AS (SELECT o_orderkey AS deadline_id, CASE WHEN o_orderstatus = 'F' THEN
    CASE WHEN make_date(y, m, d) >= make_date(y, 4, 5) THEN make_date(y, m, d) ELSE make_date(y + 1, m, d) END
  WHEN o_orderpriority = '1-URGENT' THEN CAST(o_orderdate AS DATE) + n WHEN o_orderpriority = '2-HIGH' THEN CAST(o_orderdate AS DATE) + 7 * n
  ELSE CAST(CAST(o_orderdate AS DATE) + to_months(n) AS DATE) END AS c FROM a)
SELECT deadline_id, strftime(c, '%Y-%m-%d') AS calculated, datediff('day', DATE '1997-06-30', c) AS days_remaining, c < DATE '1997-06-30' AS is_overdue FROM b"""


# --- condition lists ----------------------------------------------------------------------------------------------

def _condition_lists(spark, path):
    cond = lambda i, v, op, t: F.struct(F.lit(i).alias("id"), F.lit(v).alias("variable"), F.lit(op).alias("operator"), t.cast("double").alias("threshold"))
    n = read_table(spark, path, "nation")
    return n.select(
        F.col("n_nationkey").alias("list_id"), F.when(F.col("n_regionkey") < 2, "AND").when(F.col("n_regionkey") < 4, "OR").otherwise("AND_NOT").alias("logical_operator"),
        F.array(cond("a", "balance", ">", F.col("n_nationkey") * 200), cond("b", "key", "<=", F.lit(700)), cond("c", "missing", "==", F.lit(1))).alias("conditions"),
        F.lit("You must register").alias("outcome_if_met"), F.lit("You may register").alias("outcome_if_not_met"))


def condition_evaluations(spark, path):
    r = read_table(spark, path, "customer").select(
        F.col("c_custkey").alias("request_id"), F.col("c_nationkey").alias("list_id"),
        F.create_map(F.lit("balance"), F.col("c_acctbal"), F.lit("key"), F.col("c_custkey").cast("double")).alias("answers"))
    e = lookup.evaluate_conditions(r, _condition_lists(spark, path))
    return e.select("request_id", F.array_join("conditions_met", "|").alias("met"), F.array_join("conditions_not_met", "|").alias("not_met"),
                    "overall_result", "outcome")


_EVAL_SQL = """WITH a AS (SELECT c_custkey AS request_id, c_acctbal > n_nationkey * 200 AS a, c_custkey <= 700 AS b, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey),
b AS (SELECT *, CASE WHEN r < 2 THEN false WHEN r < 4 THEN a OR b ELSE NOT (a OR b) END AS overall_result FROM a)
SELECT request_id, concat_ws('|', CASE WHEN a THEN 'a' END, CASE WHEN b THEN 'b' END) AS met,
  concat_ws('|', CASE WHEN NOT a THEN 'a' END, CASE WHEN NOT b THEN 'b' END, 'c') AS not_met, overall_result,
  CASE WHEN overall_result THEN 'You must register' ELSE 'You may register' END AS outcome FROM b"""


# --- stored formulas ------------------------------------------------------------------------------------------------

def formula_results(spark, path):
    """Marginal relief, banded tax, simple rate and tiered penalty on the amounts of orders."""
    o = read_table(spark, path, "orders")
    p = F.col("o_totalprice")
    bands = F.array(*[F.struct(F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"), F.lit(r).cast("double").alias("rate"))
                      for lo, hi, r in ((0, 50000, 0), (50000, 150000, 20), (150000, None, 40))])
    return o.select(
        "o_orderkey", F.round(lookup.marginal_relief(p, p + 10000, F.lit(250000.0), F.lit(3), F.lit(200)), 2).alias("relief"),
        F.round(lookup.banded_amount(p, bands), 2).alias("banded"), F.round(p * 0.25, 1).alias("simple"),
        lookup.tiered_penalty(F.lit(100.0), F.lit(10.0), (F.col("o_custkey") % 30 - 10).cast("double")).alias("penalty"))


_FORMULA_SQL = """SELECT o_orderkey, round(CASE WHEN p + 10000 >= 250000 THEN 0.0 ELSE (CAST(250000 AS DOUBLE) - (p + 10000)) * (p / (p + 10000)) * (CAST(3 AS DOUBLE) / 200) END, 2) AS relief,
  round(greatest(least(p, CAST(150000 AS DOUBLE)) - 50000, 0) * 20 / 100 + greatest(p - 150000, 0) * 40 / 100, 2) AS banded, round(p * CAST(0.25 AS DOUBLE), 1) AS simple,
  CASE WHEN o_custkey % 30 - 10 > 0 THEN CAST(100 + 10 * (o_custkey % 30 - 10) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS penalty FROM (SELECT *, o_totalprice AS p FROM orders)"""


def _definitions(spark, path):
    """A formula per nation, of seven kinds whose amounts follow from its keys; steps are not in order, two kinds are faulty."""
    n = F.col("n_nationkey")
    kinds = [
        (fp.inputs_of(("upper_limit", "currency_gbp", 200000 + n * 10000), ("profits", "currency_gbp", None), ("augmented", "currency_gbp", None)),
         fp.steps_of(("relief", "multiply", ["product", "3/200"]), ("product", "multiply", ["excess", "ratio"]), ("ratio", "divide", ["profits", "augmented"]),
                     ("excess", "maximum", ["difference", "0"]), ("difference", "subtract", ["upper_limit", "augmented"]))),
        (fp.inputs_of(("profits", "currency_gbp", None)),
         fp.steps_of(("tax", "banded", ["profits"], fp.bands_of((0, 50000, 0), (50000, 100000 + n * 5000, 20), (100000 + n * 5000, None, 40))))),
        (fp.inputs_of(("profits", "currency_gbp", None), ("rate", "percentage", n)), fp.steps_of(("tax", "percent", ["profits", "rate"]))),
        (fp.inputs_of(("base", "currency_gbp", 100), ("daily", "currency_gbp", n), ("days", "number", None)),
         fp.steps_of(("penalty", "if_above", ["days", "0", "total", "0"]), ("total", "add", ["base", "per_day"]), ("per_day", "multiply", ["daily", "days"]))),
        (fp.inputs_of(("augmented", "currency_gbp", None), ("days", "number", None)), fp.steps_of(("each", "divide", ["augmented", "days"]), ("short", "round", ["each", "1"]))),
        (fp.inputs_of(("profits", "currency_gbp", None)), fp.steps_of(("a", "add", ["b", "profits"]), ("b", "add", ["a", "1"]))),
        (fp.inputs_of(("profits", "currency_gbp", None)), fp.steps_of(("a", "add", ["losses", "profits"])))]
    pick = lambda k: F.element_at(F.array(*[d[k] for d in kinds]), (n % len(kinds) + 1).cast("int"))
    return read_table(spark, path, "nation").select(n.alias("formula_id"), pick(0).alias("inputs"), pick(1).alias("steps"))


def stored_formula_results(spark, path):
    """Every order asks the formula of a nation: seven kinds in one job, with what cannot be worked out as error rows."""
    days = (F.col("o_custkey") % 30 - 10).cast("double")
    asked = read_table(spark, path, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderkey") % 11 == 0, F.lit(99)).otherwise(F.col("o_custkey") % 25).cast("int").alias("formula_id"),
        F.map_filter(F.create_map(F.lit("profits"), F.col("o_totalprice"), F.lit("augmented"), F.col("o_totalprice") + 10000, F.lit("days"), days),
                     lambda k, v: (k != "days") | (F.col("o_orderpriority") != "5-LOW")).alias("given"))
    ran = fp.run_formulas(asked, fp.compile_formulas(_definitions(spark, path)))
    return ran.select("request_id", "formula_id", F.round("result", 6).alias("result"), "error")


def formula_checks(spark, path):
    """What each stored formula returns, and why it cannot be worked out."""
    return fp.compile_formulas(_definitions(spark, path)).select("formula_id", "result", "error", F.size("program").alias("placed"))


def formula_steps(spark, path):
    return fp.explain_formulas(_definitions(spark, path))


_STORED_SQL = """WITH a AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 11 = 0 THEN 99 ELSE o_custkey % 25 END AS f, o_totalprice AS p, o_totalprice + 10000 AS g,
  CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_custkey % 30 - 10 AS DOUBLE) END AS d FROM orders),
b AS (SELECT *, CAST(f AS DOUBLE) AS n, CASE WHEN f = 99 THEN 7 ELSE f % 7 END AS k FROM a)
SELECT request_id, CAST(f AS INT) AS formula_id, round(CASE k WHEN 0 THEN greatest(200000 + n * 10000 - g, 0) * (p / g) * (CAST(3 AS DOUBLE) / 200)
    WHEN 1 THEN greatest(least(p, 100000 + n * 5000) - 50000, 0) * 20 / 100 + greatest(p - (100000 + n * 5000), 0) * 40 / 100 WHEN 2 THEN p * n / 100
    WHEN 3 THEN CASE WHEN d > 0 THEN 100 + n * d WHEN d <= 0 THEN 0 END WHEN 4 THEN CASE WHEN d <> 0 THEN sign(g / d) * floor(abs(g / d) * 10 + 0.5) / 10 END END, 6) AS result,
  CASE k WHEN 3 THEN CASE WHEN d IS NULL THEN 'no value for days' END WHEN 4 THEN CASE WHEN d IS NULL THEN 'no value for days' WHEN d = 0 THEN 'division by zero: each' END
    WHEN 5 THEN 'circular steps: a, b' WHEN 6 THEN 'unknown operand: losses' WHEN 7 THEN 'unknown formula' END AS error FROM b"""
_CHECKS_SQL = """SELECT n_nationkey AS formula_id, ['relief', 'tax', 'tax', 'penalty', 'short', NULL, 'a'][n_nationkey % 7 + 1] AS result,
  CASE n_nationkey % 7 WHEN 5 THEN 'circular steps: a, b' WHEN 6 THEN 'unknown operand: losses' END AS error, CAST([5, 1, 1, 3, 2, 0, NULL][n_nationkey % 7 + 1] AS INT) AS placed FROM nation"""
_STEPS_ROWS_SQL = """SELECT n_nationkey AS formula_id, CAST(i AS INT) AS step_no, result, operation, operands FROM nation JOIN (VALUES
  (0, 0, 'relief', 'multiply', 'product|3/200'), (0, 1, 'product', 'multiply', 'excess|ratio'), (0, 2, 'ratio', 'divide', 'profits|augmented'), (0, 3, 'excess', 'maximum', 'difference|0'),
  (0, 4, 'difference', 'subtract', 'upper_limit|augmented'), (1, 0, 'tax', 'banded', 'profits'), (2, 0, 'tax', 'percent', 'profits|rate'), (3, 0, 'penalty', 'if_above', 'days|0|total|0'),
  (3, 1, 'total', 'add', 'base|per_day'), (3, 2, 'per_day', 'multiply', 'daily|days'), (4, 0, 'each', 'divide', 'augmented|days'), (4, 1, 'short', 'round', 'each|1'),
  (5, 0, 'a', 'add', 'b|profits'), (5, 1, 'b', 'add', 'a|1'), (6, 0, 'a', 'add', 'losses|profits')) AS v(k, i, result, operation, operands) ON k = n_nationkey % 7"""


# --- vector search -------------------------------------------------------------------------------------------------------

def nearest_vectors(spark, path):
    """Ten nearest vectors to the mean vector of each label."""
    v = spread(read_table(spark, path, "embeddings"), "vec_id")
    n = similarity.nearest(v, similarity.centroids(v, "label"), 10)
    return n.select(F.col("query_id").cast("bigint").alias("label"), "vec_id", F.round("score", 3).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def nearest_vectors_filtered(spark, path):
    """Same, among the vectors of one label only."""
    v = spread(read_table(spark, path, "embeddings"), "vec_id")
    n = similarity.nearest(v.where("label = 1"), similarity.centroids(v, "label"), 5)
    return n.select(F.col("query_id").cast("bigint").alias("label"), "vec_id", F.col("rank").cast("bigint").alias("rank"))


def _asking(v):
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def vector_search_exact(spark, path):
    """Ten nearest vectors of every fiftieth vector, itself among them, by comparing all."""
    v = spread(read_table(spark, path, "embeddings"), "vec_id")
    return vector_index.search_exact(v, _asking(v)).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def vector_search(spark, path):
    """Same through the index, over the vectors of the labels up to 5; a higher label counts a little more in the rerank score."""
    v = spread(read_table(spark, path, "embeddings"), "vec_id")
    index = vector_index.build_index(v)
    return vector_index.search(index, v, _asking(v), where=F.col("label") <= 5, rerank=F.col("score") + F.col("label") * 0.001)


def _nearest_sql(where: str, k: int, score: bool) -> str:
    return f"""WITH x AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i) GROUP BY 1, 2),
q AS (SELECT label, list(m ORDER BY i) AS c FROM x GROUP BY 1),
s AS (SELECT q.label, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) AS s FROM embeddings e, q WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM s)
SELECT CAST(label AS BIGINT) AS label, vec_id, {'round(s, 3) AS score, ' if score else ''}rank FROM r WHERE rank <= {k}"""


QUERIES = {
    "range_lookup": (range_lookup, f"WITH {_BANDS_SQL} SELECT o_orderkey AS request_id, arg_min(result, row_idx) AS result FROM orders LEFT JOIN bands ON table_id = o_custkey AND o_totalprice >= lo AND (hi IS NULL OR o_totalprice <= hi) GROUP BY 1"),
    "value_lookup": (value_lookup, """WITH f AS (SELECT c_nationkey AS t, c_mktsegment AS w, arg_min(c_name, c_custkey) AS result FROM customer GROUP BY 1, 2)
SELECT o_orderkey AS request_id, result FROM orders LEFT JOIN f ON t = o_custkey % 25 AND w = CASE o_orderstatus WHEN 'F' THEN 'MACHINERY' WHEN 'O' THEN 'HOUSEHOLD' ELSE 'NOTHING' END"""),
    "decision_walks": (decision_walks, _WALK_SQL),
    "decision_entry_nodes": (decision_entry_nodes, "SELECT n_nationkey AS tree_id, 'q1' AS node_id, 'guests' AS variable, CAST(3000 + n_nationkey * 100 AS DOUBLE) AS value FROM nation"),
    "decision_trees_by_name": (decision_trees_by_name, "SELECT n_nationkey AS tree_id FROM nation WHERE n_name ILIKE '%a%'"),
    "deadline_dates": (deadline_dates, _DEADLINE_SQL),
    "condition_evaluations": (condition_evaluations, _EVAL_SQL),
    "formula_results": (formula_results, _FORMULA_SQL),
    "stored_formula_results": (stored_formula_results, _STORED_SQL),
    "formula_checks": (formula_checks, _CHECKS_SQL),
    "formula_steps": (formula_steps, _STEPS_ROWS_SQL),
    "nearest_vectors": (nearest_vectors, _nearest_sql("true", 10, True)),
    "nearest_vectors_filtered": (nearest_vectors_filtered, _nearest_sql("e.label = 1", 5, False)),
    "vector_search_exact": (vector_search_exact, """SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 10"""),
    "vector_search": (vector_search, None),
}

"""Shared inputs of the registered queries.

The invented prose of the test tables holds no tax words, so ``guidance`` appends guidance
paragraphs whose amounts, dates, ids and forms derive from each document's own columns.  The
expression is plain SQL that Spark and DuckDB both read; only thousands separators differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guidemill.sources.tables import read_table, spread

_MONTH = "CASE doc_id % 4 WHEN 0 THEN 'March' WHEN 1 THEN 'June' WHEN 2 THEN 'September' ELSE 'January' END"
_FAMILY = "CASE doc_id % 5 WHEN 0 THEN 'VATREG' WHEN 1 THEN 'BIM' WHEN 2 THEN 'EIM' WHEN 3 THEN 'CG' ELSE 'TSEM' END"
_YEAR = "(2019 + doc_id % 6)"
_SPAN = f"cast({_YEAR} as string) || '-' || lpad(cast(({_YEAR} + 1) % 100 as string), 2, '0')"

# One (condition, text) per paragraph; {money:expr} is an amount with thousands separators.
PARAGRAPHS = [
    ("doc_id % 2 = 0",
     f"'Tax year ' || {_SPAN} || '. The registration threshold: £' || {{money:50000 + n_chars * 13}} || "
     "' for a limited company. If taxable turnover exceeds £' || {money:12000 + n_chars} || "
     "', use form VAT1 or SA100. Personal allowance: £' || {money:12000 + n_chars} || "
     f"'. You must file the return by ' || cast(1 + doc_id % 28 as string) || ' ' || {_MONTH} || ' and pay by 31 January.'"),
    ("doc_id % 3 <> 0",
     f"'For more see ' || {_FAMILY} || lpad(cast((doc_id * 37) % 100000 as string), 5, '0') || ' and ctm01500. "
     "As explained in section 3.' || cast(doc_id % 9 as string) || ' the Finance Act ' || "
     f"cast({_YEAR} as string) || ' applies under SI ' || cast({_YEAR} as string) || '/' || "
     "cast(100 + doc_id % 900 as string) || '. \"Taxable supply\" means a supply of goods.'"),
    ("doc_id % 3 = 0",
     "'You must register for VAT if:' || chr(10) || '(a) turnover exceeds £' || {money:50000 + n_chars * 13} || "
     "' in a year' || chr(10) || '(b) you expect £' || {money:12000 + n_chars} || ' in 30 days' || chr(10) || "
     "'(c) growth is over ' || cast(doc_id % 50 as string) || '%' || chr(10) || chr(10) || 'The rest of the rule follows.'"),
    ("doc_id % 4 = 1",
     "'Example: Sarah earns £' || {money:20000 + n_chars} || ' and pays income tax.' || chr(10) || "
     "'Step 1: Deduct ' || {money:20000 + n_chars} || ' - 12,570 = £' || {money:7430 + n_chars} || chr(10) || "
     "'Total tax: £' || {money:n_chars}"),
    ("doc_id % 5 < 3",
     "'Register within ' || cast(1 + doc_id % 60 as string) || ' days of the change or a penalty of £100 applies. "
     "The paper return is due by 31 October.'"),
    ("doc_id % 4 = 2",
     "'Contact us on the helpline 0300 200 3310, Monday to Friday, 8am to 6pm or write to help' || "
     "cast(doc_id as string) || '@hmrc.gov.uk.'"),
    ("doc_id % 7 = 0",
     "'Marginal relief is 3/200 × (£' || {money:100000 + n_chars} || ' - profits). The VAT due = net amount x 20. "
     "Income tax is calculated by multiplying income by the rate.'"),
]


def _paragraph_sql(money: str) -> str:
    parts = [f"CASE WHEN {cond} THEN chr(10) || chr(10) || {text} ELSE '' END" for cond, text in PARAGRAPHS]
    expr = "text || " + " || ".join(parts)
    return re.sub(r"\{money:([^}]*)\}", lambda m: money.format(m.group(1)), expr)


GUIDANCE_CTE = f"g AS (SELECT doc_id, lang, source, {_paragraph_sql(chr(39).join(['format(', '{{:,}}', ', {})']))} AS text FROM documents)"


def guidance(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, lang, source, text): every document with its guidance paragraphs."""
    docs = spread(read_table(spark, path, "documents").select("doc_id", "lang", "source", "text", "n_chars"), "doc_id")
    return docs.select("doc_id", "lang", "source", F.expr(_paragraph_sql("format_number({}, 0)")).alias("text"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spread(read_table(spark, path, "documents"), "doc_id")


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spread(read_table(spark, path, "pages"), "page_id")


def sql_pattern(pattern: str, flags: str = "i") -> str:
    """Pattern as a SQL literal for RE2."""
    prefix = f"(?{flags})" if flags else ""
    return "'" + prefix + pattern.replace("'", "''") + "'"


def spans_sql(source: str, pattern: str, groups: int = 1, tag: int = 0, key: str = "doc_id", flags: str = "i") -> str:
    """Oracle for match spans: (key, text, tag, i, hit, g1, g2, start)."""
    p = sql_pattern(pattern, flags)
    g = [f"regexp_extract_all(text, {p}, {k}) AS l{k}" if k <= groups else f"NULL::VARCHAR[] AS l{k}" for k in (1, 2)]
    return (
        f"SELECT {key}, text, {tag} AS tag, i, hits[i] AS hit, l1[i] AS g1, l2[i] AS g2, CAST("
        "coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + "
        "coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start "
        f"FROM (SELECT {key}, text, regexp_extract_all(text, {p}, 0) AS hits, {', '.join(g)}, "
        f"string_split_regex(text, {p}) AS gaps FROM {source}) AS m, unnest(range(1, len(hits) + 1)) AS u(i)"
    )


def around_sql(before: int, after: int) -> str:
    """Context of a span row of :func:`spans_sql`."""
    return (f"substr(text, greatest(start - {before}, 0) + 1, "
            f"start + length(hit) + {after} - greatest(start - {before}, 0))")

"""Extraction over whole documents with guidance paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv
from guidemill.functions import values
from guidemill.functions.matching import explode_rows, rx, with_context
from guidemill.operators import conditions, contacts, deadlines, examples, formula_program, formulas, metadata, references
from guidemill.queries.base import GUIDANCE_CTE, around_sql, documents, guidance, spans_sql, sql_pattern


def _all(p: str, g: int = 1, flags: str = "", text: str = "text") -> str:
    return f"regexp_extract_all({text}, {sql_pattern(p, flags)}, {g})"


def _first(p: str, flags: str = "i", text: str = "text", g: int = 1) -> str:
    return f"CASE WHEN regexp_matches({text}, {sql_pattern(p, flags)}) THEN regexp_extract({text}, {sql_pattern(p, flags)}, {g}) END"


def _has(p: str, flags: str = "i", text: str = "text") -> str:
    return f"regexp_matches({text}, {sql_pattern(p, flags)})"


def _contains_any(words, text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


# --- shared helpers -----------------------------------------------------------------------------

def text_values(spark, path):
    t = F.col("text")
    num = lambda a: F.array_join(F.transform(a, lambda x: F.format_number(x, 2)), "|")
    return guidance(spark, path).select(
        "doc_id", values.pound_amount(t).alias("first_amount"), num(values.pound_amounts(t)).alias("amounts"),
        values.percentage(t).alias("first_percent"), num(values.percentages(t)).alias("percents"),
        values.tax_year(t).alias("tax_year"), F.array_join(values.form_codes(t), "|").alias("forms"),
        values.day_month_year(t)["day"].cast("bigint").alias("date_day"), values.day_month_year(t)["month"].alias("date_month"),
        values.day_month_year(t)["year"].cast("bigint").alias("date_year"))


def _numbers(lst: str) -> str:
    return f"array_to_string(list_transform({lst}, lambda x: format('{{:,.2f}}', CAST(replace(x, ',', '') AS DOUBLE))), '|')"


_YEARS = (
    "list_transform(list_filter(range(1, len(y1) + 1), lambda i: CAST(y2[i] AS INT) % 100 = (CAST(y1[i] AS INT) + 1) % 100), "
    "lambda i: y1[i] || '-' || CASE WHEN length(y2[i]) = 4 THEN right(y2[i], 2) ELSE y2[i] END)"
)
_TEXT_VALUES_SQL = f"""
WITH {GUIDANCE_CTE}, a AS (SELECT *, {_all(fv.POUND_AMOUNT)} AS am, {_all(fv.PERCENT)} AS pc, {_all(fv.YEAR_SPAN)} AS y1,
  {_all(fv.YEAR_SPAN, 2)} AS y2, list_transform({_all(fv.FORM_CODE, 1, 'i')}, lambda x: upper(x)) AS fm,
  {_first(fv.DAY_MONTH_YEAR)} AS dd, {_first(fv.DAY_MONTH_YEAR, g=2)} AS dm, {_first(fv.DAY_MONTH_YEAR, g=3)} AS dy FROM g)
SELECT doc_id, CAST(replace(am[1], ',', '') AS DOUBLE) AS first_amount, {_numbers('am')} AS amounts,
  CAST(pc[1] AS DOUBLE) AS first_percent, {_numbers('pc')} AS percents, ({_YEARS})[1] AS tax_year,
  array_to_string(list_filter(fm, lambda x, i: NOT list_contains(fm[1:i-1], x)), '|') AS forms,
  CAST(dd AS BIGINT) AS date_day, upper(dm[1]) || lower(dm[2:]) AS date_month, CAST(nullif(dy, '') AS BIGINT) AS date_year FROM a"""


def pattern_contexts(spark, path):
    """Every pound amount with 40 characters around it."""
    df = explode_rows(guidance(spark, path), with_context(F.col("text"), rx(fv.POUND_AMOUNT, ""), 40), ["doc_id"], pos="n")
    return df.select("doc_id", F.col("n").cast("bigint").alias("n"), F.col("start").cast("bigint").alias("start"),
                     "hit", "full_context")


_CONTEXT_SQL = f"""WITH {GUIDANCE_CTE}, s AS ({spans_sql('g', fv.POUND_AMOUNT, flags='')})
SELECT doc_id, i - 1 AS n, start, hit, {around_sql(40, 40)} AS full_context FROM s"""


# --- metadata --------------------------------------------------------------------------------------

def thresholds(spark, path):
    return metadata.threshold_rows(guidance(spark, path), ["doc_id"]).select("doc_id", "value", "type", "context", "formatted")


_THRESHOLDS_SQL = f"""WITH {GUIDANCE_CTE}, s AS (""" + " UNION ALL ".join(
    spans_sql("g", p, tag=i) for i, (_, p) in enumerate(fv.THRESHOLD_PATTERNS)) + f""")
SELECT doc_id, value, type, context, '£' || format('{{:,}}', value) AS formatted FROM (
  SELECT doc_id, TRY_CAST(replace(g1, ',', '') AS BIGINT) AS value,
         (['{"', '".join(k for k, _ in fv.THRESHOLD_PATTERNS)}'])[tag + 1] AS type, {around_sql(50, 50)} AS context,
         row_number() OVER (PARTITION BY doc_id, TRY_CAST(replace(g1, ',', '') AS BIGINT) ORDER BY tag, i) AS rn FROM s)
WHERE rn = 1 AND value IS NOT NULL"""


def labels_of_documents(spark, path):
    df = metadata.with_metadata(guidance(spark, path))
    join = lambda c: F.array_join(c, "|").alias(c)
    return df.select("doc_id", join("tax_years"), join("keywords"), join("topics"), join("business_types"))


def _label_list(dictionary, at_least: int) -> str:
    parts = [f"CASE WHEN ({' + '.join(f'CAST(contains(low, {chr(39)}{w}{chr(39)}) AS INT)' for w in ws)}) >= {at_least} THEN '{k}' END"
             for k, ws in dictionary.items()]
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), '|')"


_WORDS = sorted({w for d in (fv.TOPIC_WORDS, fv.BUSINESS_WORDS) for ws in d.values() for w in ws})
_LABELS_SQL = f"""
WITH {GUIDANCE_CTE}, a AS (SELECT doc_id, text, lower(text) AS low, {_all(fv.YEAR_SPAN)} AS y1, {_all(fv.YEAR_SPAN, 2)} AS y2,
  {_all(fv.STATED_YEAR_SPAN, 1, 'i')} AS s1, {_all(fv.STATED_YEAR_SPAN, 2, 'i')} AS s2,
  list_transform({_all(fv.FORM_CODE_WIDE, 1, 'i')}, lambda x: lower(x)) AS fm FROM g)
SELECT doc_id, array_to_string(list_reverse_sort(list_distinct({_YEARS} || list_transform(range(1, len(s1) + 1),
    lambda i: s1[i] || '-' || CASE WHEN length(s2[i]) = 4 THEN right(s2[i], 2) ELSE s2[i] END))), '|') AS tax_years,
  array_to_string(list_sort(list_distinct(fm || list_filter([{', '.join(repr(w) for w in _WORDS)}], lambda w: contains(low, w)))), '|') AS keywords,
  {_label_list(fv.TOPIC_WORDS, 2)} AS topics, {_label_list(fv.BUSINESS_WORDS, 1)} AS business_types FROM a"""


def form_mentions(spark, path):
    return metadata.form_rows(guidance(spark, path), ["doc_id"]).select("doc_id", "code", "name")


_FORM_CASE = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.FORM_NAMES.items()) + f" ELSE '{fv.FORM_NAME_DEFAULT}' END"
_FORMS_SQL = f"""WITH {GUIDANCE_CTE}
SELECT doc_id, code, {_FORM_CASE} AS name FROM (
  SELECT DISTINCT doc_id, upper(unnest({_all(fv.FORM_CODE_WIDE, 1, 'i')})) AS code FROM g)"""


def key_dates(spark, path):
    return metadata.key_date_rows(guidance(spark, path), ["doc_id"]).select(
        "doc_id", F.col("day").cast("bigint").alias("day"), "month", "context", "type")


_KEY_DATES_SQL = f"""WITH {GUIDANCE_CTE}, s AS ({spans_sql('g', fv.DAY_MONTH, 2)}),
a AS (SELECT doc_id, CAST(g1 AS BIGINT) AS day, upper(g2[1]) || lower(g2[2:]) AS month, i, {around_sql(100, 50)} AS context FROM s),
b AS (SELECT *, lower(context) AS low, row_number() OVER (PARTITION BY doc_id, day, month ORDER BY i) AS rn FROM a)
SELECT doc_id, day, month, context, CASE {' '.join(f"WHEN {_contains_any(w, 'low')} THEN '{k}'" for k, w in fv.DATE_WORDS)} ELSE 'date' END AS type
FROM b WHERE rn = 1"""


def labels_by_source(spark, path):
    """Label sets merged over all documents of a source."""
    merged = metadata.merge_labels(metadata.with_metadata(guidance(spark, path)), ["source"])
    return merged.select("source", *[F.array_join(c, "|").alias(c) for c in ("tax_years", "topics", "business_types")])


_LABELS_BY_SOURCE_SQL = f"""WITH l AS ({_LABELS_SQL}), d AS (SELECT source, l.* FROM l JOIN documents USING (doc_id)),
u AS (SELECT source, 'y' AS k, unnest(string_split(tax_years, '|')) AS v FROM d UNION SELECT source, 't', unnest(string_split(topics, '|')) FROM d
      UNION SELECT source, 'b', unnest(string_split(business_types, '|')) FROM d)
SELECT source, coalesce(string_agg(v, '|' ORDER BY v) FILTER (WHERE k = 'y' AND v <> ''), '') AS tax_years,
  coalesce(string_agg(v, '|' ORDER BY v) FILTER (WHERE k = 't' AND v <> ''), '') AS topics,
  coalesce(string_agg(v, '|' ORDER BY v) FILTER (WHERE k = 'b' AND v <> ''), '') AS business_types FROM u GROUP BY source"""


def chunk_hints(spark, path):
    h = metadata.chunk_hints(guidance(spark, path))
    return h.select(
        "doc_id", F.array_join("tax_years", "|").alias("tax_years"),
        F.array_join(F.transform("threshold_values", lambda v: v.cast("string")), "|").alias("threshold_values"),
        "threshold_type", F.array_join("form_references", "|").alias("form_references"),
        F.array_join("deadlines_mentioned", "|").alias("deadlines_mentioned"), "penalty_relevant", "deadline_sensitive")


_CHUNK_HINTS_SQL = f"""WITH {GUIDANCE_CTE}, s AS (""" + " UNION ALL ".join(
    spans_sql("g", p, tag=i) for i, (_, p) in enumerate(fv.THRESHOLD_PATTERNS)) + f"""),
t AS (SELECT doc_id, value, tag, i FROM (SELECT doc_id, tag, i, TRY_CAST(replace(g1, ',', '') AS BIGINT) AS value,
        row_number() OVER (PARTITION BY doc_id, TRY_CAST(replace(g1, ',', '') AS BIGINT) ORDER BY tag, i) AS rn FROM s)
      WHERE rn = 1 AND value IS NOT NULL),
tv AS (SELECT doc_id, string_agg(CAST(value AS VARCHAR), '|' ORDER BY tag, i) AS threshold_values,
        (['{"', '".join(k for k, _ in fv.THRESHOLD_PATTERNS)}'])[arg_min(tag, tag * 100000 + i) + 1] AS threshold_type FROM t GROUP BY doc_id),
a AS (SELECT doc_id, text, {_all(fv.YEAR_SPAN)} AS y1, {_all(fv.YEAR_SPAN, 2)} AS y2, {_all(fv.STATED_YEAR_SPAN, 1, 'i')} AS s1,
  {_all(fv.STATED_YEAR_SPAN, 2, 'i')} AS s2, list_transform({_all(fv.FORM_CODE_WIDE, 1, 'i')}, lambda x: upper(x)) AS fm,
  {_all(fv.DAY_MONTH, 1, 'i')} AS d1, list_transform({_all(fv.DAY_MONTH, 2, 'i')}, lambda x: upper(x[1]) || lower(x[2:])) AS d2 FROM g),
b AS (SELECT *, list_transform(range(1, len(d1) + 1), lambda i: CAST(CAST(d1[i] AS INT) AS VARCHAR) || ' ' || d2[i]) AS dm FROM a)
SELECT b.doc_id, array_to_string(list_reverse_sort(list_distinct({_YEARS} || list_transform(range(1, len(s1) + 1),
    lambda i: s1[i] || '-' || CASE WHEN length(s2[i]) = 4 THEN right(s2[i], 2) ELSE s2[i] END))), '|') AS tax_years,
  coalesce(threshold_values, '') AS threshold_values, threshold_type,
  array_to_string(list_filter(fm, lambda x, i: NOT list_contains(fm[1:i-1], x)), '|') AS form_references,
  array_to_string(list_filter(dm, lambda x, i: NOT list_contains(dm[1:i-1], x)), '|') AS deadlines_mentioned,
  {' OR '.join(_has(p, f) for f, p, *_ in fv.PENALTY_WORDING)} AS penalty_relevant,
  {' OR '.join(_has(p, f) for f, p, *_ in fv.DEADLINE_WORDING)} AS deadline_sensitive
FROM b LEFT JOIN tv USING (doc_id)"""


# --- cross-references -------------------------------------------------------------------------------

def text_references(spark, path):
    return references.reference_rows(guidance(spark, path), ["doc_id"]).select(
        "doc_id", "reference_type", "reference_text", "target_normalized", "target_url", "context",
        F.col("position").cast("bigint").alias("position"), "relationship_type", "strength")


def _reference_branch(order, pattern, kind, text, target, url, before, after, rel, groups=1):
    return (f"SELECT doc_id, {order} AS ord, start AS position, '{kind}' AS reference_type, {text} AS reference_text, "
            f"{target} AS target_normalized, {url} AS target_url, {around_sql(before, after)} AS context, '{rel}' AS rel "
            f"FROM ({spans_sql('g', pattern, groups)})")


_REFERENCE_SQL = f"WITH {GUIDANCE_CTE}, r AS (" + " UNION ALL ".join(
    [_reference_branch(i, p, "hmrc_manual", "upper(g1)", "lower(g1)",
                       f"'{fv.MANUAL_ADDRESS}' || lower(g1)" if f in fv.MANUALS_WITH_ADDRESS else "NULL", 50, 50, "?")
     for i, (f, p) in enumerate(fv.MANUAL_ID_PATTERNS.items())]
    + [_reference_branch(20 + i, p, "section", "'section ' || g1", "'section_' || g1", "NULL", 30, 30, "references")
       for i, p in enumerate(fv.SECTION_REFERENCES)]
    + [_reference_branch(30 + i, p, "legislation",
                         "'s.' || g1 || ' ' || g2" if k == "act_section" else "g1",
                         "replace(lower(g2), ' ', '_') || '_s' || g1" if k == "act_section" else "replace(lower(g1), ' ', '_')",
                         "NULL", 30, 30, "cites", 2 if k == "act_section" else 1)
       for i, (k, p) in enumerate(fv.LEGISLATION_REFERENCES)]
    + [_reference_branch(40 + i, p, "definition", "g1", "replace(lower(g1), ' ', '_')", "NULL", 30, 50, "defines")
       for i, p in enumerate(fv.TERM_REFERENCES)]) + f"""),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, reference_type, target_normalized ORDER BY ord, position) AS rn, lower(context) AS low FROM r)
SELECT doc_id, reference_type, reference_text, target_normalized, target_url, context, position,
  CASE WHEN rel <> '?' THEN rel {' '.join(f"WHEN {_contains_any(w, 'low')} THEN '{k}'" for k, w in fv.RELATIONSHIP_WORDS)} ELSE 'references' END
    AS relationship_type, 'explicit' AS strength FROM k WHERE rn = 1"""


# --- deadlines -----------------------------------------------------------------------------------------

def deadline_items(spark, path):
    d = deadlines.deadline_rows(guidance(spark, path), ["doc_id"])
    return d.select(
        "doc_id", "deadline_name", "deadline_type", "tax_category", "frequency", "rule_type",
        *[F.col(c).cast("bigint").alias(c) for c in ("rule_day", "rule_month", "rule_value", "suggested_reminder_days")],
        "rule_unit", "description", F.array_join("applies_to", "|").alias("applies_to"), "penalty_description", "tax_year")


def _known_sql(key, day, month, name, kind, category, applies):
    near = "substr(text, greatest(pos0 - 200, 0) + 1, pos0 + 300 - greatest(pos0 - 200, 0))"
    penalty = "coalesce(" + ", ".join(_first(p, "i", near, 0) for p in fv.PENALTY_NEAR_DATE) + ")"
    return (f"SELECT doc_id, '{name}' AS deadline_name, '{kind}' AS deadline_type, '{category}' AS tax_category, 'annual' AS frequency, "
            f"'fixed' AS rule_type, {day} AS rule_day, {month} AS rule_month, NULL AS rule_value, {30 if kind == 'filing' else 14} AS suggested_reminder_days, "
            f"NULL AS rule_unit, '{name} deadline is {day} {fv.MONTHS[month - 1]}' AS description, '{'|'.join(applies)}' AS applies_to, "
            f"{penalty} AS penalty_description FROM (SELECT doc_id, text, length(string_split_regex(text, '(?i)(^|[^0-9]){key}')[1]) + "
            f"length(regexp_extract(text, '(?i)(^|[^0-9]){key}', 1)) AS pos0 FROM g WHERE regexp_matches(text, '(?i)(^|[^0-9]){key}'))")


_UNIT = "rtrim(lower(g2), 's')"
_RELATIVE_SQL = (
    f"SELECT doc_id, 'Within ' || n || ' ' || u || 's deadline', CASE "
    + " ".join(f"WHEN {_contains_any(w, 'low')} THEN '{k}'" for k, w in fv.RELATIVE_DEADLINE_WORDS)
    + " ELSE 'notification' END, 'general', 'event_based', 'relative', NULL, NULL, n, least(n // 2, 14), u, "
    "'Must be completed within ' || n || ' ' || u || '(s)', '', NULL FROM (SELECT doc_id, CAST(g1 AS BIGINT) AS n, "
    f"{_UNIT} AS u, lower({around_sql(150, 50)}) AS low FROM ({spans_sql('g', fv.RELATIVE_DEADLINE, 2)}))")
_DEADLINES_SQL = (
    f"WITH {GUIDANCE_CTE}, y AS (SELECT doc_id, ({_YEARS})[1] AS tax_year FROM (SELECT doc_id, {_all(fv.YEAR_SPAN)} AS y1, "
    f"{_all(fv.YEAR_SPAN, 2)} AS y2 FROM g)), d AS (" + " UNION ALL ".join([_known_sql(*k) for k in fv.KNOWN_DEADLINES] + [_RELATIVE_SQL])
    + ") SELECT d.doc_id, deadline_name, deadline_type, tax_category, frequency, rule_type, CAST(rule_day AS BIGINT) AS rule_day, "
    "CAST(rule_month AS BIGINT) AS rule_month, CAST(rule_value AS BIGINT) AS rule_value, "
    "CAST(suggested_reminder_days AS BIGINT) AS suggested_reminder_days, rule_unit, description, applies_to, "
    "penalty_description, tax_year FROM d JOIN y USING (doc_id)")


# --- contacts -------------------------------------------------------------------------------------------

def contact_items(spark, path):
    c = contacts.contact_rows(guidance(spark, path), ["doc_id"])
    return c.select(
        "doc_id", "service_name", "service_category", "description",
        F.array_join(F.transform("contact_methods", lambda m: F.concat_ws(
            ";", m["type"], m["value"], F.coalesce(m["hours"], F.lit("-")), F.coalesce(m["name"], F.lit("-")))), "|").alias("methods"))


def _phone_list(p: str) -> str:
    d = r"regexp_replace(x, '[\s.\-]', '', 'g')"
    norm = f"CASE WHEN starts_with({d}, '0') AND length({d}) = 11 THEN {d}[1:4] || ' ' || {d}[5:7] || ' ' || {d}[8:11] ELSE x END"
    return f"list_transform({_all(p, 1, 'i', 'w')}, lambda x: {norm})"


def _near(i: int) -> str:
    return f"substr(w, greatest(st{i}[j] - 100, 0) + 1, st{i}[j] + 200 - greatest(st{i}[j] - 100, 0))"


def _method(i: int) -> str:
    n = _near(i)
    hours = f"coalesce(nullif(concat_ws(', ', {_first(fv.OPENING_HOURS, 'i', n)}, {_first(fv.OPENING_DAYS, 'i', n)}), ''), '-')"
    name = "CASE ph{0}[j] ".format(i) + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in fv.HELPLINES.items()) + " ELSE '-' END"
    return f"list_transform(range(1, len(ph{i}) + 1), lambda j: 'phone;' || ph{i}[j] || ';' || {hours} || ';' || {name})"


def _starts(p: str) -> str:
    q = sql_pattern(p)
    return (f"list_transform(range(1, len(regexp_extract_all(w, {q}, 0)) + 1), lambda j: "
            f"CAST(list_sum(list_transform(string_split_regex(w, {q})[1:j], lambda x: length(x))) + "
            f"coalesce(list_sum(list_transform(regexp_extract_all(w, {q}, 0)[1:j-1], lambda x: length(x))), 0) AS BIGINT))")


_KNOWN_IN = "list_filter(ph1 || ph2, lambda x: x IN (" + ", ".join(f"'{k}'" for k in fv.HELPLINES) + "))[1]"
_CONTACTS_SQL = f"""
WITH {GUIDANCE_CTE}, wi AS (""" + " UNION ALL ".join(
    f"SELECT doc_id, {around_sql(50, 500)} AS w FROM ({spans_sql('g', p, 0)})" for p in fv.CONTACT_INDICATORS) + f"""),
w AS (SELECT doc_id, w FROM wi UNION ALL SELECT doc_id, text FROM g WHERE doc_id NOT IN (SELECT doc_id FROM wi)),
p AS (SELECT doc_id, w, {_phone_list(fv.PHONE_PATTERNS[0])} AS ph1, {_phone_list(fv.PHONE_PATTERNS[1])} AS ph2,
      {_starts(fv.PHONE_PATTERNS[0])} AS st1, {_starts(fv.PHONE_PATTERNS[1])} AS st2,
      list_filter({_all(fv.EMAIL, 1, '', 'w')}, lambda e: contains(e, 'gov.uk') OR contains(lower(e), 'hmrc')) AS em FROM w)
SELECT DISTINCT doc_id, coalesce(CASE {_KNOWN_IN} {' '.join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in fv.HELPLINES.items())} END,
    '{fv.CONTACT_DEFAULT_NAME}') AS service_name,
  CASE {_KNOWN_IN} {' '.join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in fv.HELPLINES.items())} END AS service_category,
  CASE WHEN length(w) > 200 THEN w[1:200] || '...' ELSE w END AS description,
  array_to_string({_method(1)} || {_method(2)} || list_transform(em, lambda e: 'email;' || e || ';-;-'), '|') AS methods
FROM p WHERE len(ph1) + len(ph2) + len(em) > 0"""


# --- condition lists ---------------------------------------------------------------------------------------

def condition_lists(spark, path):
    c = conditions.condition_list_rows(guidance(spark, path), ["doc_id"])
    return c.select(
        "doc_id", "condition_name", "condition_type", "logical_operator", "outcome_if_met",
        F.size("conditions").cast("bigint").alias("condition_count"),
        F.array_join(F.transform("conditions", lambda x: F.concat_ws("=", x["id"], x["text"])), "|").alias("items"),
        F.array_join(F.flatten(F.transform("conditions", lambda x: F.transform(x["variables"], lambda v: v["value"]))), "|")
        .alias("variables"))


def _list_end(p: str) -> str:
    at = f"length(string_split_regex(rest, '{p}')[1])"
    return f"CASE WHEN regexp_matches(rest, '{p}') AND {at} > 50 THEN {at} ELSE length(rest) END"


_SQUEEZE = r"trim(regexp_replace(x, '\s+', ' ', 'g'))"
_CONDITIONS_SQL = f"WITH {GUIDANCE_CTE}, s AS (" + " UNION ALL ".join(
    f"SELECT doc_id, text, tag, start, hit, g1 FROM ({spans_sql('g', p, 1 if sub else 0, tag=i, flags='is')})"
    for i, (_, _, sub, p) in enumerate(fv.CONDITION_STARTS)) + f"""),
r AS (SELECT *, substr(text, start + length(hit) + 1, 2000) AS rest, lower({around_sql(50, 0)}) AS intro,
      (['{"', '".join(c[0] for c in fv.CONDITION_STARTS)}'])[tag + 1] AS kind, (['{"', '".join(c[1] for c in fv.CONDITION_STARTS)}'])[tag + 1] AS hint FROM s),
e AS (SELECT *, rest[1:least({_list_end(chr(92) + 'n' + chr(92) + 'n[A-Z]')}, {_list_end(chr(92) + 'n##')},
      CASE WHEN regexp_matches(rest, '(?m)^\\s*[0-9]+\\.') AND NOT regexp_matches(rest, '(?m)^\\s*\\([a-z]\\)') THEN length(rest)
           ELSE {_list_end(chr(92) + 'n[0-9]+' + chr(92) + '.')} END)] AS body FROM r),
i AS (SELECT *, regexp_extract_all(body, '(?m)^\\s*\\(([a-z])\\)', 1) AS ids, string_split_regex(body, '(?m)^\\s*\\([a-z]\\)')[2:] AS parts FROM e)
SELECT doc_id, upper(kind[1]) || kind[2:] || ' conditions for ' || coalesce(nullif(g1, ''), hint) AS condition_name, kind AS condition_type,
  CASE WHEN {_has(fv.OR_WORDS, 'i', 'intro')} THEN 'OR' WHEN {_has(fv.AND_WORDS, 'i', 'intro')} THEN 'AND' ELSE 'OR' END AS logical_operator,
  coalesce('You must ' || coalesce({_first(fv.OUTCOME_PATTERNS[0], 'i', 'intro')}, {_first(fv.OUTCOME_PATTERNS[1], 'i', 'intro')}),
    CASE kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.OUTCOME_BY_TYPE.items())} END) AS outcome_if_met,
  len(ids) AS condition_count,
  array_to_string(list_transform(range(1, len(ids) + 1), lambda k: ids[k] || '=' || list_transform(parts, lambda x: {_SQUEEZE})[k]), '|') AS items,
  array_to_string(flatten(list_transform(parts, lambda x: regexp_extract_all(x, {sql_pattern(fv.POUND_AMOUNT, '')}, 1) ||
    regexp_extract_all(x, {sql_pattern(fv.PERCENT, '')}, 1))), '|') AS variables
FROM i WHERE len(ids) >= 2"""


# --- worked examples -------------------------------------------------------------------------------------------

def worked_examples(spark, path):
    e = examples.example_rows(guidance(spark, path), ["doc_id"])
    return e.select(
        "doc_id", "example_name", "example_category", "name", "income", "turnover", "profit", "scenario_description",
        "result_value", "result_label", "result_formatted", F.array_join("formulas_used", "|").alias("formulas_used"),
        F.array_join("tables_used", "|").alias("tables_used"), F.length("full_text").cast("bigint").alias("chars"), "tax_year")


def worked_example_steps(spark, path):
    e = examples.example_rows(guidance(spark, path), ["doc_id"])
    s = explode_rows(e, F.col("steps"), ["doc_id", F.length("full_text").alias("chars")], pos="step_no")
    return s.select("doc_id", F.col("chars").cast("bigint").alias("chars"), F.col("step_no").cast("bigint").alias("step_no"),
                    F.col("step").cast("bigint").alias("step"), "description", "calculation", "result")


def _amount(p: str) -> str:
    return f"TRY_CAST(replace({_first(p, 'i', 'w')}, ',', '') AS BIGINT)"


def _mention(table) -> str:
    parts = ", ".join(f"CASE WHEN contains(low, '{k}') THEN '{v}' END" for k, v in table.items())
    return f"array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), '|')"


_EXAMPLES_SQL = f"WITH {GUIDANCE_CTE}, y AS (SELECT doc_id, ({_YEARS})[1] AS tax_year FROM (SELECT doc_id, {_all(fv.YEAR_SPAN)} AS y1, {_all(fv.YEAR_SPAN, 2)} AS y2 FROM g)), s AS (" + " UNION ALL ".join(
    f"SELECT doc_id, substr(text, start + 1, 1500) AS rest FROM ({spans_sql('g', p, 0)})" for p in fv.EXAMPLE_STARTS) + f"""),
c AS (SELECT doc_id, rest[1:least(length(rest), {', '.join(
    f"CASE WHEN regexp_matches(rest, '(?i){p}') AND length(string_split_regex(rest, '(?i){p}')[1]) > 100 THEN length(string_split_regex(rest, '(?i){p}')[1]) ELSE length(rest) END"
    for p in fv.EXAMPLE_ENDS)})] AS w FROM s),
a AS (SELECT doc_id, w, lower(w) AS low, list_filter([{', '.join(repr(n) for n in fv.EXAMPLE_NAMES)}], lambda n: contains(lower(w), lower(n)))[1] AS name,
  coalesce({_amount(fv.SCENARIO_AMOUNTS[1][1])}, {_amount(fv.SCENARIO_AMOUNTS[0][1])}) AS income,
  {_amount(fv.SCENARIO_AMOUNTS[2][1])} AS turnover, {_amount(fv.SCENARIO_AMOUNTS[3][1])} AS profit,
  coalesce({', '.join(f"TRY_CAST(replace({_first(p, 'i', 'w')}, ',', '') AS DOUBLE)" for p in fv.FINAL_RESULTS)}) AS result_value FROM c),
b AS (SELECT *, CASE {' '.join(f"WHEN {_has(p, '', 'low')} THEN '{k}'" for k, p in fv.EXAMPLE_CATEGORIES)} ELSE 'general' END AS cat FROM a
      WHERE name IS NOT NULL OR income IS NOT NULL OR turnover IS NOT NULL OR profit IS NOT NULL),
d AS (SELECT *, concat_ws(' - ', name, CASE WHEN income IS NOT NULL THEN '£' || format('{{:,}}', income) || ' income'
        WHEN profit IS NOT NULL THEN '£' || format('{{:,}}', profit) || ' profit'
        WHEN turnover IS NOT NULL THEN '£' || format('{{:,}}', turnover) || ' turnover' END) AS lead,
      CASE cat {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.EXAMPLE_CATEGORY_TITLES.items())} ELSE 'Tax' END AS title FROM b)
SELECT d.doc_id, lead || ' - ' || title || ' Example' AS example_name, cat AS example_category, name, income, turnover, profit,
  coalesce(nullif(concat_ws(' ', name, 'has income of £' || format('{{:,}}', income)), ''), 'Example calculation') AS scenario_description,
  result_value, CASE WHEN result_value IS NULL THEN 'Result not extracted' ELSE 'Tax Due' END AS result_label,
  '£' || format('{{:,.2f}}', result_value) AS result_formatted, {_mention(fv.EXAMPLE_FORMULAS)} AS formulas_used,
  {_mention(fv.EXAMPLE_TABLES)} AS tables_used, length(w) AS chars, tax_year FROM d JOIN y USING (doc_id)"""


# In these windows a step ends with its line, so the SQL needs no look-ahead.
_STEP_RE = r"(?:step\s+([0-9]+)[:\s]+|([0-9]+)\.\s+)([^\n]+)"
_STEPS_SQL = _EXAMPLES_SQL[:_EXAMPLES_SQL.index("d AS (SELECT *, concat_ws")].rstrip().rstrip(",") + f""",
t AS (SELECT doc_id, length(w) AS chars, {_all(_STEP_RE, 1, 'i', 'w')} AS a1, {_all(_STEP_RE, 2, 'i', 'w')} AS a2,
  list_transform({_all(_STEP_RE, 3, 'i', 'w')}, lambda x: {_SQUEEZE}) AS a3 FROM b)
SELECT doc_id, chars, k - 1 AS step_no, CAST(coalesce(nullif(a1[k], ''), a2[k]) AS BIGINT) AS step, a3[k][1:200] AS description,
  {_first(fv.STEP_CALCULATION, '', 'a3[k]')} AS calculation, TRY_CAST(replace({_first(fv.STEP_RESULT, '', 'a3[k]')}, ',', '') AS DOUBLE) AS result
FROM t, unnest(range(1, len(a1) + 1)) AS u(k)"""


# --- formulas ---------------------------------------------------------------------------------------------------

def formula_items(spark, path):
    f = formulas.formula_rows(guidance(spark, path), ["doc_id"])
    return f.select("doc_id", "formula_name", "formula_type", "formula_text", F.array_join("variables", "|").alias("variables"),
                    F.array_join("tables_used", "|").alias("tables_used"))


def known_formulas(spark, path):
    """The four known kinds; the generic ones depend on acceptance order and are checked by fixtures."""
    return formula_items(spark, path).where("formula_type <> 'other'")


def formula_definitions(spark, path):
    """Inputs and steps of the known formulas as long rows."""
    rows = guidance(spark, path).select("doc_id", F.explode_outer(formulas.known_formulas(F.col("text"))).alias("f")).where("f IS NOT NULL")
    return rows.select("doc_id", "f.formula_name", F.explode(F.concat(
        F.transform("f.inputs", lambda i, k: F.struct(F.lit("input").alias("part"), k.cast("bigint").alias("position"), i["name"].alias("name"), i["unit"].alias("detail"), i["value"].alias("value"))),
        F.transform("f.steps", lambda s, k: F.struct(F.lit("step").alias("part"), k.cast("bigint").alias("position"), s["result"].alias("name"), F.concat(
            s["operation"], F.lit(": "), F.array_join(s["operands"], ", ")).alias("detail"), F.lit(None).cast("double").alias("value"))))).alias("x")).select("doc_id", "formula_name", "x.*")


def extracted_formula_results(spark, path):
    """Every known formula of a text, worked out with amounts of its document."""
    rows = guidance(spark, path).join(documents(spark, path).select("doc_id", F.col("n_chars").cast("double").alias("n")), "doc_id")
    found = rows.select("doc_id", "n", F.explode_outer(formulas.known_formulas(F.col("text"))).alias("f")).where("f IS NOT NULL").select(
        F.concat_ws("/", F.col("doc_id").cast("string"), "f.formula_name").alias("formula_id"), "doc_id", "n", "f.formula_name", "f.inputs", "f.steps")
    given = F.create_map(*[x for name, v in (
        ("augmented_profits", F.col("n") + 90000), ("taxable_profits", F.col("n") + 80000), ("taxable_income", F.col("n") * 10), ("tax_rate", F.lit(20.0)),
        ("base_penalty", F.lit(100.0)), ("days_late", F.when(F.col("n") % 2 == 0, F.col("n") % 100)), ("daily_penalty", F.lit(10.0)), ("net_amount", F.col("n"))) for x in (F.lit(name), v)])
    ran = formula_program.run_formulas(found.select(F.col("formula_id").alias("request_id"), "formula_id", given.alias("given")), formula_program.compile_formulas(found))
    parts = F.split("request_id", "/")
    return ran.select(F.get(parts, F.lit(0)).cast("bigint").alias("doc_id"), F.get(parts, F.lit(1)).alias("formula_name"), F.round("result", 4).alias("result"), "error")


def _known_formula(p: str, key: str, extra: str = "true") -> str:
    name, kind, text, variables, _, table = fv.KNOWN_FORMULAS[key]
    return (f"SELECT doc_id, '{name}' AS formula_name, '{kind}' AS formula_type, '{text}' AS formula_text, "
            f"'{'|'.join(variables)}' AS variables, '{table}' AS tables_used FROM ({_first_span(p)}) WHERE {extra}")


def _first_span(p: str, margin: int = 100) -> str:
    return f"SELECT *, lower({around_sql(margin, margin)}) AS low FROM ({spans_sql('g', p, 0, flags='is')}) WHERE i = 1"


_FORMULAS_SQL = f"""WITH {GUIDANCE_CTE}
SELECT doc_id, 'Corporation Tax Marginal Relief' AS formula_name, 'marginal_relief' AS formula_type,
  'Marginal Relief = ' || regexp_extract(hit, '[0-9]+/[0-9]+', 0) || ' × (£' || format('{{:,}}', coalesce(TRY_CAST(replace({_first('£([0-9,]+)', '', 'hit')}, ',', '') AS BIGINT), {fv.DEFAULT_UPPER_LIMIT}))
  || ' - Augmented Profits) × (Taxable Profits / Augmented Profits)' AS formula_text,
  'augmented_profits|taxable_profits|upper_limit|fraction' AS variables, 'Corporation Tax Rates' AS tables_used
FROM ({_first_span(fv.MARGINAL_RELIEF, 200)})
UNION ALL {_known_formula(fv.TAX_CALCULATION, 'income_tax', "contains(low, 'income tax')")}
UNION ALL {_known_formula(fv.TAX_CALCULATION, 'corporation_tax', "contains(low, 'corporation tax') AND NOT contains(low, 'income tax')")}
UNION ALL {_known_formula(fv.PENALTY_CALCULATION, 'penalty')}
UNION ALL {_known_formula(fv.VAT_CALCULATION, 'vat')}"""


# --- probes ----------------------------------------------------------------------------------------------------------

# The parts of each kind as rows of (kind name, part, position, name, detail, default); limit and fraction come from the text.
_PARTS = ", ".join(
    f"('{name}', '{part}', {k}, '{n}', '{d}', {'NULL' if v is None else float(v)})" for key, name in (("marginal_relief", "Corporation Tax Marginal Relief"), *((k, v[0]) for k, v in fv.KNOWN_FORMULAS.items()))
    for part, rows in (("input", fv.FORMULA_INPUTS[key]), ("step", [(r, f"{op}: {', '.join(args)}", None) for r, op, args in fv.FORMULA_STEPS[key]])) for k, (n, d, v) in enumerate(rows))
_FRACTION_SQL = "CAST(split_part(regexp_extract(formula_text, '[0-9]+/[0-9]+', 0), '/', 1) AS DOUBLE) / CAST(split_part(regexp_extract(formula_text, '[0-9]+/[0-9]+', 0), '/', 2) AS DOUBLE)"
_LIMIT_SQL = "CAST(replace(regexp_extract(formula_text, '£([0-9,]+)', 1), ',', '') AS DOUBLE)"
_DEFINITIONS_SQL = f"""SELECT doc_id, formula_name, part, CAST(position AS BIGINT) AS position, name, detail,
  CASE name WHEN 'upper_limit' THEN {_LIMIT_SQL} WHEN 'fraction' THEN {_FRACTION_SQL} ELSE CAST(value AS DOUBLE) END AS value
FROM ({_FORMULAS_SQL}) JOIN (VALUES {_PARTS}) AS p(kind, part, position, name, detail, value) ON kind = formula_name"""
_EXTRACTED_RESULTS_SQL = f"""SELECT doc_id, formula_name, round(CASE formula_name
  WHEN 'Corporation Tax Marginal Relief' THEN ({_LIMIT_SQL} - (n + 90000)) * ((n + 80000) / (n + 90000)) * ({_FRACTION_SQL})
  WHEN 'Corporation Tax Calculation' THEN (n + 80000) * 20 / 100 WHEN 'Income Tax Calculation' THEN (n * 10 - 12570) * 20 / 100 WHEN 'VAT Calculation' THEN n * 20 / 100
  WHEN 'Penalty Calculation' THEN CASE WHEN n % 2 = 0 THEN 100 + 10 * (n % 100) END END, 4) AS result,
  CASE WHEN formula_name = 'Penalty Calculation' AND n % 2 <> 0 THEN 'no value for days_late' END AS error
FROM ({_FORMULAS_SQL}) JOIN (SELECT doc_id AS d, CAST(n_chars AS DOUBLE) AS n FROM documents) ON d = doc_id"""


def content_probes(spark, path):
    """Which extractors a document needs at all."""
    t = F.col("text")
    return guidance(spark, path).select(
        "doc_id", formulas.has_formulas(t).alias("has_formulas"), deadlines.has_deadlines(t).alias("has_deadlines"),
        examples.has_examples(t).alias("has_examples"), contacts.has_contacts(t).alias("has_contacts"))


_PROBES_SQL = f"""WITH {GUIDANCE_CTE} SELECT doc_id, {_has(fv.FORMULA_PROBE)} AS has_formulas, {_has(fv.DEADLINE_PROBE)} AS has_deadlines,
  {' OR '.join(_has(p) for p in fv.EXAMPLE_STARTS)} AS has_examples,
  {' OR '.join(_has(p) for p in fv.PHONE_PATTERNS + fv.CONTACT_INDICATORS)} OR {_has(fv.EMAIL, '')} AS has_contacts FROM g"""

QUERIES = {
    "text_values": (text_values, _TEXT_VALUES_SQL),
    "pattern_contexts": (pattern_contexts, _CONTEXT_SQL),
    "thresholds": (thresholds, _THRESHOLDS_SQL),
    "document_labels": (labels_of_documents, _LABELS_SQL),
    "form_mentions": (form_mentions, _FORMS_SQL),
    "key_dates": (key_dates, _KEY_DATES_SQL),
    "labels_by_source": (labels_by_source, _LABELS_BY_SOURCE_SQL),
    "chunk_hints": (chunk_hints, _CHUNK_HINTS_SQL),
    "text_references": (text_references, _REFERENCE_SQL),
    "deadline_items": (deadline_items, _DEADLINES_SQL),
    "contact_items": (contact_items, _CONTACTS_SQL),
    "condition_lists": (condition_lists, _CONDITIONS_SQL),
    "worked_examples": (worked_examples, _EXAMPLES_SQL),
    "worked_example_steps": (worked_example_steps, _STEPS_SQL),
    "known_formulas": (known_formulas, _FORMULAS_SQL),
    "all_formulas": (formula_items, None),
    "formula_definitions": (formula_definitions, _DEFINITIONS_SQL),
    "extracted_formula_results": (extracted_formula_results, _EXTRACTED_RESULTS_SQL),
    "content_probes": (content_probes, _PROBES_SQL),
}

"""Chunking of whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from guidemill.operators import chunk, legal
from guidemill.queries.base import GUIDANCE_CTE, documents, guidance, sql_pattern
from guidemill.functions import fixed_values as fv

def _title():
    return F.concat(F.lit("Document "), F.col("doc_id").cast("string"))


def _chunks(spark, path):
    docs = documents(spark, path).select("doc_id", "lang", "text", _title().alias("title"))
    return chunk.chunk_texts(docs, ["doc_id", "lang"], title=F.col("title"))


def chunk_documents(spark, path):
    return _chunks(spark, path).select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.col("total_chunks").cast("bigint").alias("total_chunks"), F.col("char_start").cast("bigint").alias("char_start"),
        F.col("char_end").cast("bigint").alias("char_end"), F.md5("content").alias("content_md5"), "section_title",
        "heading_path", "has_overlap_with_previous")


def chunk_overlaps(spark, path):
    return _chunks(spark, path).where("has_overlap_with_previous").select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "overlap_text")


def chunk_stats_by_lang(spark, path):
    return chunk.chunk_stats(_chunks(spark, path), ["lang"])


def chunk_stats_total(spark, path):
    return chunk.chunk_stats(_chunks(spark, path))


# The splitter as a recursive query: one level per cut.
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"


def split_cte(source: str, size: int, fits: int) -> str:
    """CTEs ``pieces(doc_id, lang, n, piece)`` for ``source(doc_id, lang, full_content)``."""
    cand = f"substr(rem, 1, {size})"
    para = f"regexp_extract({cand}, '(?s)^(.*\\n\\n+)', 1)"
    sent = f"regexp_extract({cand}, '(?s)^(.*[.!?]\\s+)[A-Z]', 1)"
    last = f"(CASE WHEN contains({cand}, ' ') THEN {size} - instr(reverse({cand}), ' ') ELSE -1 END)"
    return f"""
cuts(doc_id, lang, n, piece, rem) AS (
  SELECT doc_id, lang, 0, CASE WHEN length(full_content) <= {fits} THEN full_content ELSE NULL END,
         CASE WHEN length(full_content) <= {fits} THEN '' ELSE full_content END
  FROM {source}
  UNION ALL
  SELECT doc_id, lang, n + 1,
         CASE WHEN length(rem) <= {size} THEN rem ELSE trim(substr(rem, 1, cut), {_BLANKS}) END,
         CASE WHEN length(rem) <= {size} THEN '' ELSE trim(substr(rem, cut + 1), {_BLANKS}) END
  FROM (SELECT *, CASE WHEN contains({cand}, chr(10) || chr(10)) THEN length({para})
                       WHEN length({sent}) > 0 THEN length({sent})
                       WHEN {last} > {size // 2} THEN {last} ELSE {size} END AS cut
        FROM cuts WHERE rem <> '') AS c
),
pieces AS (
  SELECT doc_id, lang, piece, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS chunk_index,
         count(*) OVER (PARTITION BY doc_id) AS total_chunks,
         sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY n) - length(piece) AS char_start,
         lag(piece) OVER (PARTITION BY doc_id ORDER BY n) AS prev
  FROM cuts WHERE piece IS NOT NULL AND piece <> ''
),
lapped AS (
  SELECT *, CASE WHEN prev IS NULL THEN '' WHEN len(kept) > 0 THEN trim(array_to_string(kept, ' '), {_BLANKS})
                 WHEN instr(substr(prev, greatest(length(prev) - 99, 1)), ' ') > 1
                 THEN trim(substr(substr(prev, greatest(length(prev) - 99, 1)),
                                  instr(substr(prev, greatest(length(prev) - 99, 1)), ' ')), {_BLANKS})
                 ELSE trim(substr(prev, greatest(length(prev) - 99, 1)), {_BLANKS}) END AS overlap_text
  FROM (SELECT *, list_reverse(list_filter(rev, lambda x, j:
               list_sum(list_transform(rev[1:j], lambda y: length(y))) <= 100)) AS kept
        FROM (SELECT *, list_reverse(string_split(regexp_replace(
                substr(prev, greatest(length(prev) - 199, 1)), '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS rev
              FROM pieces))
),
chunks AS (
  SELECT doc_id, lang, chunk_index, total_chunks, char_start, char_start + length(piece) AS char_end, overlap_text,
         chunk_index > 0 AS follows,
         CASE WHEN overlap_text <> '' AND NOT starts_with(piece, overlap_text) THEN '[...] ' || piece ELSE piece END AS content
  FROM lapped
)"""


_CHUNKS = (
    "WITH RECURSIVE src AS (SELECT * FROM (SELECT doc_id, lang, '## Document ' || doc_id || chr(10) || chr(10) || text AS full_content "
    "FROM documents) WHERE length(full_content) >= 50)," + split_cte("src", 1200, 2000)
)

_STATS = """count(*) AS chunk_count, CAST(sum(length(content)) AS BIGINT) AS total_chars,
  round(avg(length(content)), 4) AS avg_size, min(length(content)) AS min_size, max(length(content)) AS max_size,
  CAST(sum(length(content) // 4) AS BIGINT) AS est_total_tokens, round(avg(length(content) // 4), 4) AS est_avg_tokens,
  count(DISTINCT doc_id) AS sections_covered, count(*) FILTER (WHERE follows) AS chunks_with_overlap"""


def legal_chunk_rows(spark, path):
    return legal.chunk_texts(
        guidance(spark, path).withColumn("title", _title()), ["doc_id", "lang"], title=F.col("title"))


def legal_chunks(spark, path):
    c = legal_chunk_rows(spark, path)
    return c.select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.md5("content").alias("content_md5"),
        "section_id", "paragraph_number", "citable_reference", "content_type",
        F.array_join("cross_references", "|").alias("cross_references"))


def legal_chunk_stats(spark, path):
    return legal.chunk_stats(legal_chunk_rows(spark, path), ["lang"])


def legal_content_types(spark, path):
    return legal.content_type_counts(legal_chunk_rows(spark, path), ["lang"])


def legal_chunk_json(spark, path):
    c = legal.chunk_json(legal_chunk_rows(spark, path))
    return c.select("doc_id", F.md5("chunk_json").alias("json_md5"), F.length("chunk_json").cast("bigint").alias("json_chars"))


# Long guidance without any condition item, for which the legal splitter is the plain one.
_FLAGS = {
    "contains_condition_list": [("im", fv.CONDITION_LEAD_IN), ("m", fv.CONDITION_ITEM)],
    "contains_definition": fv.DEFINITION_WORDING,
    "contains_example": fv.EXAMPLE_WORDING,
    "contains_table_reference": [("i", p) for p in fv.TABLE_MENTIONS],
    "contains_deadline": fv.DEADLINE_WORDING,
    "contains_penalty_info": fv.PENALTY_WORDING,
    "contains_contact_info": fv.CONTACT_WORDING,
}


def _flag_sql(name: str) -> str:
    tests = [f"regexp_matches(text, {sql_pattern(p, f)})" for f, p, *_ in _FLAGS[name]]
    return "(" + (" AND " if name == "contains_condition_list" else " OR ").join(tests) + ")"


def content_flags(spark, path):
    return legal.with_flags(guidance(spark, path), "text").select("doc_id", *_FLAGS, "content_type")


_CONTENT_FLAGS_SQL = (
    f"WITH {GUIDANCE_CTE}, f AS (SELECT doc_id, " + ", ".join(f"{_flag_sql(n)} AS {n}" for n in _FLAGS)
    + " FROM g) SELECT *, CASE WHEN contains_definition THEN 'definition' WHEN contains_condition_list THEN 'condition_list' "
    "WHEN contains_example THEN 'example' WHEN contains_contact_info THEN 'contact' WHEN contains_penalty_info THEN 'penalty' "
    "WHEN contains_deadline THEN 'deadline' ELSE 'general' END AS content_type FROM f"
)


def section_identifiers(spark, path):
    t = F.col("text")
    df = guidance(spark, path).withColumn("section_id", legal.section_id(t))
    df = df.withColumn("paragraph_number", legal.paragraph_number(t))
    return df.select(
        "doc_id", "section_id", "paragraph_number",
        F.array_join(legal.section_ids(t), "|").alias("all_ids"),
        F.array_join(legal.cross_references(t, F.col("section_id")), "|").alias("cross_references"),
        legal.citation(F.lit("Guide"), F.lit("Guide"), F.lit("Guide > Part"), F.col("section_id"), F.col("paragraph_number"))
        .alias("citable_reference"))


def _first(p: str, flags: str = "i", text: str = "text") -> str:
    return f"nullif(regexp_extract({text}, {sql_pattern(p, flags)}, 1), '')"


_MANUAL_CASE = "CASE " + " ".join(f"WHEN starts_with(section_id, '{k}') THEN '{v}'" for k, v in fv.MANUAL_NAMES.items()) + " ELSE 'Manual' END"
_IDS = r"\b(" + "|".join(p[3:-3] for p in fv.MANUAL_ID_PATTERNS.values()) + r")\b"
_MENTIONS = " || ".join(
    f"list_transform(regexp_extract_all(text, {sql_pattern(p)}, 1), lambda x: 'section ' || x)" for p in fv.SECTION_MENTIONS)
_SECTION_IDENTIFIERS_SQL = f"""
WITH {GUIDANCE_CTE}, a AS (
  SELECT doc_id, text, upper(coalesce({', '.join(_first(p) for p in fv.MANUAL_ID_PATTERNS.values())})) AS section_id,
         {_first(fv.PARAGRAPH_NUMBER, 'm', 'substr(text, 1, 200)')} AS paragraph_number,
         list_sort(list_distinct(list_transform(regexp_extract_all(text, {sql_pattern(_IDS)}, 1), lambda x: upper(x)))) AS ids
  FROM g),
b AS (SELECT *, list_sort(list_distinct(ids || {_MENTIONS})) AS refs FROM a)
SELECT doc_id, section_id, paragraph_number, array_to_string(ids, '|') AS all_ids,
       array_to_string(list_filter(refs, lambda x: section_id IS NULL OR x <> section_id), '|') AS cross_references,
       CASE WHEN section_id IS NOT NULL
            THEN concat_ws(', ', 'HMRC ' || {_MANUAL_CASE}, section_id, 'Para ' || paragraph_number)
            ELSE concat_ws(', ', 'GOV.UK', 'Guide > Part', 'Para ' || paragraph_number) END AS citable_reference
FROM b"""

# Legal chunks: plain split where there is no list; else text before, list and rest are packed or stand alone.
# The guidance paragraphs hold one lead-in, so the SQL needs no loop over lists.
_LEGAL = f"""WITH RECURSIVE {GUIDANCE_CTE},
full_g AS (SELECT doc_id, lang, '## Document ' || doc_id || chr(10) || chr(10) || text AS full_content FROM g),
marked AS (SELECT *, regexp_matches(full_content, {sql_pattern(fv.CONDITION_ITEM, 'm')}) AND regexp_matches(full_content, {sql_pattern(fv.CONDITION_LEAD_IN, 'im')}) AS listed
           FROM full_g WHERE length(full_content) >= 200),
src AS (SELECT doc_id, lang, full_content FROM marked WHERE NOT listed),
{split_cte('src', 1500, 1500)},
ls AS (SELECT *, instr(full_content, 'You must register for VAT if:') AS s0 FROM marked WHERE listed),
lt AS (SELECT *, substr(full_content, s0) AS tail FROM ls),
lp AS (SELECT doc_id, lang, full_content, trim(substr(full_content, 1, s0 - 1), {_BLANKS}) AS b, trim(substr(tail, 1, instr(tail, chr(10) || chr(10)) - 1), {_BLANKS}) AS l,
         trim(substr(tail, instr(tail, chr(10) || chr(10))), {_BLANKS}) AS r FROM lt),
lx AS (SELECT doc_id, lang, unnest(CASE WHEN length(full_content) <= 3000 THEN [full_content] WHEN length(b) + length(l) > 3000 THEN [b, l, r]
         WHEN length(b) + length(l) + length(r) > 3000 THEN [b || chr(10) || l, r] ELSE [b || chr(10) || l || chr(10) || r] END) AS content,
         generate_subscripts(CASE WHEN length(full_content) <= 3000 THEN [1] WHEN length(b) + length(l) > 3000 THEN [1, 2, 3]
         WHEN length(b) + length(l) + length(r) > 3000 THEN [1, 2] ELSE [1] END, 1) - 1 AS n FROM lp),
ap AS (SELECT doc_id, lang, chunk_index AS n, piece AS text FROM pieces UNION ALL SELECT doc_id, lang, n, content FROM lx WHERE content <> ''),
ids AS (SELECT doc_id, upper(coalesce({', '.join(_first(p, 'i', 'full_content') for p in fv.MANUAL_ID_PATTERNS.values())})) AS section_id FROM full_g),
fl AS (SELECT *, {", ".join(f"{_flag_sql(n)} AS {n}" for n in _FLAGS)}, {_first(fv.PARAGRAPH_NUMBER, 'm', 'substr(text, 1, 200)')} AS paragraph_number,
         list_sort(list_distinct(list_transform(regexp_extract_all(text, {sql_pattern(_IDS)}, 1), lambda x: upper(x)) || {_MENTIONS})) AS refs FROM ap JOIN ids USING (doc_id)),
lc AS (SELECT *, list_filter(refs, lambda x: section_id IS NULL OR x <> section_id) AS cross_refs,
         CASE WHEN contains_definition THEN 'definition' WHEN contains_condition_list THEN 'condition_list' WHEN contains_example THEN 'example'
              WHEN contains_contact_info THEN 'contact' WHEN contains_penalty_info THEN 'penalty' WHEN contains_deadline THEN 'deadline' ELSE 'general' END AS content_type,
         CASE WHEN section_id IS NOT NULL THEN concat_ws(', ', 'HMRC ' || {_MANUAL_CASE}, section_id, 'Para ' || paragraph_number)
              ELSE concat_ws(', ', 'GOV.UK', 'Document ' || doc_id, 'Para ' || paragraph_number) END AS citable_reference,
         count(*) OVER (PARTITION BY doc_id) AS total_chunks,
         CAST(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY n) - length(text) AS BIGINT) AS char_start FROM fl)"""
_LEGAL_STATS = """count(*) AS chunk_count, CAST(sum(length(text)) AS BIGINT) AS total_chars, round(avg(length(text)), 4) AS avg_size, min(length(text)) AS min_size,
  max(length(text)) AS max_size, CAST(sum(length(text) // 4) AS BIGINT) AS est_total_tokens, count(DISTINCT doc_id) AS sections_covered, count(section_id) AS with_section_ids, """ + ", ".join(
    f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in legal.FLAG_COUNTS.items()) + ", CAST(sum(len(cross_refs)) AS BIGINT) AS total_cross_refs"
_LEGAL_JSON = """to_json(struct_pack(content := text, chunk_index := n, total_chunks := total_chunks, char_start := char_start, char_end := char_start + length(text),
  section_title := 'Document ' || doc_id, heading_path := 'Document ' || doc_id, heading_level := 1, section_id := section_id, paragraph_number := paragraph_number,
  citable_reference := citable_reference, content_type := content_type, contains_condition_list := contains_condition_list, contains_definition := contains_definition,
  contains_example := contains_example, contains_table_reference := contains_table_reference, contains_deadline := contains_deadline,
  contains_penalty_info := contains_penalty_info, contains_contact_info := contains_contact_info, cross_references := cross_refs, has_overlap_with_previous := n > 0))"""

QUERIES = {
    "chunk_stats_by_lang": (chunk_stats_by_lang, f"{_CHUNKS} SELECT lang, {_STATS} FROM chunks GROUP BY lang"),
    "chunk_stats_total": (chunk_stats_total, f"{_CHUNKS} SELECT {_STATS} FROM chunks"),
    "chunk_documents": (chunk_documents, f"""{_CHUNKS}
SELECT doc_id, chunk_index, total_chunks, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end,
       md5(content) AS content_md5, 'Document ' || doc_id AS section_title, 'Document ' || doc_id AS heading_path,
       follows AS has_overlap_with_previous FROM chunks"""),
    "chunk_overlaps": (chunk_overlaps, f"{_CHUNKS} SELECT doc_id, chunk_index, overlap_text FROM chunks WHERE follows"),
    "content_flags": (content_flags, _CONTENT_FLAGS_SQL),
    "section_identifiers": (section_identifiers, _SECTION_IDENTIFIERS_SQL),
    "legal_chunks": (legal_chunks, f"""{_LEGAL} SELECT doc_id, n AS chunk_index, md5(text) AS content_md5, section_id, paragraph_number, citable_reference, content_type,
  array_to_string(cross_refs, '|') AS cross_references FROM lc"""),
    "legal_chunk_stats": (legal_chunk_stats, f"{_LEGAL} SELECT lang, {_LEGAL_STATS} FROM lc GROUP BY lang"),
    "legal_content_types": (legal_content_types, f"{_LEGAL} SELECT lang, content_type, count(*) AS chunk_count FROM lc GROUP BY 1, 2"),
    "legal_chunk_json": (legal_chunk_json, f"{_LEGAL} SELECT doc_id, md5(j) AS json_md5, length(j) AS json_chars FROM (SELECT doc_id, CAST({_LEGAL_JSON} AS VARCHAR) AS j FROM lc)"),
}

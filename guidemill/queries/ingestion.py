"""Ingest of a changed snapshot of the documents, full extraction, run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv
from guidemill.functions.matching import strip
from guidemill.operators import chunk, merge_state, parse
from guidemill.plans import extraction, ingest, runlog
from guidemill.queries.base import GUIDANCE_CTE, documents, guidance
from guidemill.queries import extraction as extraction_sql
from guidemill.queries.chunking import _LEGAL, split_cte
from guidemill.sources.tables import read_table

# The new snapshot: texts of three languages stay, English texts get a line, some fetches fail, some are empty.
_INCOMING = [
    "doc_id AS input_idx",
    "'https://www.gov.uk/' || CASE WHEN doc_id % 3 = 0 THEN 'hmrc-internal-manuals/' WHEN doc_id % 3 = 1 THEN 'guidance/' ELSE 'hmrc-news/' END || doc_id AS url",
    "'Page ' || doc_id AS title",
    "CASE WHEN source = 'src3' THEN '' WHEN lang = 'en' THEN text || chr(10) || 'Updated.' ELSE text END AS full_text",
    "CASE WHEN source = 'src5' THEN 'not found' END AS error",
    "CASE WHEN doc_id % 3 = 0 THEN 'manual_section' WHEN doc_id % 3 = 1 THEN 'answer' ELSE 'news_story' END AS document_type",
    "CASE WHEN doc_id % 3 = 1 THEN 'guide' ELSE 'other' END AS schema_name",
]
# The stored snapshot: everything but two sources, with the old texts.
_STORED = ["'https://www.gov.uk/' || CASE WHEN doc_id % 3 = 0 THEN 'hmrc-internal-manuals/' WHEN doc_id % 3 = 1 THEN 'guidance/' ELSE 'hmrc-news/' END || doc_id AS url",
           "text AS full_text", "'Page ' || doc_id AS title"]


def _incoming(spark, path):
    df = documents(spark, path).selectExpr(*_INCOMING)
    section = chunk.text_section(F.col("full_text"), F.col("title"))
    return df.withColumns({
        "word_count": parse.word_count(F.col("full_text")), "has_content": strip(F.col("full_text")) != "",
        "sections": F.array(section), "parent_title": F.lit(None).cast("string"),
        "section_hierarchy": F.array(F.lit("Guides")), "first_published": F.lit("2024-03-01").cast("timestamp_ntz"),
        "last_updated": F.lit("2024-03-02").cast("timestamp_ntz")})


def _stored(spark, path):
    df = read_table(spark, path, "documents").where("source NOT IN ('src7', 'src8')").selectExpr(*_STORED)
    return df.withColumn("content_hash", ingest.content_hash(F.col("full_text")))


def _stored_documents(spark, path):
    return _stored(spark, path).select(
        ingest.document_id(F.col("url")).alias("document_id"), "url", F.lit("GOV_UK").alias("authority"), F.lit("guidance").alias("document_type"),
        F.lit(2).alias("reliability_tier"), F.col("title"), F.lit(None).cast("string").alias("parent_title"),
        F.array(F.lit("Old")).alias("section_hierarchy"), F.lit("2020-01-01").cast("date").alias("publication_date"),
        F.lit("2020-01-02").cast("timestamp_ntz").alias("last_updated_source"), "content_hash", F.lit("completed").alias("ingestion_status"),
        F.lit("2020-01-03").cast("timestamp_ntz").alias("ingested_at"), F.lit(1).alias("total_chunks"))


_ALL = ingest.IngestSettings(max_errors=None)


def _processed(spark, path, settings=_ALL, materialize=False):
    return ingest.process(_incoming(spark, path), _stored(spark, path), settings, materialize)


def classify_documents(spark, path):
    df = documents(spark, path).selectExpr(*_INCOMING)
    a = ingest.authority(F.col("url"), F.col("document_type"))
    return df.select("url", a.alias("authority"), ingest.document_kind(F.col("schema_name"), F.col("document_type")).alias("document_kind"),
                     ingest.reliability_tier(a).cast("bigint").alias("tier"), ingest.content_hash(F.col("full_text")).alias("content_hash"))


def change_decisions(spark, path):
    return ingest.decide(_incoming(spark, path), _stored(spark, path)).select("url", "reason", "content_hash")


def change_decisions_skip_existing(spark, path):
    return ingest.decide(_incoming(spark, path), _stored(spark, path), ingest.SKIP_EXISTING).select("url", "reason")


def ingest_outcomes(spark, path):
    return ingest.outcomes(_processed(spark, path)).select(
        "url", "reason", "action", "success", F.col("chunks_created").cast("bigint").alias("chunks_created"), "error")


def change_decisions_force(spark, path):
    return ingest.decide(_incoming(spark, path), _stored(spark, path), ingest.FORCE_UPDATE).select("url", "reason")


def ingest_two_pass(spark, path):
    """Decisions from url and hash alone, then only the pages to process."""
    decisions, done = ingest.process_changed(_incoming(spark, path), _stored(spark, path), _ALL)
    return ingest.outcomes_of_decisions(decisions, done).select(
        "url", "reason", "action", "success", F.col("chunks_created").cast("bigint").alias("chunks_created"), "error")


def ingest_duplicate_urls(spark, path):
    """Every tenth page comes a second time with an older position: the later row counts."""
    new = _incoming(spark, path)
    older = new.where("input_idx % 10 = 0").withColumns({"input_idx": F.col("input_idx") - 1000000000, "full_text": F.concat(F.lit("Earlier text. "), "full_text")})
    done = ingest.process(older.unionByName(new), _stored(spark, path), _ALL)
    return ingest.outcomes(done).select("url", "action", F.col("chunks_created").cast("bigint").alias("chunks_created"), "error")


def ingest_run_summary(spark, path):
    return ingest.run_summary(ingest.outcomes(_processed(spark, path)))


def ingest_with_error_cap(spark, path):
    """The run stops at the tenth failure."""
    return ingest.run_summary(ingest.outcomes(_processed(spark, path, ingest.IngestSettings(max_errors=10))), F.lit(-1))


def ingest_errors(spark, path):
    return ingest.run_errors(ingest.outcomes(_processed(spark, path)))


def next_documents(spark, path):
    d = ingest.next_documents(_stored_documents(spark, path), _processed(spark, path), F.lit("2024-06-01").cast("timestamp_ntz"))
    return d.select("url", "authority", "document_type", F.col("reliability_tier").cast("bigint").alias("tier"), "title", "content_hash",
                    F.array_join("section_hierarchy", "|").alias("hierarchy"), F.date_format("publication_date", "yyyy-MM-dd").alias("published"),
                    F.date_format("ingested_at", "yyyy-MM-dd").alias("ingested"), F.col("total_chunks").cast("bigint").alias("total_chunks"))


def next_chunks(spark, path):
    old = _stored_documents(spark, path).select("document_id", F.col("url").alias("source_url"), F.lit("old").alias("content"),
                                                F.lit(0).alias("chunk_index"))
    c = ingest.next_chunks(old, _processed(spark, path, materialize=True))  # ids and rows come from one result
    return c.select("source_url", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.md5("content").alias("content_md5"),
                    "source_authority", F.col("reliability_tier").cast("bigint").alias("tier"))


_IN = f"""inc AS (SELECT {', '.join(_INCOMING)} FROM documents),
sto AS (SELECT {', '.join(_STORED)}, sha256(text) AS content_hash FROM documents WHERE source NOT IN ('src7', 'src8')),
dec AS (SELECT i.*, sha256(i.full_text) AS content_hash, s.url IS NOT NULL AS stored, len(list_filter(string_split_regex(i.full_text, '\\s+'), lambda w: w <> '')) AS words,
  CASE WHEN s.url IS NULL THEN 'new' WHEN s.content_hash = sha256(i.full_text) THEN 'unchanged' ELSE 'content_changed' END AS reason
  FROM inc i LEFT JOIN sto s ON s.url = i.url)"""
_AUTH = """CASE WHEN contains(lower(url), 'hmrc-internal-manuals') THEN 'HMRC_MANUAL' WHEN contains(lower(url), 'legislation.gov.uk') THEN 'UK_LEGISLATION'
  WHEN contains(lower(url), 'hmrc') OR document_type = 'hmrc_manual_section' THEN 'HMRC_MANUAL' ELSE 'GOV_UK' END"""
_KIND = "CASE WHEN contains(document_type, 'manual') THEN 'manual' WHEN contains(schema_name, 'guide') THEN 'guidance' WHEN contains(document_type, 'news') THEN 'NEWS' ELSE 'guidance' END"
_GATE = """CASE WHEN error IS NOT NULL THEN error WHEN trim(full_text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'No content found'
  WHEN words < 20 THEN 'Content too short (' || words || ' words)' END"""
_OUT = f"""WITH RECURSIVE {_IN},
gat AS (SELECT *, {_GATE} AS gate FROM dec),
src AS (SELECT url AS doc_id, '' AS lang, '## ' || title || chr(10) || chr(10) || full_text AS full_content FROM gat
        WHERE gate IS NULL AND reason IN ('new', 'content_changed') AND length('## ' || title || chr(10) || chr(10) || full_text) >= 50),
{split_cte('src', 1200, 2000)},
cnt AS (SELECT doc_id AS url, count(*) AS n FROM chunks GROUP BY 1),
outc AS (SELECT g.url, reason, CASE WHEN error IS NOT NULL THEN 'failed' WHEN n IS NULL THEN 'skipped' WHEN stored THEN 'updated' ELSE 'created' END AS action,
  coalesce(gate, CASE WHEN n IS NULL AND reason <> 'unchanged' THEN 'No chunks created' END) AS error, coalesce(n, 0) AS chunks_created, input_idx,
  error IS NOT NULL AS failed FROM gat g LEFT JOIN cnt USING (url))"""
_SUMMARY = """count(*) AS documents_processed, count(*) FILTER (WHERE action = 'created') AS documents_created, count(*) FILTER (WHERE action = 'updated') AS documents_updated,
  count(*) FILTER (WHERE action = 'skipped') AS documents_skipped, count(*) FILTER (WHERE action = 'failed') AS documents_failed,
  CAST(coalesce(sum(chunks_created), 0) AS BIGINT) AS chunks_created, count(error) AS error_count,
  CASE WHEN count(*) FILTER (WHERE action = 'failed') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status"""


# --- full extraction -------------------------------------------------------------------------------

def _with_metadata(spark, path):
    g = guidance(spark, path)
    title = F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    doc = g.select("doc_id", title.alias("doc_title"), F.col("text").alias("full_text"), F.array(chunk.text_section(F.col("text"), title)).alias("sections"))
    return extraction.chunk_with_metadata(doc, "doc_id")


def extraction_counts(spark, path):
    """Chunks and items per document, formulas switched off."""
    kinds = ["deadlines", "contacts", "condition_lists", "examples", "references"]
    return extraction.document_counts(extraction.extract(_with_metadata(spark, path), kinds), "doc_id")


def extraction_totals(spark, path):
    """Run totals with every extractor."""
    return extraction.run_totals(extraction.document_counts(extraction.extract(_with_metadata(spark, path)), "doc_id"))


def extraction_totals_listed(spark, path):
    """Run totals, formulas switched off."""
    return extraction.run_totals(extraction_counts(spark, path))


def document_years_and_forms(spark, path):
    """Tax years and form codes of every document, merged from its chunks and sorted; documents with neither have no row."""
    chunks = _with_metadata(spark, path).withColumn("codes", F.transform("forms", lambda f: f["code"]))
    found = merge_state.merged_labels(merge_state.merge_state(chunks, ["doc_id"], "chunk_index", ("tax_years", "codes"), ()), ["doc_id"], ("tax_years", "codes"))
    return found.select("doc_id", *[F.array_join(F.array_sort(c), "|").alias(n) for c, n in (("tax_years", "tax_years"), ("codes", "forms"))])


def chunk_metadata_rows(spark, path):
    c = _with_metadata(spark, path)
    return c.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "topic_primary", "stored_content_type", "citable_reference",
                    F.array_join("tax_years", "|").alias("tax_years"), F.array_join("topics", "|").alias("topics"))


# The oracle texts of the extractors, applied to the legal chunks instead of whole documents.
_CHUNK_G = f"lcx AS ({_LEGAL} SELECT doc_id * 10000 + n AS doc_id, text FROM lc), g AS (SELECT * FROM lcx)"


def _per_document(sql: str, name: str) -> str:
    body = sql.replace(GUIDANCE_CTE, _CHUNK_G, 1)
    return f"{name} AS (SELECT doc_id // 10000 AS doc_id, count(*) AS {name} FROM ({body}) GROUP BY 1)"


_ITEM_SQL = {"deadlines": extraction_sql._DEADLINES_SQL, "contacts": extraction_sql._CONTACTS_SQL, "condition_lists": extraction_sql._CONDITIONS_SQL,
             "examples": extraction_sql._EXAMPLES_SQL, "refs": extraction_sql._REFERENCE_SQL, "thresholds_found": extraction_sql._THRESHOLDS_SQL}
_COUNTS_SQL = (f"WITH base AS ({_LEGAL} SELECT doc_id, count(*) AS chunks_created FROM lc GROUP BY 1), "
               + ", ".join(_per_document(sql, n) for n, sql in _ITEM_SQL.items())
               + " SELECT doc_id, chunks_created, " + ", ".join(f"coalesce({n}, 0) AS {'references' if n == 'refs' else n}" for n in _ITEM_SQL).replace("AS references", 'AS "references"')
               + " FROM base " + " ".join(f"LEFT JOIN {n} USING (doc_id)" for n in _ITEM_SQL))
_YEARS_FORMS_SQL = f"""WITH y AS (SELECT DISTINCT doc_id // 10000 AS doc_id, unnest(string_split(tax_years, '|')) AS v FROM ({extraction_sql._LABELS_SQL.replace(GUIDANCE_CTE, _CHUNK_G, 1)})),
f AS (SELECT DISTINCT doc_id // 10000 AS doc_id, code FROM ({extraction_sql._FORMS_SQL.replace(GUIDANCE_CTE, _CHUNK_G, 1)})),
ys AS (SELECT doc_id, string_agg(v, '|' ORDER BY v) AS tax_years FROM y WHERE v <> '' GROUP BY 1), fs AS (SELECT doc_id, string_agg(code, '|' ORDER BY code) AS forms FROM f GROUP BY 1)
SELECT doc_id, coalesce(tax_years, '') AS tax_years, coalesce(forms, '') AS forms FROM ys FULL JOIN fs USING (doc_id)"""
_TOTALLED = ["chunks_created", *('"references"' if n == "refs" else n for n in _ITEM_SQL)]
_TOPIC_CASE = "CASE string_split(dl.topics, '|')[1] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.TOPIC_LABELS.items()) + " END"
_CHUNK_METADATA_SQL = f"""WITH lm AS ({_LEGAL} SELECT doc_id, n, content_type, citable_reference FROM lc), cl AS ({extraction_sql._LABELS_SQL.replace(GUIDANCE_CTE, _CHUNK_G, 1)}),
dl AS ({extraction_sql._LABELS_SQL})
SELECT lm.doc_id, n AS chunk_index, {_TOPIC_CASE} AS topic_primary, CASE WHEN content_type = 'general' THEN 'factual' ELSE 'procedural' END AS stored_content_type,
  citable_reference, cl.tax_years, cl.topics FROM lm JOIN cl ON cl.doc_id = lm.doc_id * 10000 + n JOIN dl ON dl.doc_id = lm.doc_id"""


# --- run log -------------------------------------------------------------------------------------------

_LOG = [
    "user_id AS run_id", "event_id", "ts",
    "CASE event_type WHEN 'signup' THEN 'status' WHEN 'purchase' THEN 'set' WHEN 'error' THEN 'error' WHEN 'view' THEN 'add' ELSE 'add' END AS kind",
    "CASE event_type WHEN 'purchase' THEN 'documents_processed' WHEN 'view' THEN 'documents_processed' WHEN 'click' THEN 'chunks_created' END AS field",
    "CASE WHEN event_type IN ('purchase', 'view', 'click') THEN cast(floor(value) as bigint) END AS amount",
    "CASE WHEN event_type = 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'completed' ELSE 'failed' END END AS status",
    "CASE WHEN event_type = 'error' THEN 'failure ' || event_id END AS message", "CASE WHEN event_type = 'error' THEN '/p/' || event_id END AS url",
]
_LOG_CTE = f"l AS (SELECT {', '.join(_LOG)} FROM events)"


def _log(spark, path):
    return read_table(spark, path, "events").selectExpr(*_LOG)


def run_states(spark, path):
    r = runlog.runs(_log(spark, path))
    return r.select("run_id", "status", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started"),
                    F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed"), "documents_processed", "chunks_created", "error_count")


_RUNS = f"""{_LOG_CTE},
st AS (SELECT run_id, arg_max(status, (ts, event_id)) AS status FROM l WHERE kind = 'status' GROUP BY 1),
ls AS (SELECT run_id, field, max((ts, event_id)) AS set_at, arg_max(amount, (ts, event_id)) AS base FROM l WHERE kind = 'set' GROUP BY 1, 2),
ad AS (SELECT l.run_id, l.field, sum(l.amount) AS added FROM l LEFT JOIN ls USING (run_id, field) WHERE kind = 'add' AND (set_at IS NULL OR (l.ts, l.event_id) > set_at) GROUP BY 1, 2),
ct AS (SELECT coalesce(ls.run_id, ad.run_id) AS run_id, coalesce(ls.field, ad.field) AS field, coalesce(base, 0) + coalesce(added, 0) AS value
       FROM ls FULL JOIN ad ON ls.run_id = ad.run_id AND ls.field = ad.field),
r AS (SELECT run_id, min(ts) AS started_at, max(ts) FILTER (WHERE kind = 'status' AND status IN ('completed', 'completed_with_errors', 'failed')) AS completed_at,
        count(*) FILTER (WHERE kind = 'error') AS error_count FROM l GROUP BY 1),
runs AS (SELECT r.run_id, st.status, started_at, completed_at, error_count,
  CAST(coalesce((SELECT sum(value) FROM ct WHERE ct.run_id = r.run_id AND field = 'documents_processed'), 0) AS BIGINT) AS documents_processed,
  CAST(coalesce((SELECT sum(value) FROM ct WHERE ct.run_id = r.run_id AND field = 'chunks_created'), 0) AS BIGINT) AS chunks_created
  FROM r LEFT JOIN st USING (run_id))"""


def run_durations(spark, path):
    return runlog.durations(runlog.runs(_log(spark, path)))


def run_error_messages(spark, path):
    return runlog.messages(_log(spark, path)).select("run_id", "message", "url")


def run_page(spark, path):
    """Second page of completed runs, newest first."""
    r = runlog.runs(_log(spark, path)).where("status = 'completed'")
    return r.orderBy(F.desc("started_at"), "run_id").offset(5).limit(5).select("run_id", "documents_processed")


def latest_successful_runs(spark, path):
    r = runlog.runs(_log(spark, path)).withColumn("source_type", F.when(F.col("error_count") > 10, "busy").otherwise("calm"))
    return runlog.latest_successful(r)


QUERIES = {
    "classify_documents": (classify_documents, f"SELECT url, {_AUTH} AS authority, {_KIND} AS document_kind, CASE {_AUTH} WHEN 'HMRC_MANUAL' THEN 1::BIGINT ELSE 2::BIGINT END AS tier, sha256(full_text) AS content_hash FROM (SELECT {', '.join(_INCOMING)} FROM documents)"),
    "change_decisions": (change_decisions, f"WITH {_IN} SELECT url, reason, content_hash FROM dec"),
    "change_decisions_skip_existing": (change_decisions_skip_existing, f"WITH {_IN} SELECT url, CASE WHEN stored THEN 'skip_existing' ELSE 'new' END AS reason FROM dec"),
    "change_decisions_force": (change_decisions_force, f"WITH {_IN} SELECT url, CASE WHEN stored THEN 'force_update' ELSE 'new' END AS reason FROM dec"),
    "ingest_two_pass": (ingest_two_pass, f"{_OUT} SELECT url, reason, action, error IS NULL AS success, chunks_created, error FROM outc"),
    "ingest_duplicate_urls": (ingest_duplicate_urls, f"""{_OUT} SELECT url, action, chunks_created, error FROM outc UNION ALL
SELECT outc.url, 'failed', 0, 'Superseded by a later row of the same url' FROM outc JOIN documents ON doc_id % 10 = 0 AND outc.url LIKE '%/' || doc_id WHERE outc.error = 'not found'
UNION ALL SELECT outc.url, 'skipped', 0, 'Superseded by a later row of the same url' FROM outc JOIN documents ON doc_id % 10 = 0 AND outc.url LIKE '%/' || doc_id WHERE outc.error IS DISTINCT FROM 'not found'"""),
    "ingest_outcomes": (ingest_outcomes, f"{_OUT} SELECT url, reason, action, error IS NULL AS success, chunks_created, error FROM outc"),
    "ingest_run_summary": (ingest_run_summary, f"{_OUT} SELECT {_SUMMARY} FROM outc"),
    "ingest_with_error_cap": (ingest_with_error_cap, f"""{_OUT} SELECT {_SUMMARY} FROM outc WHERE input_idx <= coalesce(
  (SELECT CASE WHEN count(*) = 10 THEN max(input_idx) END FROM (SELECT input_idx FROM outc WHERE failed ORDER BY input_idx LIMIT 10)), 9223372036854775807)"""),
    "ingest_errors": (ingest_errors, f"{_OUT} SELECT url, error FROM outc WHERE error IS NOT NULL"),
    "next_documents": (next_documents, f"""{_OUT}, n AS (SELECT g.*, n FROM gat g JOIN cnt USING (url))
SELECT coalesce(s.url, n.url) AS url, CASE WHEN s.url IS NOT NULL THEN 'GOV_UK' ELSE {_AUTH.replace('url', 'n.url')} END AS authority,
  CASE WHEN s.url IS NOT NULL THEN 'guidance' ELSE {_KIND} END AS document_type, CASE WHEN s.url IS NOT NULL THEN 2::BIGINT WHEN {_AUTH.replace('url', 'n.url')} = 'GOV_UK' THEN 2::BIGINT ELSE 1::BIGINT END AS tier,
  coalesce(n.title, s.title) AS title, coalesce(n.content_hash, s.content_hash) AS content_hash, CASE WHEN n.url IS NULL THEN 'Old' ELSE 'Guides' END AS hierarchy,
  CASE WHEN s.url IS NOT NULL THEN '2020-01-01' ELSE '2024-03-01' END AS published, CASE WHEN n.url IS NULL THEN '2020-01-03' ELSE '2024-06-01' END AS ingested,
  coalesce(n, 1) AS total_chunks FROM sto s FULL JOIN n ON n.url = s.url"""),
    "next_chunks": (next_chunks, f"""{_OUT}
SELECT c.doc_id AS source_url, chunk_index, md5(content) AS content_md5, {_AUTH} AS source_authority, CASE {_AUTH} WHEN 'GOV_UK' THEN 2::BIGINT ELSE 1::BIGINT END AS tier
FROM chunks c JOIN gat ON gat.url = c.doc_id
UNION ALL SELECT url, 0, md5('old'), NULL, NULL FROM sto WHERE url NOT IN (SELECT url FROM cnt)"""),
    "extraction_counts": (extraction_counts, _COUNTS_SQL),
    "extraction_totals": (extraction_totals, None),
    "extraction_totals_listed": (extraction_totals_listed, f"SELECT count(*) AS documents_processed, {', '.join(f'CAST(coalesce(sum({n}), 0) AS BIGINT) AS {n}' for n in _TOTALLED)} FROM ({_COUNTS_SQL})"),
    "document_years_and_forms": (document_years_and_forms, _YEARS_FORMS_SQL),
    "chunk_metadata_rows": (chunk_metadata_rows, _CHUNK_METADATA_SQL),
    "run_states": (run_states, f"""WITH {_RUNS} SELECT run_id, status, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started,
  strftime(completed_at, '%Y-%m-%d %H:%M:%S') AS completed, documents_processed, chunks_created, error_count FROM runs"""),
    "run_durations": (run_durations, f"WITH {_RUNS} SELECT run_id, status, date_diff('microsecond', started_at, completed_at) / 1e6 AS duration_seconds FROM runs"),
    "run_error_messages": (run_error_messages, f"WITH {_LOG_CTE} SELECT run_id, message, url FROM l WHERE kind = 'error'"),
    "run_page": (run_page, f"WITH {_RUNS} SELECT run_id, documents_processed FROM runs WHERE status = 'completed' ORDER BY started_at DESC, run_id LIMIT 5 OFFSET 5"),
    "latest_successful_runs": (latest_successful_runs, f"""WITH {_RUNS} SELECT CASE WHEN error_count > 10 THEN 'busy' ELSE 'calm' END AS source_type,
  arg_max(run_id, (started_at, run_id)) AS run_id FROM runs WHERE status = 'completed' GROUP BY 1"""),
}

"""Rows that a run stores or reports besides documents and chunks: unreadable payloads, whole manuals, edges, tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from guidemill.plans import extraction, ingest
from guidemill.queries import extraction as extraction_sql
from guidemill.queries.base import GUIDANCE_CTE, documents
from guidemill.queries.chunking import _LEGAL
from guidemill.queries.ingestion import _CHUNK_G, _per_document, _with_metadata
from guidemill.queries.page_content import _payloads, _table_pages
from guidemill.sources.payloads import source_rows
from guidemill.sources.tables import read_table, spread


def payload_errors(spark, path):
    """Of five payloads one is cut off, one missing and one no object; each keeps a row that says so."""
    broken = _payloads(spark, path).withColumn("raw", F.expr(
        "CASE page_id % 5 WHEN 0 THEN substring(raw, 1, 25) WHEN 1 THEN NULL WHEN 2 THEN '[1]' ELSE raw END"))
    return source_rows(broken).select("page_id", "title", "error")


def ingest_manual(spark, path):
    """Two whole manuals out of payloads that name their child sections; a root that cannot be found gives nothing."""
    key = F.col("c_custkey")
    child = lambda i: F.struct(F.lit("Section").alias("title"), F.concat(F.lit("/m/"), (key * 10 + i).cast("string")).alias("base_path"))
    raw = F.to_json(F.struct(
        F.concat(F.lit("/m/"), key.cast("string")).alias("base_path"), F.concat(F.lit("Manual "), key.cast("string")).alias("title"),
        F.struct(F.transform(F.sequence(F.lit(0), F.lit(9)), child).alias("children")).alias("links")))
    sources = source_rows(spread(read_table(spark, path, "customer").select("c_custkey"), "c_custkey").select(raw.alias("raw")))
    roots = spark.range(3).select(F.element_at(F.array(F.lit("/m/1"), F.lit("/m/3"), F.lit("/m/none")), (F.col("id") + 1).cast("int")).alias("node"))
    return ingest.manual_sources(sources, roots).select("base_path", "title")


def chunk_edges(spark, path):
    """References found in legal chunks as edges that wait for their target."""
    found = extraction.extract(_with_metadata(spark, path), ["references"])
    return extraction.edges(found).select("reference_id", "source_chunk_id", "reference_type", "reference_strength", "reference_text",
                                          "reference_context", "target_section_id", "is_resolved")


def stored_tables(spark, path):
    """Table rows as they are stored, with the label of their kind."""
    t = extraction.stored_tables(_table_pages(spark, path), ["c_custkey"], year=F.lit("2024-25"))
    return t.select("c_custkey", "table_type", "table_name", F.size("rows").cast("bigint").alias("row_count"))


def document_tables(spark, path):
    """Chunks, deadlines and tables per document; the tables come from the page, up to three of them."""
    counts = extraction.document_counts(extraction.extract(_with_metadata(spark, path), ["deadlines"]), "doc_id")
    table = "<p>x</p><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>"
    parsed = documents(spark, path).select("doc_id", F.expr(f"repeat('{table}', CAST(doc_id % 4 AS int))").alias("html"))
    return extraction.with_table_counts(counts, parsed, "doc_id").select("doc_id", "chunks_created", "deadlines", "tables")


_EDGE_KIND = "CASE WHEN reference_type IN ('definition', 'legislation') THEN reference_type ELSE 'see_also' END"
_CHUNK_EDGES_SQL = f"""WITH e AS ({extraction_sql._REFERENCE_SQL.replace(GUIDANCE_CTE, _CHUNK_G, 1)}),
c AS (SELECT *, sha256((doc_id // 10000) || '#' || (doc_id % 10000)) AS chunk_id FROM e)
SELECT sha256(chunk_id || '#' || reference_type || '#' || target_normalized) AS reference_id, chunk_id AS source_chunk_id, {_EDGE_KIND} AS reference_type,
  CASE reference_type WHEN 'definition' THEN 'required' WHEN 'hmrc_manual' THEN 'recommended' ELSE 'optional' END AS reference_strength, reference_text,
  left(context, 200) AS reference_context, CASE WHEN reference_type = 'hmrc_manual' THEN reference_text END AS target_section_id, false AS is_resolved FROM c"""
_DOCUMENT_TABLES_SQL = f"""WITH base AS ({_LEGAL} SELECT doc_id, count(*) AS chunks_created FROM lc GROUP BY 1),
{_per_document(extraction_sql._DEADLINES_SQL, 'deadlines')}
SELECT doc_id, coalesce(chunks_created, 0) AS chunks_created, coalesce(deadlines, 0) AS deadlines, doc_id % 4 AS tables
FROM documents LEFT JOIN base USING (doc_id) LEFT JOIN deadlines USING (doc_id)"""

QUERIES = {
    "payload_errors": (payload_errors, """SELECT page_id, CASE WHEN page_id % 5 >= 3 AND page_id % 4 <> 2 THEN 'Page ' || page_id ELSE 'Untitled' END AS title,
  CASE WHEN page_id % 5 < 3 THEN 'Payload is not readable json' END AS error FROM pages"""),
    "ingest_manual": (ingest_manual, """WITH RECURSIVE r(k) AS (SELECT c_custkey FROM customer WHERE c_custkey IN (1, 3)
UNION SELECT c_custkey FROM r JOIN customer ON c_custkey // 10 = r.k AND c_custkey > 0) SELECT '/m/' || k AS base_path, 'Manual ' || k AS title FROM r"""),
    "chunk_edges": (chunk_edges, _CHUNK_EDGES_SQL),
    "stored_tables": (stored_tables, "SELECT c_custkey, 'tax_rates' AS table_type, 'Tax Rates 2024-25' AS table_name, 2::BIGINT AS row_count FROM customer"),
    "document_tables": (document_tables, _DOCUMENT_TABLES_SQL),
}

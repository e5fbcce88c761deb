"""Stored documents, chunks and structured content: lookups, changes, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv
from guidemill.operators import lookup, store
from guidemill.plans import reports
from guidemill.sources.tables import read_table

_ID = "cast(floor({} / {}) as bigint)"
DOCS = [
    "page_id AS document_id", "url", "'Page ' || page_id AS title",
    "CASE page_id % 4 WHEN 0 THEN 'HMRC_MANUAL' WHEN 1 THEN 'UK_LEGISLATION' ELSE 'GOV_UK' END AS authority",
    "CASE page_id % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'guidance' ELSE 'NEWS' END AS document_type",
    "CASE page_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'completed' END AS ingestion_status",
    "DATE '2024-01-01' + cast(page_id % 300 as int) AS created_on",
    "CASE WHEN page_id % 6 <> 0 THEN DATE '2024-02-01' + cast(page_id % 200 as int) END AS verified_on",
    "DATE '2024-01-02' + cast(page_id % 100 as int) AS ingested_at", "page_id % 7 AS total_chunks", "length(html) AS size",
]
CHUNKS = [
    "doc_id AS chunk_id", _ID.format("doc_id", 10) + " AS document_id", "doc_id % 10 AS chunk_index",
    "'S' || lpad(cast(doc_id % 500 as string), 4, '0') AS section_id", "'Guide, ' || doc_id AS citable_reference",
    "CASE lang WHEN 'en' THEN 'VAT' WHEN 'de' THEN 'PAYE' WHEN 'fr' THEN 'Other' END AS topic_primary",
    "CASE WHEN n_chars > 2000 THEN 'factual' WHEN n_chars > 500 THEN 'procedural' END AS content_type",
    "CASE WHEN source = 'src1' THEN 'hmrc_contact' ELSE 'none' END AS service_category",
    "CASE WHEN n_chars > 1000 THEN 'v' || doc_id END AS vector_id",
    "CASE WHEN n_chars > 800 THEN 'taxable turnover,input tax' WHEN n_chars > 400 THEN 'input tax' ELSE '' END AS terms",
    "n_chars % 2 = 0 AS has_outgoing_references", "n_chars % 3 = 0 AS has_incoming_references", "n_chars % 4 = 0 AS contains_table",
    "n_chars % 5 = 0 AS contains_formula", "n_chars % 6 = 0 AS contains_decision_tree", "n_chars % 7 = 0 AS contains_deadline",
    "n_chars % 8 = 0 AS contains_example", "n_chars % 9 = 0 AS contains_contact",
]
TABLES_ = [
    "p_partkey AS table_id", _ID.format("p_partkey", 4) + " AS chunk_id", _ID.format("p_partkey", 20) + " AS document_id",
    "lower(p_type) AS table_type", "p_name AS table_name", "CASE p_size % 3 WHEN 0 THEN '2023-24' WHEN 1 THEN '2024-25' END AS tax_year",
    "CASE WHEN p_size % 4 <> 0 THEN DATE '2020-01-01' + p_size END AS effective_from", "p_retailprice AS created_at",
]
FORMULAS_ = [
    "s_suppkey AS formula_id", _ID.format("s_suppkey", 2) + " AS chunk_id",
    "CASE s_nationkey % 4 WHEN 0 THEN 'marginal_relief' WHEN 1 THEN 'tax_calculation' WHEN 2 THEN 'vat_calculation' ELSE 'penalty_calculation' END AS formula_type",
    "s_name AS formula_name", "CASE WHEN s_acctbal > 0 THEN '2024-25' ELSE '2023-24' END AS tax_year",
]
DEADLINES_ = [
    "o_orderkey AS deadline_id", _ID.format("o_orderkey", 40) + " AS chunk_id",
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'filing' WHEN '2-HIGH' THEN 'payment' WHEN '3-MEDIUM' THEN 'registration' ELSE 'notification' END AS deadline_type",
    "CASE o_orderstatus WHEN 'F' THEN 'vat' WHEN 'O' THEN 'paye' ELSE 'self_assessment' END AS tax_category",
]
EXAMPLES_ = ["c_custkey AS example_id", _ID.format("c_custkey", 4) + " AS chunk_id", "lower(c_mktsegment) AS example_category",
             "CASE WHEN c_acctbal > 0 THEN '2024-25' ELSE '2023-24' END AS tax_year"]
CONTACTS_ = ["s_suppkey AS contact_id", _ID.format("s_suppkey", 2) + " AS chunk_id", "s_name AS service_name",
             "CASE WHEN s_acctbal > 2000 THEN 'vat,paye' WHEN s_acctbal > 0 THEN 'vat' ELSE 'income_tax' END AS categories",
             "'0300 200 ' || lpad(cast(s_suppkey % 10000 as string), 4, '0') AS phone"]
LISTS_ = ["o_orderkey AS list_id", _ID.format("o_orderkey", 60) + " AS chunk_id",
          "CASE o_orderstatus WHEN 'F' THEN 'requirement' WHEN 'O' THEN 'eligibility' ELSE 'exemption' END AS condition_type",
          "CASE WHEN o_totalprice > 200000 THEN 'vat,paye' ELSE 'vat' END AS tax_types"]
TREES_ = ["s_suppkey AS tree_id", _ID.format("s_suppkey", 3) + " AS chunk_id", "'Tree ' || s_suppkey AS tree_name",
          "CASE s_nationkey % 3 WHEN 0 THEN 'registration' WHEN 1 THEN 'relief' ELSE 'payment' END AS category",
          "CASE WHEN s_acctbal > 3000 THEN 'vat,paye' ELSE 'vat' END AS tax_types"]
_SOURCE = {"dt": (TREES_, "supplier"), "d": (DOCS, "pages"), "c": (CHUNKS, "documents"), "tb": (TABLES_, "part"), "fm": (FORMULAS_, "supplier"), "dl": (DEADLINES_, "orders"),
           "ex": (EXAMPLES_, "customer"), "ct": (CONTACTS_, "supplier"), "cl": (LISTS_, "orders")}


def _frame(spark, path, name):
    columns, table = _SOURCE[name]
    return read_table(spark, path, table).selectExpr(*columns)


def _w(*names):
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(_SOURCE[n][0])} FROM {_SOURCE[n][1]})" for n in names)


# --- documents --------------------------------------------------------------------------------------

def document_lookup(spark, path):
    return store.find(_frame(spark, path, "d"), document_id=3).select("document_id", "url", "authority")


def documents_page(spark, path):
    d = store.find(_frame(spark, path, "d"), authority="GOV_UK", ingestion_status="completed")
    return store.page(d, [F.desc("created_on"), F.col("document_id")], 5, 20).select("document_id", "title")


def document_count(spark, path):
    return store.find(_frame(spark, path, "d"), document_type="manual", ingestion_status="completed").agg(F.count("*").alias("n"))


def documents_inserted(spark, path):
    d = _frame(spark, path, "d").select("document_id", "title")
    rows = read_table(spark, path, "documents").selectExpr("doc_id AS document_id", "'Added ' || doc_id AS title")
    return store.insert_new(d, rows, "document_id")


def documents_updated(spark, path):
    d = _frame(spark, path, "d").select("document_id", "title", "ingestion_status", "ingested_at", "verified_on")
    ch = _frame(spark, path, "d").where("ingestion_status = 'pending'").select(
        "document_id", F.when(F.col("size") > 2000, "New title").alias("title"), F.lit("completed").alias("ingestion_status"))
    u = store.update(d, ch, "document_id", {"ingested_at": F.lit("2025-01-01").cast("date")})
    return u.select("document_id", "title", "ingestion_status", F.date_format("ingested_at", "yyyy-MM-dd").alias("ingested"))


def documents_deleted(spark, path):
    """Remaining chunks after failed documents are deleted with all that depends on them."""
    gone = _frame(spark, path, "d").where("ingestion_status = 'failed'")
    left = store.delete_cascade({"chunks": _frame(spark, path, "c"), "tables": _frame(spark, path, "tb")}, gone, "document_id")
    return left["chunks"].selectExpr("'chunk' AS kind", "chunk_id AS id").unionByName(left["tables"].selectExpr("'table' AS kind", "table_id AS id"))


def stale_documents(spark, path):
    d = _frame(spark, path, "d")
    cutoff = F.date_sub(F.lit("2024-06-30").cast("date"), 30)
    return d.where((F.col("ingestion_status") == "completed") & (F.col("verified_on").isNull() | (F.col("verified_on") < cutoff))).select("document_id")


def document_stats(spark, path):
    s = reports.document_stats(_frame(spark, path, "d"))
    return s.withColumn("last_ingestion", F.date_format("last_ingestion", "yyyy-MM-dd"))


def document_violations(spark, path):
    d = _frame(spark, path, "d")
    return store.violations(d, {
        "authority": F.col("authority").isin(*fv.AUTHORITIES), "status": F.col("ingestion_status").isin("completed", "pending"),
        "size": F.col("size") <= 3000, "verified": F.col("verified_on").isNotNull()}, "document_id")


def _stats_sql(cte, table, columns, measures, missing="unknown"):
    parts = [f"SELECT 'total' AS breakdown, 'all' AS label, {measures} FROM {table}"]
    parts += [f"SELECT '{c}', coalesce({c}, '{missing}'), {measures} FROM {table} GROUP BY coalesce({c}, '{missing}')" for c in columns]
    return f"{cte} " + " UNION ALL ".join(parts)


# --- chunks ----------------------------------------------------------------------------------------------

def chunks_by_sections(spark, path):
    """Chunks of the sections that orders of one status name."""
    ids = read_table(spark, path, "orders").where("o_orderstatus = 'P'").selectExpr("'S' || lpad(cast(o_custkey % 700 as string), 4, '0') AS section_id")
    return store.keep_listed(_frame(spark, path, "c"), ids, "section_id").select("chunk_id", "section_id")


def chunks_of_document(spark, path):
    return store.page(store.find(_frame(spark, path, "c"), document_id=2), [F.col("chunk_index")], 2, 5).select("chunk_id", "chunk_index")


def chunks_by_topic(spark, path):
    return store.page(store.find(_frame(spark, path, "c"), topic_primary="VAT"), [F.col("chunk_id")], 20, 100).select("chunk_id")


def chunks_pending_embedding(spark, path):
    return _frame(spark, path, "c").where("vector_id IS NULL").select("chunk_id")


def chunks_defining_term(spark, path):
    return _frame(spark, path, "c").where(F.array_contains(F.split("terms", ","), "taxable turnover")).select("chunk_id")


def chunks_embedded(spark, path):
    c = _frame(spark, path, "c").select("chunk_id", "vector_id", F.lit(None).cast("string").alias("embedding_model"))
    done = read_table(spark, path, "embeddings").selectExpr("vec_id AS chunk_id", "'e' || vec_id AS vector_id")
    return store.update(c, done, "chunk_id", {"embedding_model": F.lit("small")})


def chunks_embedded_count(spark, path):
    done = read_table(spark, path, "embeddings").selectExpr("vec_id AS chunk_id")
    return store.matched_count(_frame(spark, path, "c"), done, "chunk_id")


def chunks_deleted(spark, path):
    gone = _frame(spark, path, "d").where("document_type = 'NEWS'")
    return store.delete(_frame(spark, path, "c"), gone, "document_id").select("chunk_id")


def chunk_store_stats(spark, path):
    return reports.chunk_stats(_frame(spark, path, "c"))


def documents_by_topic(spark, path):
    return reports.documents_by_topic(_frame(spark, path, "c"))


def chunks_with_tables(spark, path):
    return _frame(spark, path, "c").where("contains_table AND topic_primary = 'VAT'").select("chunk_id")


def chunks_with_deadlines(spark, path):
    """Chunks with a deadline of one tax category."""
    dl = store.find(_frame(spark, path, "dl"), tax_category="paye")
    return store.keep_listed(_frame(spark, path, "c"), dl, "chunk_id").select("chunk_id")


def chunk_content_flags(spark, path):
    """Flags derived from the structured rows instead of stored by hand; keys are reduced before the join."""
    kinds = {"contains_table": "tb", "contains_formula": "fm", "contains_deadline": "dl", "contains_example": "ex", "contains_contact": "ct",
             "contains_condition_list": "cl", "contains_decision_tree": "dt"}
    marks = None
    for flag, name in kinds.items():
        one = _frame(spark, path, name).select("chunk_id", F.lit(flag).alias("flag"))
        marks = one if marks is None else marks.unionByName(one)
    flags = marks.groupBy("chunk_id").agg(*[F.bool_or(F.col("flag") == f).alias(f) for f in kinds])
    return _frame(spark, path, "c").select("chunk_id").join(flags, "chunk_id", "left").fillna(False, list(kinds))


def chunk_vector_metadata(spark, path):
    c = _frame(spark, path, "c").withColumn("keywords", F.filter(F.split("terms", ","), lambda t: t != ""))
    m = store.metadata_json(c, ["document_id", "section_id", "citable_reference", "topic_primary", "content_type", "service_category",
                                "keywords", "has_outgoing_references", "chunk_index"],
                            {"topic_primary": "Other", "content_type": "factual", "service_category": "none"})
    return m.select("chunk_id", F.size(F.json_object_keys("metadata")).cast("bigint").alias("key_count"),
                    *[F.get_json_object("metadata", f"$.{k}").alias(k) for k in ("topic_primary", "content_type", "keywords", "has_outgoing_references")])


# --- structured content -------------------------------------------------------------------------------------

def tables_by_type(spark, path):
    return store.find(_frame(spark, path, "tb"), table_type="economy", tax_year="2024-25").select("table_id", "table_name")


def current_tables(spark, path):
    return lookup.current_tables(_frame(spark, path, "tb"), store.name_contains("table_name", "RED")).select("table_type", "table_id")


def formulas_by_type(spark, path):
    return store.find(_frame(spark, path, "fm"), formula_type="marginal_relief", tax_year="2024-25").select("formula_id")


def formulas_by_name(spark, path):
    return _frame(spark, path, "fm").where(store.name_contains("formula_name", "er#00000001")).select("formula_id", "formula_name")


def deadlines_by_category(spark, path):
    return store.find(_frame(spark, path, "dl"), tax_category="vat", deadline_type="filing").select("deadline_id")


def examples_by_category(spark, path):
    return store.find(_frame(spark, path, "ex"), example_category="machinery", tax_year="2024-25").select("example_id")


def contacts_by_category(spark, path):
    return _frame(spark, path, "ct").where(F.array_contains(F.split("categories", ","), "paye")).select("contact_id", "phone")


def contact_first_phones(spark, path):
    methods = F.array(
        F.struct(F.lit("email").alias("type"), F.concat("service_name", F.lit("@hmrc.gov.uk")).alias("value")),
        F.struct(F.lit("phone").alias("type"), F.col("phone").alias("value")))
    return lookup.first_phone(_frame(spark, path, "ct").withColumn("contact_methods", methods), "contact_id")


def condition_lists_by_type(spark, path):
    return _frame(spark, path, "cl").where("condition_type = 'requirement'").where(
        F.array_contains(F.split("tax_types", ","), "paye")).select("list_id")


_KINDS = {"tables": ("tb", "table_id", "table_type"), "formulas": ("fm", "formula_id", "formula_type"), "deadlines": ("dl", "deadline_id", "deadline_type"),
          "examples": ("ex", "example_id", "example_category"), "contacts": ("ct", "contact_id", "categories"), "condition_lists": ("cl", "list_id", "condition_type"), "decision_trees": ("dt", "tree_id", "category")}
_ALL_KINDS = _w(*[v[0] for v in _KINDS.values()])


def content_of_chunks(spark, path):
    return reports.attached_to_chunks({k: _frame(spark, path, v[0]) for k, v in _KINDS.items()}, {}).drop("has_structured_content")


def content_items_of_chunks(spark, path):
    return reports.attached_items({k: _frame(spark, path, v[0]) for k, v in _KINDS.items()}, {k: v[1] for k, v in _KINDS.items()})


def content_deleted(spark, path):
    """Counts by kind removed with the chunks of one service."""
    gone = _frame(spark, path, "c").where("service_category = 'hmrc_contact'").select("chunk_id")
    out = None
    for kind, (name, *_rest) in _KINDS.items():
        one = store.matched_count(_frame(spark, path, name), gone, "chunk_id").select(F.lit(kind).alias("kind"), "matched")
        out = one if out is None else out.unionByName(one)
    return out


def structured_stats(spark, path):
    return reports.structured_stats({k: (_frame(spark, path, v[0]), v[2]) for k, v in _KINDS.items()})


_DOC_MEASURES = "count(*) AS document_count, CAST(coalesce(sum(total_chunks), 0) AS BIGINT) AS chunk_total, strftime(max(ingested_at), '%Y-%m-%d') AS last_ingestion"
_CHUNK_MEASURES = ("count(*) AS chunk_count, count(vector_id) AS embedded, count(*) - count(vector_id) AS pending, "
                   + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in reports.CHUNK_FLAGS.items()))
QUERIES = {
    "document_lookup": (document_lookup, _w("d") + " SELECT document_id, url, authority FROM d WHERE document_id = 3"),
    "documents_page": (documents_page, _w("d") + " SELECT document_id, title FROM d WHERE authority = 'GOV_UK' AND ingestion_status = 'completed' ORDER BY created_on DESC, document_id LIMIT 20 OFFSET 5"),
    "document_count": (document_count, _w("d") + " SELECT count(*) AS n FROM d WHERE document_type = 'manual' AND ingestion_status = 'completed'"),
    "documents_inserted": (documents_inserted, _w("d") + " SELECT document_id, title FROM d UNION ALL SELECT doc_id, 'Added ' || doc_id FROM documents WHERE doc_id NOT IN (SELECT document_id FROM d)"),
    "documents_updated": (documents_updated, _w("d") + """ SELECT document_id, CASE WHEN ingestion_status = 'pending' AND size > 2000 THEN 'New title' ELSE title END AS title,
  CASE WHEN ingestion_status = 'pending' THEN 'completed' ELSE ingestion_status END AS ingestion_status,
  strftime(CASE WHEN ingestion_status = 'pending' THEN DATE '2025-01-01' ELSE ingested_at END, '%Y-%m-%d') AS ingested FROM d"""),
    "documents_deleted": (documents_deleted, _w("d", "c", "tb") + """, x AS (SELECT document_id FROM d WHERE ingestion_status = 'failed')
SELECT 'chunk' AS kind, chunk_id AS id FROM c WHERE document_id NOT IN (FROM x) UNION ALL SELECT 'table', table_id FROM tb WHERE document_id NOT IN (FROM x)"""),
    "stale_documents": (stale_documents, _w("d") + " SELECT document_id FROM d WHERE ingestion_status = 'completed' AND (verified_on IS NULL OR verified_on < DATE '2024-06-30' - 30)"),
    "document_stats": (document_stats, _stats_sql(_w("d"), "d", ["authority", "ingestion_status"], _DOC_MEASURES)),
    "document_violations": (document_violations, _w("d") + """ SELECT document_id, 'status' AS rule FROM d WHERE ingestion_status NOT IN ('completed', 'pending')
UNION ALL SELECT document_id, 'size' FROM d WHERE size > 3000 UNION ALL SELECT document_id, 'verified' FROM d WHERE verified_on IS NULL"""),
    "chunks_by_sections": (chunks_by_sections, _w("c") + " SELECT chunk_id, section_id FROM c WHERE section_id IN (SELECT 'S' || lpad(cast(o_custkey % 700 as string), 4, '0') FROM orders WHERE o_orderstatus = 'P')"),
    "chunks_of_document": (chunks_of_document, _w("c") + " SELECT chunk_id, chunk_index FROM c WHERE document_id = 2 ORDER BY chunk_index LIMIT 5 OFFSET 2"),
    "chunks_by_topic": (chunks_by_topic, _w("c") + " SELECT chunk_id FROM c WHERE topic_primary = 'VAT' ORDER BY chunk_id LIMIT 100 OFFSET 20"),
    "chunks_pending_embedding": (chunks_pending_embedding, _w("c") + " SELECT chunk_id FROM c WHERE vector_id IS NULL"),
    "chunks_defining_term": (chunks_defining_term, _w("c") + " SELECT chunk_id FROM c WHERE list_contains(string_split(terms, ','), 'taxable turnover')"),
    "chunks_embedded": (chunks_embedded, _w("c") + " SELECT chunk_id, coalesce('e' || vec_id, vector_id) AS vector_id, CASE WHEN vec_id IS NOT NULL THEN 'small' END AS embedding_model FROM c LEFT JOIN embeddings ON vec_id = chunk_id"),
    "chunks_embedded_count": (chunks_embedded_count, _w("c") + " SELECT count(*) AS matched FROM c WHERE chunk_id IN (SELECT vec_id FROM embeddings)"),
    "chunks_deleted": (chunks_deleted, _w("c", "d") + " SELECT chunk_id FROM c WHERE document_id NOT IN (SELECT document_id FROM d WHERE document_type = 'NEWS')"),
    "chunk_store_stats": (chunk_store_stats, _stats_sql(_w("c"), "c", ["topic_primary", "content_type", "service_category"], _CHUNK_MEASURES)),
    "documents_by_topic": (documents_by_topic, _w("c") + " SELECT coalesce(topic_primary, 'unknown') AS topic, count(DISTINCT document_id) AS document_count FROM c GROUP BY 1"),
    "chunks_with_tables": (chunks_with_tables, _w("c") + " SELECT chunk_id FROM c WHERE contains_table AND topic_primary = 'VAT'"),
    "chunks_with_deadlines": (chunks_with_deadlines, _w("c", "dl") + " SELECT chunk_id FROM c WHERE chunk_id IN (SELECT chunk_id FROM dl WHERE tax_category = 'paye')"),
    "chunk_content_flags": (chunk_content_flags, _w("c", "tb", "fm", "dl", "ex", "ct", "cl", "dt") + """ SELECT chunk_id, chunk_id IN (SELECT chunk_id FROM tb) AS contains_table,
  chunk_id IN (SELECT chunk_id FROM fm) AS contains_formula, chunk_id IN (SELECT chunk_id FROM dl) AS contains_deadline, chunk_id IN (SELECT chunk_id FROM ex) AS contains_example,
  chunk_id IN (SELECT chunk_id FROM ct) AS contains_contact, chunk_id IN (SELECT chunk_id FROM cl) AS contains_condition_list,
  chunk_id IN (SELECT chunk_id FROM dt) AS contains_decision_tree FROM c"""),
    "chunk_vector_metadata": (chunk_vector_metadata, _w("c") + """ SELECT chunk_id, CAST(8 + CASE WHEN terms <> '' THEN 1 ELSE 0 END AS BIGINT) AS key_count,
  coalesce(topic_primary, 'Other') AS topic_primary, coalesce(content_type, 'factual') AS content_type,
  CASE WHEN terms <> '' THEN '["' || replace(terms, ',', '","') || '"]' END AS keywords, CAST(has_outgoing_references AS VARCHAR) AS has_outgoing_references FROM c"""),
    "tables_by_type": (tables_by_type, _w("tb") + " SELECT table_id, table_name FROM tb WHERE table_type = 'economy' AND tax_year = '2024-25'"),
    "current_tables": (current_tables, _w("tb") + """ SELECT table_type, table_id FROM (SELECT *, row_number() OVER (PARTITION BY table_type
  ORDER BY effective_from DESC NULLS LAST, created_at DESC, table_id DESC) AS rn FROM tb WHERE table_name ILIKE '%red%') WHERE rn = 1"""),
    "formulas_by_type": (formulas_by_type, _w("fm") + " SELECT formula_id FROM fm WHERE formula_type = 'marginal_relief' AND tax_year = '2024-25'"),
    "formulas_by_name": (formulas_by_name, _w("fm") + " SELECT formula_id, formula_name FROM fm WHERE formula_name ILIKE '%er#00000001%'"),
    "deadlines_by_category": (deadlines_by_category, _w("dl") + " SELECT deadline_id FROM dl WHERE tax_category = 'vat' AND deadline_type = 'filing'"),
    "examples_by_category": (examples_by_category, _w("ex") + " SELECT example_id FROM ex WHERE example_category = 'machinery' AND tax_year = '2024-25'"),
    "contacts_by_category": (contacts_by_category, _w("ct") + " SELECT contact_id, phone FROM ct WHERE list_contains(string_split(categories, ','), 'paye')"),
    "contact_first_phones": (contact_first_phones, _w("ct") + " SELECT contact_id, phone FROM ct"),
    "condition_lists_by_type": (condition_lists_by_type, _w("cl") + " SELECT list_id FROM cl WHERE condition_type = 'requirement' AND list_contains(string_split(tax_types, ','), 'paye')"),
    "content_of_chunks": (content_of_chunks, _ALL_KINDS + ", u AS (" + " UNION ALL ".join(f"SELECT chunk_id, '{k}' AS kind FROM {v[0]}" for k, v in _KINDS.items())
                          + ") SELECT chunk_id, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in _KINDS) + " FROM u GROUP BY 1"),
    "content_items_of_chunks": (content_items_of_chunks, _ALL_KINDS + " " + " UNION ALL ".join(
        f"SELECT chunk_id, '{k}' AS kind, CAST({v[1]} AS VARCHAR) AS item_id FROM {v[0]}" for k, v in _KINDS.items())),
    "content_deleted": (content_deleted, _ALL_KINDS + f", c AS (SELECT {', '.join(CHUNKS)} FROM documents), x AS (SELECT chunk_id FROM c WHERE service_category = 'hmrc_contact') " + " UNION ALL ".join(
        f"SELECT '{k}' AS kind, count(*) AS matched FROM {v[0]} WHERE chunk_id IN (FROM x)" for k, v in _KINDS.items())),
    "structured_stats": (structured_stats, _ALL_KINDS + " " + " UNION ALL ".join(
        f"SELECT '{k}' AS kind, coalesce({v[2]}, 'unknown') AS type, count(*) AS item_count FROM {v[0]} GROUP BY 2 UNION ALL SELECT '{k}', 'all', count(*) FROM {v[0]}"
        for k, v in _KINDS.items())),
}

"""Order index, maintained reference graph, merged metadata and documents with open keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from guidemill.operators import graph_delta, merge_state, metadata, open_documents, paging
from guidemill.queries import history, reference_graph, storage
from guidemill.queries.base import guidance
from guidemill.queries.extraction import _LABELS_SQL
from guidemill.sources.tables import read_table

# --- pages -----------------------------------------------------------------------------------------

_NEWEST = [("created_on", False), ("document_id", True)]
_LOG_ORDER = [("ts", False), ("log_id", False)]


def _document_order(spark, path):
    return paging.build_order(storage._frame(spark, path, "d").select("document_id", "title", "created_on"), _NEWEST)


def documents_numbered(spark, path):
    """Position of every document, newest first."""
    return paging.with_position(_document_order(spark, path)).select("document_id", "position")


def documents_middle_page(spark, path):
    """Fifty documents from the middle of the list on."""
    index = _document_order(spark, path)
    return paging.page(index, paging.row_total(index) // 2, 50).select("document_id", "title")


def audit_page_keys(spark, path):
    """First key of every page of 500 log rows, newest first."""
    rows = read_table(spark, path, "events").selectExpr("event_id AS log_id", "ts")
    return paging.page_keys(paging.build_order(rows, _LOG_ORDER), 500).select("page", "log_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("logged"))


def audit_after_key(spark, path):
    """The 100 log rows that follow the newest log row with a long answer."""
    logs = history.logs(spark, path).select("log_id", "ts", "user_id", "latency_ms")
    last = logs.where("latency_ms > 900").orderBy(*paging.sort_columns(_LOG_ORDER)).limit(1).collect()
    key = last[0].asDict() if last else None
    return paging.page_after(logs, _LOG_ORDER, key, 100).select("log_id", "user_id")


# --- reference graph -------------------------------------------------------------------------------

_CHUNK_CHANGE = "chunk_id % 7 = 3"
_CHUNK_GONE = "chunk_id % 11 = 5"
_EDGE_CHANGE = "reference_id % 5 = 1"
_EDGE_GONE = "reference_id % 13 = 2"
_NEW_SECTION = "'S' || (chunk_id + 1)"


def _maintained(spark, path):
    """The graph of all parts after sections moved, chunks and edges went and edges were withdrawn to wait for their section."""
    edges, chunks = reference_graph.edges(spark, path).select(*graph_delta.EDGE), reference_graph.chunks(spark, path)
    put = edges.where(_EDGE_CHANGE).withColumns({"is_resolved": F.lit(False), "target_chunk_id": F.lit(None).cast("bigint")})
    return graph_delta.apply_changes(
        graph_delta.build(chunks, edges), put, edges.where(_EDGE_GONE).select("reference_id"),
        chunks.where(_CHUNK_CHANGE).select("chunk_id", F.expr(_NEW_SECTION).alias("section_id")), chunks.where(_CHUNK_GONE).select("chunk_id"))


def references_maintained(spark, path):
    return _maintained(spark, path).edges.select("reference_id", "source_chunk_id", F.col("found").alias("target_chunk_id"))


def reference_degrees_maintained(spark, path):
    return _maintained(spark, path).degrees


def reference_flags_maintained(spark, path):
    return graph_delta.with_flags(_maintained(spark, path))


_MAINTAINED = f"""WITH {reference_graph._EDGES},
k AS (SELECT chunk_id, CASE WHEN {_CHUNK_CHANGE} THEN {_NEW_SECTION} ELSE section_id END AS section_id FROM c WHERE NOT ({_CHUNK_GONE})),
gone AS (SELECT chunk_id FROM c WHERE {_CHUNK_GONE}),
f AS (SELECT section_id, min(chunk_id) AS first FROM k WHERE section_id IS NOT NULL GROUP BY 1),
w AS (SELECT reference_id, source_chunk_id, target_section_id, CASE WHEN {_EDGE_CHANGE} THEN NULL WHEN is_resolved THEN target_chunk_id END AS own,
  is_resolved AND NOT ({_EDGE_CHANGE}) AS done FROM e WHERE NOT ({_EDGE_GONE})),
m AS (SELECT reference_id, source_chunk_id, CASE WHEN done THEN own ELSE first END AS target_chunk_id FROM w LEFT JOIN f ON f.section_id = target_section_id
  WHERE source_chunk_id NOT IN (FROM gone) AND (own IS NULL OR own NOT IN (FROM gone))),
g AS (SELECT chunk_id, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming FROM (SELECT source_chunk_id AS chunk_id, 1 AS o, 0 AS i FROM m
  UNION ALL SELECT target_chunk_id, 0, 1 FROM m WHERE target_chunk_id IS NOT NULL) GROUP BY 1)"""


# --- metadata --------------------------------------------------------------------------------------

_MERGED_SETS = ("tax_years", "topics", "business_types")


def metadata_merged(spark, path):
    """Label sets of all documents of a source in order of first appearance, newest language; odd and even documents come as two states."""
    rows = metadata.with_metadata(guidance(spark, path)).select("source", "doc_id", "lang", *_MERGED_SETS)
    states = [merge_state.merge_state(rows.where(F.col("doc_id") % 2 == k), ["source"], "doc_id", _MERGED_SETS, (), ("lang",)) for k in (0, 1)]
    merged = merge_state.merged_labels(merge_state.combine(states, ["source"]), ["source"], _MERGED_SETS, ("lang",))
    return merged.select("source", "lang", *[F.array_join(c, "|").alias(c) for c in _MERGED_SETS])


def _first_seen(name: str) -> str:
    return (f"SELECT source, '{name}' AS k, v, min(doc_id * 1000 + i) AS seen FROM (SELECT source, doc_id, unnest(string_split({name}, '|')) AS v, "
            f"generate_subscripts(string_split({name}, '|'), 1) AS i FROM d) WHERE v <> '' GROUP BY source, v")


_MERGED_SQL = f"""WITH l AS ({_LABELS_SQL}), d AS (SELECT source, lang, l.* FROM l JOIN documents USING (doc_id)),
u AS ({" UNION ALL ".join(map(_first_seen, _MERGED_SETS))}),
s AS (SELECT source, max_by(lang, doc_id) FILTER (WHERE lang IS NOT NULL) AS lang FROM d GROUP BY source)
SELECT source, s.lang, {", ".join(f"coalesce((SELECT string_agg(v, '|' ORDER BY seen) FROM u WHERE k = '{n}' AND u.source IS NOT DISTINCT FROM s.source), '') AS {n}" for n in _MERGED_SETS)} FROM s"""


# --- open keys -------------------------------------------------------------------------------------

# Field, and the expression over the chunk table in both dialects; '{}' makes a list of a text cut at bars.
_ROW = {
    "source_url": "'https://example.org/' || chunk_id", "source_authority": "CASE WHEN chunk_index > 3 THEN 'GOV_UK' END", "section_title": "CASE chunk_index WHEN 1 THEN '' WHEN 2 THEN 'Two' END",
    "heading_path": "'Guide > ' || chunk_index", "paragraph_number": "CASE WHEN chunk_index % 2 = 0 THEN '1.' || chunk_index ELSE '' END",
    "topic_secondary": "{terms}", "business_types": "{CASE WHEN chunk_index > 5 THEN 'sole trader|partnership' ELSE '' END}", "reliability_tier": "chunk_index % 4",
    "tax_year": "CASE WHEN has_incoming_references THEN '2024-25' ELSE '' END", "publication_date": "CASE WHEN chunk_index <> 4 THEN DATE '2024-04-06' + cast(chunk_index as int) END",
    "keywords": "{terms}", "form_references": "{CASE WHEN contains_table THEN 'SA100|P11D' ELSE '' END}", "applies_to_tax_years": "{CASE WHEN contains_formula THEN '2023-24|2024-25' ELSE '' END}",
    "structured_content_types": "{CASE WHEN contains_contact THEN 'contact' ELSE '' END}", "requires_professional_advice": "chunk_index = 9",
    "deadline_sensitive": "CASE WHEN chunk_index < 8 THEN contains_deadline END", "penalty_relevant": "chunk_index = 2",
}
_GIVEN = ["document_id", "section_id", "citable_reference", "topic_primary", "content_type", "service_category", "has_outgoing_references", "has_incoming_references", "contains_table",
          "contains_formula", "contains_decision_tree", "contains_deadline", "contains_example", "contains_contact", "chunk_index"]
_MORE = "CASE WHEN chunk_index = 6 THEN '{\"shelf\":\"s' || chunk_id || '\",\"content_type\":\"own\"}' WHEN chunk_index = 7 THEN 'none' END"


def _row_columns(cut: str) -> dict[str, str]:
    """Expression per field; lists are cut by the function ``cut``."""
    return {n: cut.format(e[1:-1]) if e.startswith("{") else e for n, e in _ROW.items()}


def vector_row_fields(spark, path):
    """Every key of the vector-store row of every chunk, with its value as json."""
    columns = _row_columns("filter(split(replace({}, ',', '|'), '[|]'), x -> x <> '')")
    c = storage._frame(spark, path, "c").selectExpr("chunk_id", *_GIVEN, *[f"{e} AS {n}" for n, e in columns.items()], f"{_MORE} AS more")
    return open_documents.entries(open_documents.vector_rows(c, more="more"), "chunk_id", "metadata")


def _row_sql() -> str:
    defaults = {"topic_primary": "Other", "content_type": "factual", "service_category": "none"}
    parts = []
    for name, e in {**{n: n for n in _GIVEN}, **_row_columns("list_filter(string_split(replace({}, ',', '|'), '|'), lambda x: x <> '')")}.items():
        value = f"coalesce({e}, '{defaults[name]}')" if name in defaults else e
        value = f"cast({value} AS VARCHAR)" if name == "publication_date" else value
        parts.append(f"SELECT chunk_id, '{name}' AS name, cast(to_json({value}) AS VARCHAR) AS value FROM c")
    more = "SELECT chunk_id, 'shelf' AS name, '\"s' || chunk_id || '\"' AS value FROM c WHERE chunk_index = 6"
    return storage._w("c") + f" SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE value NOT IN ('null', '\"\"', '[]') UNION ALL {more}"


QUERIES = {
    "documents_numbered": (documents_numbered, storage._w("d") + " SELECT document_id, row_number() OVER (ORDER BY created_on DESC, document_id) - 1 AS position FROM d"),
    "documents_middle_page": (documents_middle_page, storage._w("d") + """ SELECT document_id, title FROM (SELECT *, row_number() OVER (ORDER BY created_on DESC, document_id) - 1 AS n, count(*) OVER () AS total FROM d)
WHERE n >= total // 2 AND n < total // 2 + 50"""),
    "audit_page_keys": (audit_page_keys, """SELECT n // 500 AS page, log_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS logged FROM (SELECT event_id AS log_id, ts, row_number() OVER (ORDER BY ts DESC NULLS LAST, event_id DESC) - 1 AS n FROM events) WHERE n % 500 = 0"""),
    "audit_after_key": (audit_after_key, f"""{history._L}, k AS (SELECT ts, log_id FROM l WHERE latency_ms > 900 ORDER BY ts DESC, log_id DESC LIMIT 1)
SELECT l.log_id, l.user_id FROM l WHERE NOT EXISTS (FROM k) OR (l.ts, l.log_id) < (SELECT (ts, log_id) FROM k) ORDER BY l.ts DESC, l.log_id DESC LIMIT 100"""),
    "references_maintained": (references_maintained, _MAINTAINED + " SELECT * FROM m"),
    "reference_degrees_maintained": (reference_degrees_maintained, _MAINTAINED + " SELECT * FROM g"),
    "reference_flags_maintained": (reference_flags_maintained, _MAINTAINED + """ SELECT chunk_id, coalesce(outgoing, 0) > 0 AS has_outgoing_references,
  coalesce(incoming, 0) > 0 AS has_incoming_references FROM k LEFT JOIN g USING (chunk_id)"""),
    "metadata_merged": (metadata_merged, _MERGED_SQL),
    "vector_row_fields": (vector_row_fields, _row_sql()),
}

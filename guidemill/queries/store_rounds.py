"""Remaining reads of the stores, and one round of insert, update and delete for each kind of row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv
from guidemill.operators import conditions, references, store
from guidemill.plans import extraction
from guidemill.queries.base import GUIDANCE_CTE, guidance
from guidemill.queries.storage import _KINDS, _frame, _w


def _per_kind(spark, path, one) -> DataFrame:
    """Rows of ``one(kind, frame, id column, type column)`` over all kinds."""
    return reduce(DataFrame.unionByName, [one(k, _frame(spark, path, n), i, t) for k, (n, i, t) in _KINDS.items()])


def structured_inserted(spark, path):
    """New rows for ids up to 50 beyond the first: known ids stay as they are."""
    def one(kind, df, id_, type_):
        new = df.where(F.col(id_) <= 50).select((F.col(id_) * 3).alias(id_), F.lit("added").alias(type_))
        return store.insert_new(df.select(id_, type_), new, id_).select(F.lit(kind).alias("kind"), F.col(id_).alias("id"), F.col(type_).alias("type"))

    return _per_kind(spark, path, one)


def structured_updated(spark, path):
    """Every fifth row gets a new type, every tenth none."""
    def one(kind, df, id_, type_):
        changes = df.where(F.col(id_) % 5 == 0).select(id_, F.when(F.col(id_) % 10 != 0, "changed").alias(type_))
        return store.update(df.select(id_, type_), changes, id_).select(F.lit(kind).alias("kind"), F.col(id_).alias("id"), F.col(type_).alias("type"))

    return _per_kind(spark, path, one)


def structured_deleted(spark, path):
    """What is left of each kind when the chunks of one service go."""
    gone = _frame(spark, path, "c").where("service_category = 'hmrc_contact'").select("chunk_id")
    return _per_kind(spark, path, lambda kind, df, id_, type_: store.delete(df, gone, "chunk_id").select(F.lit(kind).alias("kind"), F.col(id_).alias("id")))


def structured_of_chunk(spark, path):
    return _per_kind(spark, path, lambda kind, df, id_, type_: store.find(df, chunk_id=7).select(F.lit(kind).alias("kind"), F.col(id_).alias("id")))


def tables_of_document(spark, path):
    return store.find(_frame(spark, path, "tb"), document_id=4).select("table_id", "table_name")


def decision_trees_by_category(spark, path):
    trees = store.find(_frame(spark, path, "dt"), category="registration")
    return trees.where(F.array_contains(F.split("tax_types", ","), "paye")).select("tree_id", "tree_name")


def contacts_by_service(spark, path):
    return _frame(spark, path, "ct").where(store.name_contains("service_name", "#00000000")).select("contact_id", "service_name")


def chunks_inserted(spark, path):
    """Customers come in as chunks; ids that are stored already do not."""
    new = spark.read.parquet(f"{path}/customer.parquet").selectExpr("c_custkey * 7 AS chunk_id", "'PAYE' AS topic_primary")
    return store.insert_new(_frame(spark, path, "c").select("chunk_id", "section_id", "topic_primary"), new, "chunk_id")


def chunk_lookups(spark, path):
    """By id, by vector id and by section id."""
    c = _frame(spark, path, "c")
    found = {"id": store.find(c, chunk_id=5), "vector": store.find(c, vector_id="v20"), "section": store.find(c, section_id="S0010")}
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("by"), "chunk_id") for k, df in found.items()])


FLAGS = {"outgoing": "has_outgoing_references", "incoming": "has_incoming_references", "formulas": "contains_formula", "decision_trees": "contains_decision_tree",
         "contacts": "contains_contact", "examples": "contains_example"}


def chunks_by_flag(spark, path):
    """One row per chunk and flag that it carries."""
    marks = F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for n, c in FLAGS.items()]))
    return _frame(spark, path, "c").select("chunk_id", F.explode_outer(marks).alias("flag")).where("flag IS NOT NULL")


def reference_probes(spark, path):
    """Whether a document can hold condition lists or references at all."""
    t = F.col("text")
    return guidance(spark, path).select("doc_id", conditions.has_condition_lists(t).alias("has_condition_lists"), references.has_references(t).alias("has_references"))


def extraction_errors(spark, path):
    """Rows that no extractor can read: every third text is blanked or missing."""
    c = _frame(spark, path, "c").select("chunk_id", F.expr("CASE WHEN chunk_id % 3 = 0 THEN NULL WHEN chunk_id % 3 = 1 THEN '  ' ELSE citable_reference END").alias("content"))
    return extraction.bad_rows(c)


_WIDE = ("|".join(fv.MANUAL_ID_PATTERNS.values()) + r"|(?:see|refer\s+to|section|paragraph|para\.?|explained\s+in|described\s+in|set\s+out\s+in)\s+"
         r"|\bAct\s+[0-9]{4}|S\.?I\.?\s*[0-9]{4}/[0-9]+|(?:Regulation|Directive)\s+[0-9]+/[0-9]+"
         r"|['\"]\s+(?:as\s+defined|has\s+the\s+meaning|means|is\s+defined)|within\s+the\s+meaning\s+of").replace("'", "''")
_EVERY = _w(*[v[0] for v in _KINDS.values()])


def _union(one) -> str:
    return " UNION ALL ".join(one(k, n, i, t) for k, (n, i, t) in _KINDS.items())


QUERIES = {
    "structured_inserted": (structured_inserted, f"{_EVERY} " + _union(lambda k, n, i, t: f"SELECT '{k}' AS kind, {i} AS id, {t} AS type FROM {n} UNION ALL SELECT DISTINCT '{k}', {i} * 3, 'added' FROM {n} WHERE {i} <= 50 AND {i} * 3 NOT IN (SELECT {i} FROM {n})")),
    "structured_updated": (structured_updated, f"{_EVERY} " + _union(lambda k, n, i, t: f"SELECT '{k}' AS kind, {i} AS id, CASE WHEN {i} % 5 = 0 AND {i} % 10 <> 0 THEN 'changed' ELSE {t} END AS type FROM {n}")),
    "structured_deleted": (structured_deleted, f"{_w('c', *[v[0] for v in _KINDS.values()])} " + _union(lambda k, n, i, t: f"SELECT '{k}' AS kind, {i} AS id FROM {n} WHERE chunk_id NOT IN (SELECT chunk_id FROM c WHERE service_category = 'hmrc_contact')")),
    "structured_of_chunk": (structured_of_chunk, f"{_EVERY} " + _union(lambda k, n, i, t: f"SELECT '{k}' AS kind, {i} AS id FROM {n} WHERE chunk_id = 7")),
    "tables_of_document": (tables_of_document, _w("tb") + " SELECT table_id, table_name FROM tb WHERE document_id = 4"),
    "decision_trees_by_category": (decision_trees_by_category, _w("dt") + " SELECT tree_id, tree_name FROM dt WHERE category = 'registration' AND tax_types LIKE '%paye%'"),
    "contacts_by_service": (contacts_by_service, _w("ct") + " SELECT contact_id, service_name FROM ct WHERE service_name LIKE '%#00000000%'"),
    "chunks_inserted": (chunks_inserted, _w("c") + " SELECT chunk_id, section_id, topic_primary FROM c UNION ALL SELECT c_custkey * 7, NULL, 'PAYE' FROM customer WHERE c_custkey * 7 NOT IN (SELECT chunk_id FROM c)"),
    "chunk_lookups": (chunk_lookups, _w("c") + " SELECT 'id' AS by, chunk_id FROM c WHERE chunk_id = 5 UNION ALL SELECT 'vector', chunk_id FROM c WHERE vector_id = 'v20' UNION ALL SELECT 'section', chunk_id FROM c WHERE section_id = 'S0010'"),
    "chunks_by_flag": (chunks_by_flag, _w("c") + " " + " UNION ALL ".join(f"SELECT chunk_id, '{n}' AS flag FROM c WHERE {c}" for n, c in FLAGS.items())),
    "reference_probes": (reference_probes, f"WITH {GUIDANCE_CTE} SELECT doc_id, regexp_matches(text, '(?i)\\bif\\b|\\bunless\\b|of\\s+the\\s+following|if[:\\s]') AS has_condition_lists, regexp_matches(text, '(?i){_WIDE}') AS has_references FROM g"),
    "extraction_errors": (extraction_errors, _w("c") + " SELECT chunk_id, CASE WHEN chunk_id % 3 = 0 THEN 'no text' ELSE 'blank text' END AS error FROM c WHERE chunk_id % 3 <> 2"),
}

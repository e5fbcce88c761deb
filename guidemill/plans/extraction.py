"""Full extraction: legal chunks with metadata, structured rows of every kind, counts and totals.

Extractors run per chunk, so each item belongs to the chunk it was found in.  All text extractors are
array expressions on the chunk row; one pass over the chunks yields all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidemill.functions.matching import explode_rows, strip
from guidemill.operators import conditions, contacts, deadlines, examples, formulas, legal, metadata, references, tables
from guidemill.plans.ingest import formula_label, table_label, topic_label

# Registry of text extractors: name -> array expression over a text column.  Callers may add their own.
EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "formulas": formulas.formulas,
    "deadlines": deadlines.deadlines,
    "contacts": contacts.contacts,
    "condition_lists": conditions.condition_lists,
    "examples": examples.examples,
    "references": references.references,
}


def chunk_with_metadata(parsed: DataFrame, key: str, title: str = "doc_title") -> DataFrame:
    """Legal chunks with their metadata and the document's topic label."""
    doc = parsed.withColumn("topic_primary", topic_label(F.get(metadata.topics(metadata.words_found(F.col("full_text"))), F.lit(0))))
    c = legal.chunk_documents(doc, [key, "topic_primary"], title)
    c = c.withColumn("chunk_id", F.sha2(F.concat_ws("#", F.col(key).cast("string"), F.col("chunk_index").cast("string")), 256))
    c = metadata.with_metadata(c, "content")
    return c.withColumn("stored_content_type", F.when(F.col("content_type") == "general", "factual").otherwise("procedural"))


def extract(chunks: DataFrame, only: list[str] | None = None, text: str = "content") -> DataFrame:
    """Add one array column per extractor; ``only`` switches others off."""
    names = list(EXTRACTORS) if only is None else only
    return chunks.withColumns({n: EXTRACTORS[n](F.col(text)) for n in names})


def item_rows(extracted: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """Rows of one kind, with the keys of their chunk."""
    return explode_rows(extracted, F.col(name), keep, pos="item_no")


def stored_formulas(extracted: DataFrame, keep: list[str]) -> DataFrame:
    """Formula rows with the stored type label."""
    return item_rows(extracted, "formulas", keep).withColumn("formula_type", formula_label(F.col("formula_type")))


def stored_tables(pages: DataFrame, key: list[str], html: str = "html", year: Column | None = None) -> DataFrame:
    """Table rows with the stored type label."""
    return tables.table_rows(pages, key, html, year).withColumn("table_type", table_label(F.col("table_type")))


def edges(extracted: DataFrame) -> DataFrame:
    """Reference edges of chunks, not yet resolved; ids follow from the chunk and the target."""
    rows = item_rows(extracted, "references", ["chunk_id"])
    kind = F.when(F.col("reference_type") == "definition", "definition").when(F.col("reference_type") == "legislation", "legislation") \
        .otherwise("see_also")
    strength = F.when(kind == "definition", "required").when(F.col("reference_type") == "hmrc_manual", "recommended").otherwise("optional")
    return rows.select(
        F.sha2(F.concat_ws("#", "chunk_id", "reference_type", "target_normalized"), 256).alias("reference_id"),
        F.col("chunk_id").alias("source_chunk_id"), F.lit(None).cast("string").alias("target_chunk_id"), kind.alias("reference_type"),
        strength.alias("reference_strength"), "reference_text", F.substring("context", 1, 200).alias("reference_context"),
        F.when(F.col("reference_type") == "hmrc_manual", F.col("reference_text")).alias("target_section_id"), F.lit(False).alias("is_resolved"))


def bad_rows(chunks: DataFrame, text: str = "content") -> DataFrame:
    """Errors frame of an extraction: rows that no extractor can read."""
    t = F.col(text)
    return chunks.where(t.isNull() | (strip(t) == "")).select("chunk_id", F.when(t.isNull(), "no text").otherwise("blank text").alias("error"))


def document_counts(extracted: DataFrame, key: str) -> DataFrame:
    """Chunks and items per document; sizes are summed map-side."""
    names = [n for n in EXTRACTORS if n in extracted.columns]
    return extracted.groupBy(key).agg(
        F.count("*").alias("chunks_created"), *[F.sum(F.size(n).cast("bigint")).alias(n) for n in names],
        F.sum(F.size("thresholds").cast("bigint")).alias("thresholds_found"))


def with_table_counts(counts: DataFrame, parsed: DataFrame, key: str, html: str = "html") -> DataFrame:
    n = parsed.select(key, F.size(tables.tables(F.col(html), F.lit(None).cast("string"))).cast("bigint").alias("tables"))
    return counts.join(n, key, "right").fillna(0)


def run_totals(counts: DataFrame) -> DataFrame:
    """Totals of a run over all documents."""
    names = [c for c, t in counts.dtypes if t == "bigint" and c not in ("page_id", "doc_id")]
    return counts.agg(F.count("*").alias("documents_processed"), *[F.sum(c).alias(c) for c in names])

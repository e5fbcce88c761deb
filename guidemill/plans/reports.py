"""Statistics; each report is one pass with grouping sets instead of a query per breakdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def breakdown(df: DataFrame, columns: list[str], measures: dict[str, Column], missing: str = "unknown") -> DataFrame:
    """Total plus one breakdown per column: (breakdown, label, measures)."""
    keyed = df
    for c in columns:
        keyed = keyed.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(missing)))
    n = len(columns)
    sets = keyed.groupingSets([[]] + [[F.col(c)] for c in columns], *columns).agg(
        F.grouping_id().alias("_gid"), *[m.alias(k) for k, m in measures.items()])
    full = (1 << n) - 1
    name = F.when(F.col("_gid") == full, "total")
    for i, c in enumerate(columns):
        name = name.when(F.col("_gid") == full - (1 << (n - 1 - i)), c)
    return sets.select(name.alias("breakdown"), F.coalesce(*columns, F.lit("all")).alias("label"), *measures)


def document_stats(documents: DataFrame) -> DataFrame:
    """Documents and chunks by authority and status, with the latest ingest."""
    return breakdown(documents, ["authority", "ingestion_status"], {
        "document_count": F.count("*"), "chunk_total": F.coalesce(F.sum("total_chunks"), F.lit(0)), "last_ingestion": F.max("ingested_at")})


CHUNK_FLAGS = {
    "with_outgoing_references": "has_outgoing_references", "with_incoming_references": "has_incoming_references",
    "with_tables": "contains_table", "with_formulas": "contains_formula", "with_decision_trees": "contains_decision_tree",
    "with_deadlines": "contains_deadline", "with_examples": "contains_example", "with_contacts": "contains_contact",
}


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Chunks by topic, content type and service, with embedding and flag counts."""
    measures = {"chunk_count": F.count("*"), "embedded": F.count("vector_id"), "pending": F.count_if(F.col("vector_id").isNull())}
    measures |= {n: F.count_if(F.col(c)) for n, c in CHUNK_FLAGS.items()}
    return breakdown(chunks, ["topic_primary", "content_type", "service_category"], measures)


def documents_by_topic(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.coalesce("topic_primary", F.lit("unknown")).alias("topic")).agg(
        F.count_distinct("document_id").alias("document_count"))


def structured_stats(kinds: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Totals per kind and by type: ``kinds`` maps a kind to its frame and type column."""
    rows = None
    for kind, (df, type_column) in kinds.items():
        one = df.select(F.lit(kind).alias("kind"), F.coalesce(F.col(type_column).cast("string"), F.lit("unknown")).alias("type"))
        rows = one if rows is None else rows.unionByName(one)
    out = rows.rollup("kind", "type").agg(F.count("*").alias("item_count"), F.grouping_id().alias("_gid"))
    return out.where("_gid < 3").select("kind", F.when(F.col("_gid") == 0, F.col("type")).otherwise("all").alias("type"), "item_count")


def attached_to_chunks(kinds: dict[str, DataFrame], ids: dict[str, str]) -> DataFrame:
    """Counts of attached items per chunk and kind, and whether there is any.

    Ids of one chunk are listed by ``attached_items``; lists are not built here, as one chunk may
    hold most of the items.
    """
    rows = None
    for kind, df in kinds.items():
        one = df.select("chunk_id", F.lit(kind).alias("kind"))
        rows = one if rows is None else rows.unionByName(one)
    wide = rows.groupBy("chunk_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    return wide.withColumn("has_structured_content", F.lit(True))


def attached_items(kinds: dict[str, DataFrame], ids: dict[str, str]) -> DataFrame:
    """(chunk_id, kind, item_id) of everything attached to chunks."""
    rows = None
    for kind, df in kinds.items():
        one = df.select("chunk_id", F.lit(kind).alias("kind"), F.col(ids[kind]).cast("string").alias("item_id"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def audit_stats(logs: DataFrame) -> DataFrame:
    """Queries of a period (filter first): total, by intent and by feedback, with latency, tokens and advice counts."""
    return breakdown(logs.withColumn("user_feedback", F.coalesce("user_feedback", F.lit("none"))), ["detected_intent", "user_feedback"], {
        "query_count": F.count("*"), "average_latency_ms": F.round(F.avg("latency_ms"), 2),
        "total_tokens": F.coalesce(F.sum("total_tokens"), F.lit(0)),
        "professional_advice": F.count_if(F.col("disclaimer_type") == "professional_advice")})

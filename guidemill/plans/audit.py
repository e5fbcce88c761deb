"""Query audit log: listing, feedback, impact, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidemill.operators.store import name_contains, update


def matching(logs: DataFrame, user_id: str | None = None, session_id: str | None = None, start=None, end=None,
             intent: str | None = None) -> DataFrame:
    """Rows that pass every given filter."""
    df = logs
    for column, value in (("user_id", user_id), ("session_id", session_id), ("detected_intent", intent)):
        if value is not None:
            df = df.where(F.col(column) == value)
    if start is not None:
        df = df.where(F.col("ts") >= start)
    if end is not None:
        df = df.where(F.col("ts") <= end)
    return df


def newest_first() -> list[Column]:
    return [F.desc("ts"), F.desc("log_id")]


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def attach_feedback(logs: DataFrame, feedback: DataFrame) -> DataFrame:
    """``feedback``: log_id, user_feedback, feedback_comment."""
    return update(logs, feedback, "log_id")


def similar_queries(logs: DataFrame, part: str, limit: int | None = None) -> DataFrame:
    """Newest queries whose text contains the part, ignoring case."""
    return _first(logs.where(name_contains("original_query", part)).orderBy(*newest_first()), limit)


def queries_using(logs: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, log_id, ts) of queries that retrieved one of the documents."""
    used = logs.select("log_id", "ts", F.explode_outer("chunks_retrieved").alias("c")).select("log_id", "ts", F.col("c.document_id").alias("document_id"))
    return used.join(documents.select("document_id").distinct(), "document_id", "left_semi").distinct()


def export(logs: DataFrame, limit: int | None = None) -> DataFrame:
    """Report rows, newest first: preview of the response and number of citations."""
    preview = F.when(F.length("response_text") > 200, F.concat(F.substring("response_text", 1, 200), F.lit("..."))) \
        .otherwise(F.col("response_text"))
    return _first(logs.orderBy(*newest_first()), limit).select(
        F.col("log_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "user_id",
        F.col("original_query").alias("query"), F.col("detected_intent").alias("intent"), preview.alias("response_preview"),
        F.coalesce(F.size("citations"), F.lit(0)).cast("bigint").alias("citations_count"), "disclaimer_type", "confidence_score",
        "latency_ms", F.col("user_feedback").alias("feedback"))

"""Chat history and query audit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from guidemill.plans import audit, chat, reports
from guidemill.sources.tables import read_table

LOGS = [
    "event_id AS log_id", "ts", "'u' || user_id AS user_id", "'s' || (user_id % 50) AS session_id",
    "'How do I ' || event_type || ' item ' || props AS original_query", "event_type AS detected_intent",
    "CASE WHEN event_id % 11 <> 0 THEN value * 10 END AS latency_ms", "event_id % 500 AS total_tokens",
    "CASE event_id % 4 WHEN 0 THEN 'helpful' WHEN 1 THEN 'not_helpful' END AS user_feedback",
    "CASE WHEN event_id % 5 = 0 THEN 'professional_advice' ELSE 'standard' END AS disclaimer_type",
    "repeat('Answer ', cast(event_id % 60 as int)) AS response_text", "event_id % 3 AS n_citations", "event_id % 97 AS doc_a", "(event_id * 7) % 97 AS doc_b",
    "value / 128 AS confidence_score",
]
_L = f"WITH l AS (SELECT {', '.join(LOGS)} FROM events)"


def logs(spark, path):
    df = read_table(spark, path, "events").selectExpr(*LOGS)
    item = lambda c: F.struct(F.concat(F.lit("doc"), F.col(c).cast("string")).alias("document_id"))
    return df.withColumn("chunks_retrieved", F.array(item("doc_a"), item("doc_b"))).withColumn(
        "citations", F.when(F.col("n_citations") > 0, F.array_repeat(F.lit("c"), F.col("n_citations").cast("int"))))


def _period():
    """Start and end of the reported period."""
    return {"start": F.lit("2024-01-05").cast("timestamp_ntz"), "end": F.lit("2024-01-20").cast("timestamp_ntz")}


_PERIOD = "ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'"


def audit_page(spark, path):
    m = audit.matching(logs(spark, path), **_period(), intent="click")
    return m.orderBy(*audit.newest_first()).offset(10).limit(25).select("log_id", "user_id")


def audit_count(spark, path):
    return audit.matching(logs(spark, path), user_id="u7", **_period()).agg(F.count("*").alias("n"))


def audit_with_feedback(spark, path):
    late = logs(spark, path).where("latency_ms > 500").select("log_id", F.lit("slow").alias("user_feedback"))
    return audit.attach_feedback(logs(spark, path).select("log_id", "user_feedback"), late)


def audit_similar(spark, path):
    return audit.similar_queries(logs(spark, path), "I SIGNUP ITEM", 50).select("log_id", "original_query")


def audit_impact(spark, path):
    """Queries that used a page."""
    docs = read_table(spark, path, "pages").select(F.concat(F.lit("doc"), F.col("page_id").cast("string")).alias("document_id"))
    return audit.queries_using(logs(spark, path), docs).select("document_id", "log_id")


def audit_stats(spark, path):
    return reports.audit_stats(audit.matching(logs(spark, path), **_period()))


def audit_export(spark, path):
    return audit.export(audit.matching(logs(spark, path), **_period()), 10000)


_AUDIT_MEASURES = """count(*) AS query_count, round(avg(latency_ms), 2) AS average_latency_ms, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens,
  count(*) FILTER (WHERE disclaimer_type = 'professional_advice') AS professional_advice"""

MESSAGES = ["conv_id AS session_id", "'u' || (conv_id % 20) AS user_id", "turn", "role", "text AS content"]
_M = f"WITH m AS (SELECT {', '.join(MESSAGES)} FROM conversations)"


def messages(spark, path):
    return read_table(spark, path, "conversations").selectExpr(*MESSAGES)


def chat_sessions(spark, path):
    return chat.sessions(messages(spark, path))


def chat_user_sessions(spark, path):
    return chat.user_sessions(chat.sessions(messages(spark, path))).select("user_id", "session_id", "title")


def chat_history(spark, path):
    return chat.history(messages(spark, path))


def chat_history_of_session(spark, path):
    return chat.history(messages(spark, path).where("session_id = 5")).select("turn", "role", "content")


def chat_new_sessions(spark, path):
    """Messages whose conversation has no session yet: only answered conversations were stored."""
    known = chat.sessions(messages(spark, path).where("role = 'assistant'"))
    return chat.without_session(messages(spark, path), known).select("session_id", "turn", chat.title(F.col("content")).alias("title"))


_TITLE = "CASE WHEN length({0}) > 50 THEN {0}[1:50] || '...' ELSE {0} END"
_SESSIONS = f"""{_M}, s AS (SELECT session_id, arg_min(user_id, turn) AS user_id, {_TITLE.format('arg_min(content, turn)')} AS title,
  count(*) AS message_count, max(turn) AS last_turn FROM m GROUP BY 1)"""
QUERIES = {
    "audit_page": (audit_page, f"{_L} SELECT log_id, user_id FROM l WHERE {_PERIOD} AND detected_intent = 'click' ORDER BY ts DESC, log_id DESC LIMIT 25 OFFSET 10"),
    "audit_count": (audit_count, f"{_L} SELECT count(*) AS n FROM l WHERE {_PERIOD} AND user_id = 'u7'"),
    "audit_with_feedback": (audit_with_feedback, f"{_L} SELECT log_id, CASE WHEN latency_ms > 500 THEN 'slow' ELSE user_feedback END AS user_feedback FROM l"),
    "audit_similar": (audit_similar, f"{_L} SELECT log_id, original_query FROM l WHERE original_query ILIKE '%i signup item%' ORDER BY ts DESC, log_id DESC LIMIT 50"),
    "audit_impact": (audit_impact, f"{_L} SELECT DISTINCT 'doc' || page_id AS document_id, log_id FROM l JOIN pages ON page_id IN (doc_a, doc_b)"),
    "audit_stats": (audit_stats, f"{_L}, p AS (SELECT * FROM l WHERE {_PERIOD}) SELECT 'total' AS breakdown, 'all' AS label, {_AUDIT_MEASURES} FROM p "
                    f"UNION ALL SELECT 'detected_intent', detected_intent, {_AUDIT_MEASURES} FROM p GROUP BY detected_intent "
                    f"UNION ALL SELECT 'user_feedback', coalesce(user_feedback, 'none'), {_AUDIT_MEASURES} FROM p GROUP BY coalesce(user_feedback, 'none')"),
    "audit_export": (audit_export, f"""{_L} SELECT log_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, user_id, original_query AS query, detected_intent AS intent,
  CASE WHEN length(response_text) > 200 THEN response_text[1:200] || '...' ELSE response_text END AS response_preview, n_citations AS citations_count,
  disclaimer_type, confidence_score, latency_ms, user_feedback AS feedback FROM l WHERE {_PERIOD} ORDER BY ts DESC, log_id DESC LIMIT 10000"""),
    "chat_sessions": (chat_sessions, f"{_SESSIONS} SELECT * FROM s"),
    "chat_user_sessions": (chat_user_sessions, f"{_SESSIONS} SELECT user_id, session_id, title FROM s"),
    "chat_history": (chat_history, f"{_M} SELECT session_id, turn, role, content FROM m"),
    "chat_history_of_session": (chat_history_of_session, f"{_M} SELECT turn, role, content FROM m WHERE session_id = 5"),
    "chat_new_sessions": (chat_new_sessions, f"{_M} SELECT session_id, turn, {_TITLE.format('content')} AS title FROM m WHERE session_id NOT IN (SELECT session_id FROM m WHERE role = 'assistant')"),
}

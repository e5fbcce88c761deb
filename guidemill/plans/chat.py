"""Chat history: sessions, titles, messages.

Messages: session_id, user_id, turn, role, content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def title(text: Column) -> Column:
    """First 50 characters, marked when cut."""
    return F.when(F.length(text) > 50, F.concat(F.substring(text, 1, 50), F.lit("..."))).otherwise(text)


def sessions(messages: DataFrame) -> DataFrame:
    """One row per session; the title comes from its first message."""
    return messages.groupBy("session_id").agg(
        F.min_by("user_id", "turn").alias("user_id"), title(F.min_by("content", "turn")).alias("title"),
        F.count("*").alias("message_count"), F.max("turn").alias("last_turn"))


def user_sessions(session_rows: DataFrame) -> DataFrame:
    """Sessions per user, last updated first."""
    return session_rows.orderBy("user_id", F.desc("last_turn"), "session_id")


def history(messages: DataFrame) -> DataFrame:
    """Messages in time order per session; sorted rows, so a long session needs no single group."""
    return messages.select("session_id", "turn", "role", "content").orderBy("session_id", "turn")


def without_session(messages: DataFrame, session_rows: DataFrame) -> DataFrame:
    """Messages that name no known session and so start a new one."""
    return messages.join(session_rows.select("session_id"), "session_id", "left_anti")


def append_messages(messages: DataFrame, arrivals: DataFrame) -> DataFrame:
    """The messages with new ones (session_id, user_id, seq, role, content) behind the last turn of their session, in the order of ``seq``.

    A session that is not known starts at turn 0.  Rows without a session are dropped; equal ``seq`` are ordered by role and content.
    """
    last = messages.groupBy("session_id").agg(F.max("turn").alias("_last"))
    order = Window.partitionBy("session_id").orderBy("seq", "role", "content")
    fresh = arrivals.where(F.col("session_id").isNotNull()).withColumn("_n", F.row_number().over(order)).join(last, "session_id", "left")
    return messages.unionByName(fresh.withColumn("turn", F.coalesce(F.col("_last"), F.lit(-1)) + F.col("_n")).select(*messages.columns))

"""Run log as append-only events; the state of a run is derived.

Events: run_id, event_id, ts, kind (status, set, add, error, warning), field, amount, status, message, url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ["documents_found", "documents_processed", "documents_created", "documents_updated", "documents_skipped",
            "documents_failed", "chunks_created", "chunks_embedded", "total_tokens_used"]
FINAL = ["completed", "completed_with_errors", "failed"]
EVENT_DDL = ("run_id bigint, event_id bigint, ts timestamp_ntz, kind string, field string, amount bigint, status string, "
             "message string, url string")


def append(log: DataFrame, events: DataFrame) -> DataFrame:
    return log.unionByName(events, allowMissingColumns=True)


def _when() -> Column:
    return F.struct("ts", "event_id")


def counters(log: DataFrame) -> DataFrame:
    """(run_id, field, value): the last set value plus what was added after it."""
    c = log.where(F.col("kind").isin("set", "add"))
    last = c.where("kind = 'set'").groupBy("run_id", "field").agg(
        F.max(_when()).alias("_at"), F.max_by("amount", _when()).alias("_base"))
    adds = c.where("kind = 'add'").join(last.select("run_id", "field", "_at"), ["run_id", "field"], "left")
    after = adds.where(F.col("_at").isNull() | (_when() > F.col("_at"))).groupBy("run_id", "field").agg(F.sum("amount").alias("_added"))
    both = last.select("run_id", "field", "_base").join(after, ["run_id", "field"], "full_outer")
    return both.select("run_id", "field", (F.coalesce("_base", F.lit(0)) + F.coalesce("_added", F.lit(0))).alias("value"))


def runs(log: DataFrame) -> DataFrame:
    """One row per run: status, times, counters, error and warning counts."""
    base = log.groupBy("run_id").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"),
        F.max_by(F.when(F.col("kind") == "status", F.col("status")), F.when(F.col("kind") == "status", _when())).alias("status"),
        F.max(F.when((F.col("kind") == "status") & F.col("status").isin(*FINAL), F.col("ts"))).alias("completed_at"),
        F.count_if(F.col("kind") == "error").alias("error_count"), F.count_if(F.col("kind") == "warning").alias("warning_count"))
    wide = counters(log).groupBy("run_id").pivot("field", COUNTERS).agg(F.first("value"))
    return base.join(wide, "run_id", "left").fillna(0, COUNTERS)


def durations(run_rows: DataFrame) -> DataFrame:
    """(run_id, status, duration_seconds): from the first event to the last final status; null while a run is not finished."""
    seconds = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("completed_at")) / 1e6
    return run_rows.select("run_id", "status", seconds.alias("duration_seconds"))


def messages(log: DataFrame, kind: str = "error") -> DataFrame:
    """Errors or warnings of runs, long form."""
    return log.where(F.col("kind") == kind).select("run_id", "ts", "message", "url")


def latest_successful(run_rows: DataFrame, by: str = "source_type") -> DataFrame:
    """Latest successful run per source."""
    ok = run_rows.where(F.col("status").isin("completed", "completed_with_errors"))
    return ok.groupBy(by).agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))

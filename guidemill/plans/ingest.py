"""Batch ingest: classify, detect change, chunk, replace, report.

Input is a frame of fetched and parsed pages (see ``operators.parse``), one row per url, with an
``error`` for pages that could not be fetched.  The stored state is a documents frame and a chunks
frame; the result is a new snapshot of both plus one outcome row per url.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv
from guidemill.functions.matching import explode_rows, literal_map
from guidemill.operators import chunk
from guidemill.session import ensure_checkpoint_dir
from guidemill.sources.tables import written

SKIP_EXISTING, UPDATE_IF_CHANGED, FORCE_UPDATE = "skip_existing", "update_if_changed", "force_update"


@dataclass(frozen=True)
class IngestSettings:
    mode: str = UPDATE_IF_CHANGED
    max_errors: int | None = None  # a cap leaves later pages as not_processed
    min_content_length: int = 100
    sizes: chunk.ChunkSizes = field(default_factory=chunk.ChunkSizes)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def document_id(url: Column) -> Column:
    return F.sha2(url, 256)


def authority(url: Column, document_type: Column) -> Column:
    u = F.lower(url)
    return F.when(u.contains("hmrc-internal-manuals"), "HMRC_MANUAL").when(u.contains("legislation.gov.uk"), "UK_LEGISLATION") \
        .when(u.contains("hmrc") | (document_type == "hmrc_manual_section"), "HMRC_MANUAL").otherwise("GOV_UK")


def document_kind(schema_name: Column, document_type: Column) -> Column:
    s, t = F.lower(schema_name), F.lower(document_type)
    return F.when(t.contains("manual"), "manual").when(s.contains("guide") | t.contains("guide"), "guidance") \
        .when(t.contains("form"), "form_instructions").when(t.contains("news") | t.contains("announcement"), "NEWS") \
        .otherwise("guidance")


def reliability_tier(authority_: Column) -> Column:
    return F.when(authority_.isin("UK_LEGISLATION", "HMRC_MANUAL"), 1).when(authority_ == "GOV_UK", 2).otherwise(3)


def topic_label(topic: Column) -> Column:
    return F.try_element_at(literal_map(fv.TOPIC_LABELS), topic)


def table_label(kind: Column) -> Column:
    return F.when(kind.isin(*[k for k in fv.TABLE_TITLES if k != "other"]), kind).otherwise("other")


def formula_label(kind: Column) -> Column:
    return F.when(kind.isin(*fv.FORMULA_LABELS), kind).otherwise("tax_calculation")


NOT_REACHED = "Not processed: error limit reached"
SUPERSEDED = "Superseded by a later row of the same url"


def within_error_cap(pages: DataFrame, max_errors: int | None) -> DataFrame:
    """Add ``reached``: true up to and including the page whose failure reaches the cap, in input order.

    The cap position comes from the first ``max_errors`` failures (a bounded top-k), so no global
    running count is needed.
    """
    if max_errors is None:
        return pages.withColumn("reached", F.lit(True))
    firsts = pages.where(F.col("error").isNotNull()).select("input_idx").orderBy("input_idx").limit(max_errors)
    last = firsts.agg(F.when(F.count("*") == max_errors, F.max("input_idx")).alias("last"))
    return pages.withColumn("reached", F.col("input_idx") <= F.coalesce(last.scalar(), F.lit((1 << 62))))


def mark_superseded(pages: DataFrame) -> DataFrame:
    """Add ``superseded``: true where the same url comes again later in the input.

    Only urls that repeat enter the join with the pages, as (url, last position), so texts do not move for
    it where the repeats are few.  Without ``input_idx`` urls must be unique.
    """
    if "input_idx" not in pages.columns:
        return pages.withColumn("superseded", F.lit(False))
    last = pages.where(F.col("url").isNotNull()).groupBy("url").agg(
        F.max("input_idx").alias("_last"), F.count("*").alias("_times")).where("_times > 1").drop("_times")
    return pages.join(last, "url", "left").withColumn("superseded", F.coalesce(F.col("input_idx") < F.col("_last"), F.lit(False))).drop("_last")


def decide(pages: DataFrame, stored: DataFrame, mode: str = UPDATE_IF_CHANGED) -> DataFrame:
    """Add content_hash, document_id and the change decision per url."""
    known = stored.select("url", F.col("content_hash").alias("_stored_hash"), F.lit(True).alias("_stored"))
    hashed = pages if "content_hash" in pages.columns else pages.withColumn("content_hash", content_hash(F.col("full_text")))
    df = hashed.join(known, "url", "left")
    exists = F.col("_stored").isNotNull()
    reason = F.when(~exists, "new").when(F.lit(mode == SKIP_EXISTING), "skip_existing") \
        .when(F.lit(mode == FORCE_UPDATE), "force_update") \
        .when(F.col("content_hash").eqNullSafe(F.col("_stored_hash")), "unchanged").otherwise("content_changed")
    return df.withColumn("reason", reason).withColumn("document_id", document_id(F.col("url"))) \
        .withColumn("is_stored", exists).drop("_stored", "_stored_hash")


def _gate(settings: IngestSettings) -> Column:
    """Why a page is not taken further; null when it is."""
    return F.when(~F.col("reached"), NOT_REACHED).when(F.col("superseded"), SUPERSEDED) \
        .when(F.col("error").isNotNull(), F.col("error")) \
        .when(~F.coalesce(F.col("has_content"), F.lit(False)), F.lit("No content found")) \
        .when(F.col("word_count") < settings.min_content_length // 5,
              F.concat(F.lit("Content too short ("), F.col("word_count").cast("string"), F.lit(" words)")))


def _wanted() -> Column:
    return F.col("gate").isNull() & F.col("reason").isin("new", "content_changed", "force_update")


def _chunk_array(settings: IngestSettings) -> Column:
    return F.flatten(F.transform("sections", lambda s: chunk.chunk_section(s, settings.sizes)))


def process(pages: DataFrame, stored: DataFrame, settings: IngestSettings = IngestSettings(), materialize: bool = False) -> DataFrame:
    """Pages with decision, gates and their chunks (array ``chunks``, only for pages to process).

    One pass: whole pages travel through the join with the stored keys, which suits a first load.  For
    a large snapshot of which little changed use ``process_changed``.  ``materialize`` writes the
    result to the checkpoint folder; use it when several outputs follow.
    """
    df = decide(mark_superseded(within_error_cap(pages, settings.max_errors)), stored, settings.mode).withColumn("gate", _gate(settings))
    df = df.withColumn("chunks", F.when(_wanted(), _chunk_array(settings)))
    if materialize:
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint()
    return df


def process_changed(
    pages: DataFrame, stored: DataFrame, settings: IngestSettings = IngestSettings(), folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Two passes for snapshots with few changes: (decisions of all urls, processed changed pages).

    The first pass joins only url, hash and gates with the stored keys and writes the decisions.  The
    written size is known, so the adaptive plan may broadcast the urls to process when they are few, and the second pass
    then reads just those pages without shuffling the snapshot.
    """
    spark = pages.sparkSession
    order = [c for c in ("input_idx",) if c in pages.columns]
    slim = within_error_cap(pages, settings.max_errors).select(
        "url", content_hash(F.col("full_text")).alias("content_hash"), "error", "word_count", "has_content", "reached", *order)
    slim = decide(mark_superseded(slim), stored, settings.mode)
    path = folder or f"{ensure_checkpoint_dir(spark)}/decisions-{uuid.uuid4()}"
    slim.withColumn("gate", _gate(settings)).write.parquet(path)
    decisions = spark.read.parquet(path)
    todo = decisions.where(_wanted()).select("url", *order, "content_hash", "document_id", "reason", "is_stored", "gate")
    done = pages.join(todo, ["url", *order]).withColumn("chunks", _chunk_array(settings))
    return decisions, done


def outcomes_of_decisions(decisions: DataFrame, processed: DataFrame) -> DataFrame:
    """``outcomes`` for the two-pass form."""
    made = processed.select("url", F.size("chunks").alias("_n"))
    df = decisions.join(made, "url", "left")
    chunks = F.when(F.col("_n").isNotNull(), F.array_repeat(F.lit(1), F.col("_n")))
    return outcomes(df.withColumn("chunks", chunks))


def outcomes(processed: DataFrame) -> DataFrame:
    """One row per url: action, reason, success, chunk count, error."""
    n = F.coalesce(F.size("chunks"), F.lit(0))
    handled = F.col("chunks").isNotNull()
    action = F.when(F.col("gate") == NOT_REACHED, "not_processed").when(F.col("error").isNotNull(), "failed").when(F.col("gate").isNotNull() | ~handled | (n == 0), "skipped") \
        .when(F.col("is_stored"), "updated").otherwise("created")
    error = F.coalesce(F.col("gate"), F.when(handled & (n == 0), "No chunks created"))
    df = processed.select("url", "document_id", "reason", action.alias("action"), error.alias("error"), n.alias("n"))
    return df.select(
        "url", "document_id", "reason", "action", F.col("error").isNull().alias("success"),
        F.when(F.col("action").isin("created", "updated"), F.col("n")).otherwise(0).alias("chunks_created"), "error")


def changed(processed: DataFrame) -> DataFrame:
    return processed.where(F.col("chunks").isNotNull() & (F.size("chunks") > 0))


def new_documents(processed: DataFrame, run_time: Column) -> DataFrame:
    auth = authority(F.col("url"), F.col("document_type"))
    return changed(processed).select(
        "document_id", "url", auth.alias("authority"), document_kind(F.col("schema_name"), F.col("document_type")).alias("document_type"),
        reliability_tier(auth).alias("reliability_tier"), "title", "parent_title", "section_hierarchy",
        F.to_date("first_published").alias("publication_date"), F.col("last_updated").alias("last_updated_source"), "content_hash",
        F.lit("completed").alias("ingestion_status"), run_time.alias("ingested_at"), F.size("chunks").alias("total_chunks"))


KEPT_ON_UPDATE = ("authority", "document_type", "reliability_tier", "publication_date")


def next_documents(stored: DataFrame, processed: DataFrame, run_time: Column) -> DataFrame:
    """New snapshot: inserted and updated rows; an update keeps the fields fixed at creation."""
    fresh = new_documents(processed, run_time)
    n = fresh.select("document_id", *[F.col(c).alias(f"_n_{c}") for c in fresh.columns if c != "document_id"])
    both = stored.join(n, "document_id", "full_outer")
    cols = ["document_id"] + [
        (F.coalesce(F.col(c), F.col(f"_n_{c}")) if c in KEPT_ON_UPDATE else F.coalesce(F.col(f"_n_{c}"), F.col(c))).alias(c)
        for c in fresh.columns if c != "document_id"]
    return both.select(*cols)


def new_chunks(processed: DataFrame) -> DataFrame:
    """Chunk rows with the document's fields copied in."""
    auth = authority(F.col("url"), F.col("document_type"))
    keep = ["document_id", F.col("url").alias("source_url"), auth.alias("source_authority"), reliability_tier(auth).alias("reliability_tier"),
            F.to_date("first_published").alias("publication_date"), F.col("last_updated")]
    rows = explode_rows(changed(processed), F.col("chunks"), keep, pos="chunk_index", total="total_chunks_in_doc")
    return rows.withColumn("chunk_id", F.sha2(F.concat_ws("#", "document_id", F.col("chunk_index").cast("string")), 256))


def next_chunks(stored: DataFrame, processed: DataFrame) -> DataFrame:
    """New snapshot: chunks of changed documents are replaced, all others stay."""
    ids = changed(processed).select("document_id")
    return stored.join(ids, "document_id", "left_anti").unionByName(new_chunks(processed), allowMissingColumns=True)


def bucket(column: str, buckets: int) -> Column:
    """Storage bucket of a document."""
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def replace_chunks(path: str, processed: DataFrame, buckets: int = 1024, files: int = 8) -> None:
    """Replace changed documents' chunks in a table partitioned by document bucket.

    Only buckets that hold a changed document are read and rewritten; the rest of the table stays.  A bucket is
    written by up to ``files`` tasks.  The new rows are held in the checkpoint folder before the first one is
    replaced, so a write that fails half-way can be repeated.
    """
    spark = processed.sparkSession
    ensure_checkpoint_dir(spark)
    fresh = new_chunks(processed).withColumn("bucket", bucket("document_id", buckets)).checkpoint()
    ids = fresh.select("document_id", "bucket").distinct()
    stored = spark.read.schema(fresh.schema).parquet(path).join(ids.select("bucket").distinct(), "bucket", "left_semi")
    rows = stored.join(ids.select("document_id"), "document_id", "left_anti").unionByName(fresh).checkpoint()
    rows.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(files))).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def run_summary(outcome: DataFrame, url_count: Column | None = None) -> DataFrame:
    """Counters and status of a run in one row."""
    def n(a: str) -> Column:
        return F.count_if(F.col("action") == a)

    s = outcome.where("action <> 'not_processed'").agg(
        F.count("*").alias("documents_processed"), n("created").alias("documents_created"), n("updated").alias("documents_updated"),
        n("skipped").alias("documents_skipped"), n("failed").alias("documents_failed"),
        F.coalesce(F.sum("chunks_created"), F.lit(0)).alias("chunks_created"), F.count("error").alias("error_count"))
    found = F.col("documents_processed") if url_count is None else url_count
    return s.withColumn("status", F.when((F.col("documents_failed") > 0) & (F.col("documents_failed") == found), "failed")
                        .when(F.col("documents_failed") > 0, "completed_with_errors").otherwise("completed"))


def run_errors(outcome: DataFrame) -> DataFrame:
    return outcome.where(F.col("error").isNotNull() & (F.col("action") != "not_processed")).select("url", "error")


def manual_sources(sources: DataFrame, roots: DataFrame, max_sections: int | None = None) -> DataFrame:
    """Source rows of whole manuals: everything reachable over child sections from the roots (``node``)."""
    from guidemill.operators.graph import crawl
    from guidemill.sources.payloads import child_edges

    # Payloads are parsed once for the whole crawl, not once a level.
    slim = written(sources.select("base_path", "child_sections"), "sections")
    found = slim.select(F.col("base_path").alias("node"))
    edges = written(child_edges(slim).join(found.select(F.col("node").alias("target")), "target", "left_semi").select("source", "target"), "child-edges")
    reached = crawl(edges, roots.join(found, "node", "left_semi"), max_nodes=max_sections)
    return sources.join(reached.select(F.col("node").alias("base_path")), "base_path", "left_semi")


def pages_from_sources(sources: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Parsed pages ready for ``process`` from source rows (see ``sources.payloads``)."""
    from guidemill.operators import parse
    from guidemill.sources.payloads import section_hierarchy

    df = parse.parse_pages(sources, html="body_html", title="title")
    df = df.withColumn("section_hierarchy", section_hierarchy(F.col("breadcrumbs")))
    return df if "error" in df.columns else df.withColumn("error", F.lit(None).cast("string"))


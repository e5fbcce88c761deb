"""Run mode: ingest payload files as they arrive.

A file source stream hands each micro-batch to the batch ingest.  Each batch publishes one version: the documents
snapshot (one slim row a document), its outcomes, and only the chunks of documents that changed.  A document's
current chunks are those of its latest version, so texts are written once and no batch overwrites what it
reads.  The three appear together; a batch that is replayed after a failure finds its version published, or publishes it then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guidemill.plans import ingest
from guidemill.plans.publish import Publication
from guidemill.sources.payloads import source_rows

PAYLOAD_SCHEMA = T.StructType([T.StructField("value", T.StringType())])


def latest_per_url(pages: DataFrame) -> DataFrame:
    """A page that arrives twice in a batch counts once, with its newest payload.

    Rows without a url, such as unreadable payloads, all stay, so that each gets its outcome.  Only (url, date, hash) is compared, and
    combined before the exchange, so the texts of a url that comes very often do not meet in one task; equal payloads come out once.
    """
    age = F.struct(F.col("last_updated").isNotNull(), F.col("last_updated"), F.coalesce(F.sha2("full_text", 256), F.lit("")).alias("key"), F.xxhash64(*[
        F.to_json(F.struct(F.col(c))) for c in pages.columns if c not in ("url", "full_text", "last_updated")]).alias("rest"))
    keyed = pages.where(F.col("url").isNotNull()).withColumn("_age", age)
    newest = keyed.groupBy("url").agg(F.max("_age").alias("_age"))
    once = keyed.join(newest, ["url", "_age"], "left_semi").dropDuplicates(["url", "_age"]).drop("_age")
    return pages.where(F.col("url").isNull()).unionByName(once)


DOCUMENT_DDL = (
    "document_id string, url string, authority string, document_type string, reliability_tier int, title string, parent_title string, "
    "section_hierarchy array<string>, publication_date date, last_updated_source timestamp, content_hash string, ingestion_status string, "
    "ingested_at timestamp, total_chunks int"
)


def ingest_batch(batch: DataFrame, batch_id: int, state: str, settings: ingest.IngestSettings = ingest.IngestSettings()) -> None:
    """One micro-batch: payloads to the next documents snapshot, the chunks that changed and the outcomes."""
    store = Publication(batch.sparkSession, state)
    if store.latest() > batch_id:  # replayed after it was published
        return
    pages = ingest.pages_from_sources(source_rows(batch.withColumnRenamed("value", "raw"), "raw"))
    pages = latest_per_url(pages).withColumn("input_idx", F.monotonically_increasing_id())
    stored = store.read("documents", batch_id, DOCUMENT_DDL).drop("version", "attempt")
    done = ingest.process(pages, stored, settings, materialize=True)
    store.publish({"documents": ingest.next_documents(stored, done, F.current_timestamp()), "outcomes": ingest.outcomes(done)}, batch_id, append={"chunks": ingest.new_chunks(done)})


def current_chunks(spark: SparkSession, state: str, batch_id: int | None = None) -> DataFrame:
    """Chunks as of a batch (default: the last one): per document those of its latest version."""
    store = Publication(spark, state)
    chunks = store.read("chunks", store.latest() if batch_id is None else batch_id + 1)
    latest = chunks.groupBy("document_id").agg(F.max("version").alias("version"))
    return chunks.join(latest, ["document_id", "version"], "left_semi").drop("attempt")


def compact_chunks(spark: SparkSession, state: str, target: str) -> None:
    """Write the current chunks as a table of their own, for readers that do not want to look at versions."""
    current_chunks(spark, state).drop("version").write.mode("overwrite").parquet(target)


def start(spark: SparkSession, source: str, state: str, checkpoint: str, files_per_batch: int = 1000,
          settings: ingest.IngestSettings = ingest.IngestSettings()):
    """Start the stream over a folder of json-line payload files and stop when all present files are read."""
    stream = spark.readStream.schema(PAYLOAD_SCHEMA).option("maxFilesPerTrigger", files_per_batch).format("text").load(source)
    return (stream.writeStream.foreachBatch(lambda df, i: ingest_batch(df, i, state, settings))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())

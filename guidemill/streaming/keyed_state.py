"""Run mode with a state per address: a micro-batch looks at what arrived, never at all that is stored.

The stream keeps one small value per url: the hash of the stored text and the fields fixed at creation.  Arrivals of a
batch meet that value, the newest of a url is compared with it and gets its decision, and only the changed pages go on to be
chunked.  Each batch publishes the documents and chunks that changed and its outcomes as one version; a document's current
row and chunks are those of its latest version.  Results equal those of :mod:`guidemill.streaming.ingest_stream`, which joins
every batch with the whole snapshot and writes it anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from guidemill.plans import ingest
from guidemill.plans.publish import Publication
from guidemill.session import ensure_checkpoint_dir
from guidemill.sources.payloads import source_rows
from guidemill.streaming.ingest_stream import DOCUMENT_DDL, PAYLOAD_SCHEMA

STATE_DDL = "content_hash string, authority string, document_type string, reliability_tier int, publication_date string"
DECISION_DDL = "url string, raw string, known boolean, content_hash string, authority string, document_type string, reliability_tier int, publication_date string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIXED = ("authority", "document_type", "reliability_tier", "publication_date")


class LatestPage(StatefulProcessor):
    """The newest arrival of a url with what was known of the url before; a page that can be stored becomes what is known.

    ``mode`` decides as in :func:`guidemill.plans.ingest.decide`.  Rows come in any order; equal dates are ordered by hash.
    """

    def __init__(self, mode: str):
        self.mode = mode

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", STATE_DDL)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        newest, best = None, None
        for pdf in rows:
            for row in pdf.to_dict("records"):
                age = (row["updated"] is not None and row["updated"] == row["updated"], row["updated"] or 0, row["content_hash"] or "", row["raw"] or "")
                if best is None or age > best:
                    newest, best = row, age
        before = self.known.get() if self.known.exists() else None
        if newest["storable"] and (before is None or (self.mode != ingest.SKIP_EXISTING and (self.mode == ingest.FORCE_UPDATE or before[0] != newest["content_hash"]))):
            fixed = before[1:] if before is not None else (newest["authority"], newest["document_type"], int(newest["reliability_tier"]), newest["publication_date"])
            self.known.update((newest["content_hash"], *fixed))
        names = ("content_hash", *FIXED)
        yield pd.DataFrame([{"url": key[0], "raw": newest["raw"], "known": before is not None, **dict(zip(names, before or (None,) * len(names)))}])

    def close(self) -> None:
        pass


def arrivals(payloads: DataFrame, settings: ingest.IngestSettings) -> DataFrame:
    """What the state needs of each payload: address, age, hash, whether it can be stored, and the fields fixed at creation."""
    pages = ingest.pages_from_sources(source_rows(payloads, "raw"))
    auth = ingest.authority(F.col("url"), F.col("document_type"))
    storable = F.col("error").isNull() & F.coalesce(F.col("has_content"), F.lit(False)) & (F.col("word_count") >= settings.min_content_length // 5)
    return pages.select(
        "url", "raw", F.unix_micros("last_updated").alias("updated"), ingest.content_hash(F.col("full_text")).alias("content_hash"), F.coalesce(storable, F.lit(False)).alias("storable"),
        auth.alias("authority"), ingest.document_kind(F.col("schema_name"), F.col("document_type")).alias("document_type"), ingest.reliability_tier(auth).alias("reliability_tier"), F.to_date("first_published").cast("string").alias("publication_date"))


def publish_batch(decisions: DataFrame, batch_id: int, state: str, settings: ingest.IngestSettings = ingest.IngestSettings()) -> None:
    """Chunk the pages that the state found new or changed and publish them; a batch that is published already is left alone."""
    store = Publication(decisions.sparkSession, state)
    if store.latest() > batch_id:
        return
    ensure_checkpoint_dir(decisions.sparkSession)
    held = decisions.checkpoint()  # several outputs follow; the state is asked once
    before = {f.split()[0]: f for f in DOCUMENT_DDL.split(", ")}
    stored = held.where("known").select(*[
        (F.col(c).cast("date") if c == "publication_date" else F.col(c) if c in ("url", "content_hash", *FIXED) else ingest.document_id(F.col("url")) if c == "document_id" else F.lit(None)).cast(
            before[c].split(" ", 1)[1]).alias(c) for c in before])
    pages = ingest.pages_from_sources(source_rows(held.select("raw"), "raw")).withColumn("input_idx", F.monotonically_increasing_id())
    done = ingest.process(pages, stored, settings, materialize=True)
    rows = ingest.next_documents(stored, done, F.current_timestamp()).join(ingest.changed(done).select("document_id"), "document_id", "left_semi")
    store.publish({}, batch_id, append={"documents": rows, "chunks": ingest.new_chunks(done), "outcomes": ingest.outcomes(done)})


def current(spark: SparkSession, state: str, table: str = "documents", batch_id: int | None = None) -> DataFrame:
    """Documents or chunks as of a batch (default: the last one): per document the rows of its latest version."""
    store = Publication(spark, state)
    rows = store.read(table, store.latest() if batch_id is None else batch_id + 1)
    latest = rows.groupBy("document_id").agg(F.max("version").alias("version"))
    return rows.join(latest, ["document_id", "version"], "left_semi").drop("version", "attempt")


def start(spark: SparkSession, source: str, state: str, checkpoint: str, files_per_batch: int = 1000, settings: ingest.IngestSettings = ingest.IngestSettings()):
    """Start the stream over a folder of json-line payload files and stop when all present files are read.

    Payloads without an address, such as unreadable ones, meet under the empty address and leave one outcome a batch.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    lines = spark.readStream.schema(PAYLOAD_SCHEMA).option("maxFilesPerTrigger", files_per_batch).format("text").load(source).withColumnRenamed("value", "raw")
    asked = arrivals(lines, settings).withColumn("url", F.coalesce("url", F.lit("")))
    decided = asked.groupBy("url").transformWithStateInPandas(LatestPage(settings.mode), DECISION_DDL, "Update", "None")
    return (decided.writeStream.foreachBatch(lambda df, i: publish_batch(df, i, state, settings))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())

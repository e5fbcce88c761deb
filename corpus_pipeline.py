"""A corpus pipeline of five stages over ``documents``: quality, near-duplicates, benchmark, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns they were given.  Null ids are kept as they are; a null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guidemill.llm import contamination, quality, secrets, similar, simhash
from guidemill.llm.common import held_out, materialize
from guidemill.llm.components import connected_components
from guidemill.llm.queries import THRESHOLD, packed
from guidemill.sources.tables import read_table


#: Rows that travel between the JVM and a Python worker at a time.  A stage's memory for texts grows with it in both; no result depends on it.
BATCH_ROWS = 1024


def _small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python a few at a time; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at the threshold or above."""
    _small_batches(spark)
    return quality.filter_quality(docs, read_table(spark, sf_dir, "labels"), ~held_out(F.col("id"), 4, 2), threshold=THRESHOLD)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    Two documents link if their SimHash fingerprints differ in three bits or fewer, or if their five-word Jaccard similarity is
    0.8 or more: fingerprints miss most long texts with few changed words.  Rows of one id are one document and stay or go
    together; documents with a null id stay.
    """
    _small_batches(spark)
    texts = docs.select("doc_id", "text")
    marked = simhash.near_duplicates(texts).select("id", "component_id").unionByName(similar.similar_documents(texts))
    groups = connected_components(marked, "id", "component_id")
    gone = groups.where("node <> component").select(F.col("node").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    _small_batches(spark)
    return contamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of the secret scan is replaced by a mark; n_chars follows the text."""
    _small_batches(spark)
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences."""
    _small_batches(spark)
    return packed(docs)


STAGES = [("quality", keep_good), ("simhash", keep_one_of_each), ("decontamination", drop_benchmark), ("secrets", hide_secrets), ("packing", pack)]

#: Fingerprints, automata and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

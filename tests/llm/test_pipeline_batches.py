"""Texts travel to Python a few rows at a time, so a worker's and the JVM's memory for them stays small."""

import pyarrow as pa

import corpus_pipeline


def test_stages_bound_the_rows_of_a_batch(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(0, 5000, numPartitions=1).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    try:
        spark.conf.set(name, "10000")
        corpus_pipeline.hide_secrets(spark, docs.limit(3), "")

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

        most = max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect())
        assert most <= corpus_pipeline.BATCH_ROWS
        spark.conf.set(name, "100")
        corpus_pipeline._small_batches(spark)
        assert spark.conf.get(name) == "100"
    finally:
        spark.conf.set(name, before)

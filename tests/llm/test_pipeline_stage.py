"""The near-duplicate stage of the pipeline goes by fingerprints, too."""

import corpus_pipeline


def test_stage_drops_pairs_within_three_bits(spark):
    """Documents 6676 and 589 of sf0.1 differ in two bits at a similarity of 0.56; 3 and 589 are no pair."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id in (3, 589, 6676)")
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()) == [3, 589]

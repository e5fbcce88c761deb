"""Whole manuals are crawled without reading their payloads level by level."""

from guidemill.plans import ingest


def test_payloads_are_read_a_fixed_number_of_times(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    ddl = "base_path string, child_sections array<struct<path:string>>"
    rows = spark.createDataFrame([(f"/m/{i}", [(f"/m/{i + 1}",)] if i < 7 else None) for i in range(9)], ddl).mapInArrow(run, ddl)
    roots = spark.createDataFrame([("/m/1",), ("/m/none",)], "node string")
    assert sorted(r["base_path"] for r in ingest.manual_sources(rows, roots).collect()) == [f"/m/{i}" for i in range(1, 8)]
    assert seen.value <= 2 * 9

"""Plans that have to hold at scale."""

import re

import pytest

import __spark_entry__ as e

FOLDER = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    """Exchanges other than the spreading of a small input."""
    return [x for x in re.findall(r"Exchange [^\n]{0,200}", plan) if "REPARTITION_BY_NUM" not in x]


@pytest.mark.parametrize("name", [
    "chunk_documents", "legal_chunks", "parsed_pages", "page_links", "thresholds", "key_dates", "text_references", "deadline_items",
    "contact_items", "condition_lists", "worked_examples", "all_formulas", "table_cells"])
def test_text_work_is_narrow(spark, name):
    plan = physical(e.queries()[name](spark, FOLDER))
    assert exchanges(plan) == []
    assert plan.count("Generate ") <= (2 if name == "table_cells" else 1)


def test_lookup_reaches_the_scan(spark):
    plan = physical(e.queries()["document_lookup"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(page_id), EqualTo(page_id,3)]" in plan
    assert re.search(r"ReadSchema: struct<page_id:bigint,url:string>", plan)


def test_reports_combine_before_the_exchange(spark):
    for name in ("chunk_store_stats", "audit_stats", "structured_stats", "reference_stats"):
        plan = physical(e.queries()[name](spark, FOLDER))
        assert "partial_count" in plan and len(exchanges(plan)) <= 2, name

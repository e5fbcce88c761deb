"""All registered queries."""

from __future__ import annotations

from importlib import import_module

GROUPS = ["chunking", "extraction", "page_content", "reference_graph", "ingestion", "run_rows", "storage", "store_rounds", "history", "rules", "changes", "maintained"]


def all_queries() -> dict:
    found: dict = {}
    for g in GROUPS:
        for name, pair in import_module(f"guidemill.queries.{g}").QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = pair
    return found

"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = ("queries_quality", "queries_tokens", "queries_warc", "queries_langid", "queries_mixing", "queries_search", "queries_lines", "queries_spans", "queries_join", "queries_centroids", "queries_whitening", "queries_merges")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in importlib.import_module(f"{__package__}.{m}").SQL.items()}

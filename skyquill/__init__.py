"""Search-aware analytics on Spark: search predicates, bucket aggregates, versioned tables, side indexes and streams."""

from __future__ import annotations

import importlib

_PUBLIC = {
    "Table": "sources.table", "read_table": "sources.table", "write_table": "sources.table", "register": "sources.format", "Commands": "plans.commands", "FieldSpec": "plans.query_language",
    "search": "operators.search", "text_search": "operators.search", "field_match": "operators.search", "condition": "operators.search", "search_sql": "operators.search", "search_expr": "operators.search",
    "index_fields": "operators.search", "histogram": "functions.buckets", "date_histogram": "functions.buckets", "range_bucket": "functions.buckets", "bucket_counts": "functions.buckets", "sync": "sources.companion",
    "search_index": "sources.companion", "write_stream": "streaming.ingest",
}
__all__ = list(_PUBLIC)


def __getattr__(name: str):
    """Public names, imported when they are asked for."""
    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_PUBLIC[name]}"), name)

"""All queries on the engine's own operators."""

from __future__ import annotations

from docloom.plans import corpus_queries, markdown_queries, web_queries

MODULES = (web_queries, markdown_queries, corpus_queries)


def queries() -> dict:
    """Query callables by name."""
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    """DuckDB texts by name."""
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}

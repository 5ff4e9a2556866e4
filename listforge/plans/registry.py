"""Registered queries: one per operator, each with its DuckDB oracle where SQL can say it.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the whole driver tables.
The oracle SQL runs on DuckDB views with the table names.  Column names and
types agree on both sides (counts BIGINT, rates DOUBLE).
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from listforge.plans import (  # noqa: F401
        q_extract, q_filters, q_gather, q_labels, q_pages, q_reasoning, q_report, q_runs, q_stats, q_store, q_stream)

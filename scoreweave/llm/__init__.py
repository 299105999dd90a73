"""Operators for training-data pipelines, their queries and their SQL.

Nothing else in the library imports this subpackage. Every module holds one
operator with a general interface and, below it, the thin registered query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL if there is one."""

    def keep(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def load() -> None:
    """Import every operator, so that its query is registered."""
    from scoreweave.llm import (  # noqa: F401
        decontaminate,
        jaccard_join,
        lattice,
        merkle,
        packing,
        periodic_runs,
        quality,
        quotations,
        substring,
        surrogates,
        token_counts,
        toxicity,
        warc,
    )

"""Registry of the runnable queries: name -> (Spark callable, verification SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import integrity_queries, ledger_queries, portfolio_queries, scorecard_queries, stats_queries


def catalog() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    modules = (integrity_queries, ledger_queries, portfolio_queries, stats_queries, scorecard_queries)
    return {name: entry for m in modules for name, entry in m.QUERIES.items()}

"""All queries of the core: name -> function of (spark, sf_dir), and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search of all topics: four channels, rank fusion, relevance filter, diverse selection."""
    return QUERIES["search_contexts"](spark, sf_dir)


from scriptorium.queries import cleaning, dates, dedupe, graph, incremental, records, relational, retrieval, text, training, validation  # noqa: E402, F401

"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import index_queries, map_queries, sequence_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (map_queries, sequence_queries, index_queries)


def queries() -> dict[str, Query]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}

"""All queries of the core, by name, and the SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cell_queries, table_queries, widen_queries

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {**widen_queries.QUERIES, **cell_queries.QUERIES, **table_queries.QUERIES}
SQL: dict[str, str] = {**widen_queries.SQL, **cell_queries.SQL, **table_queries.SQL}

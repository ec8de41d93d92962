"""All queries over the reference's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaverlake.plans import assembly_queries, content_queries, model_queries, retrieval_queries, sequence_queries

FLAGSHIP = "seq_windows"
PARTS = (sequence_queries, content_queries, model_queries, retrieval_queries, assembly_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, f in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.oracle_sql().items()}

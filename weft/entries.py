"""The queries of the core library, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.queries import base, evaluation, graphs, retrieval, texts  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: dense and lexical legs for every query, fused by reciprocal ranks."""
    return retrieval.rrf_hybrid(spark, sf_dir)


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)

"""Views of the test tables that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def usable_hits(hits: DataFrame) -> DataFrame:
    """Hits with a query, namespace, leg, chunk and a score that is a number; NaN isn't one."""
    keys = ("query_id", "namespace", "leg", "chunk_id", "score")
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return hits.select(*keys).where(known & ~F.isnan("score"))


def current_chunks(chunks: DataFrame, *columns: str) -> DataFrame:
    """One row per chunk_id: the version with the latest ingested_at.

    A null time counts as the earliest; of several rows of one time the greatest values win, so
    that copies and input order don't matter. Rows without a chunk_id are dropped.
    """
    version = F.struct("ingested_at", *columns)
    return (
        chunks.where(F.col("chunk_id").isNotNull())
        .select("chunk_id", version.alias("_v"))
        .groupBy("chunk_id")
        .agg(F.max("_v").alias("_v"))
        .select("chunk_id", *[F.col(f"_v.{c}").alias(c) for c in columns])
    )

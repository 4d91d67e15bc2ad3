"""Chunk tables: upsert, lookup, filters, removal, statistics. A table is replaced as a whole, never half."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class NotFound(LookupError):
    """No row has the wanted id."""


CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("section_id", T.StringType()),
        T.StructField("section_path", T.ArrayType(T.StringType())),
        T.StructField("heading", T.StringType()),
        T.StructField("heading_level", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def safe_identifier(name: str) -> str:
    """The name, if it is a letter or underscore followed by letters, digits and underscores; else ValueError."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name or ""):
        raise ValueError(f"not a safe identifier: {name!r}")
    return name


def migrate(spark: SparkSession, table: str, schema: T.StructType = CHUNK_SCHEMA) -> None:
    """Create the table where it is missing, partitioned by namespace."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {safe_identifier(table)} ({columns}) USING parquet PARTITIONED BY (namespace)")


def matches(filters: Mapping[str, str] | None, metadata: str = "metadata") -> Column:
    """Whether the metadata has every wanted key with the wanted value; empty filters match all rows."""
    out = F.lit(True)
    for key, value in (filters or {}).items():
        out = out & F.coalesce(F.col(metadata)[key] == F.lit(value), F.lit(False))
    return out


def visible(chunks: DataFrame, filters: Mapping[str, str] | None = None, security: Mapping[str, str] | None = None) -> DataFrame:
    """Rows that satisfy the security filter and the caller's: the caller's can only narrow the result."""
    return chunks.where(matches(security)).where(matches(filters))


def latest(chunks: DataFrame, key: str = "chunk_id", time: str = "ingested_at") -> DataFrame:
    """One row per key, the one of the latest time; a null key is dropped, a null time is the earliest.

    Of several rows of one time the greatest other values win. Maps can't be compared, so they are
    taken along from the chosen row as entries.
    """
    maps = [f.name for f in chunks.schema.fields if isinstance(f.dataType, T.MapType)]
    fields = [F.array_sort(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in chunks.columns if c not in (key, time)]
    best = chunks.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(time), *fields)).alias("_best"))
    return best.select(*[F.col(key) if c == key else (F.map_from_entries(f"_best.{c}") if c in maps else F.col(f"_best.{c}")).alias(c) for c in chunks.columns])


def upsert(stored: DataFrame, arriving: DataFrame, key: str = "chunk_id", dimension: int | None = None, vector: str = "vector") -> DataFrame:
    """stored with the arriving rows in place of those of the same key; the key alone identifies a row, not its namespace.

    With a dimension, an arriving vector of another length fails the whole write when the result is read.
    """
    if dimension is not None:
        wrong = F.coalesce(F.size(vector), F.lit(-1)) != dimension
        arriving = arriving.withColumn(vector, F.when(wrong, F.raise_error(F.lit("vector dimension mismatch")).cast(arriving.schema[vector].dataType)).otherwise(F.col(vector)))
    return stored.join(arriving.select(key), key, "left_anti").unionByName(arriving)


def without_sources(stored: DataFrame, arriving: DataFrame, source: str = "source_id") -> DataFrame:
    """stored without the rows of any source that arrives again; an empty or null source removes nothing."""
    again = arriving.where(F.coalesce(F.col(source), F.lit("")) != "").select(source).distinct()
    return stored.join(again, source, "left_anti")


def replace_sources(stored: DataFrame, arriving: DataFrame, source: str = "source_id") -> DataFrame:
    """without_sources, plus the arriving rows; two arriving documents of one source both stay."""
    return without_sources(stored, arriving, source).unionByName(arriving)


def get(chunks: DataFrame, key: str, column: str = "chunk_id") -> DataFrame:
    """The row with this id; NotFound if there is none."""
    row = chunks.where(F.col(column) == key).limit(1)
    if row.isEmpty():
        raise NotFound(key)
    return row


def remove(chunks: DataFrame, key: str, column: str = "chunk_id") -> DataFrame:
    """The table without this id; NotFound if it isn't there."""
    get(chunks, key, column)
    return chunks.where(F.col(column).isNull() | (F.col(column) != key))


def remove_matching(chunks: DataFrame, filters: Mapping[str, str]) -> tuple[DataFrame, int]:
    """The table without the rows that match, and how many those are."""
    return chunks.where(~matches(filters)), chunks.where(matches(filters)).count()


def stats(chunks: DataFrame, vector: str = "vector") -> DataFrame:
    """(namespace, chunks, dim): rows of each namespace and the length of its longest vector."""
    return chunks.groupBy("namespace").agg(F.count("*").alias("chunks"), F.coalesce(F.max(F.greatest(F.size(vector), F.lit(0))), F.lit(0)).cast("long").alias("dim"))

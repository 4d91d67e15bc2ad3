"""Incremental import: each micro-batch of documents becomes chunks that replace their source's in a table of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.functions.guard import redacted
from weft.functions.text import lineage
from weft.functions.vectors import hash_embedding
from weft.operators import graph
from weft.operators.split import MAX_CHARS, OVERLAP, split_documents
from weft.operators.store import upsert, without_sources
from weft.session import cut


def import_chunks(documents: DataFrame, namespace: str, redact: bool = False, markdown: bool = False, size: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Documents (id, title, content, source_id, …) as chunks with lineage and vectors.

    section_id is namespace, document and last heading, or empty without headings.
    """
    if redact:
        documents = documents.withColumn("content", redacted(F.col("content")))
    pieces = split_documents(documents, "id", "content", markdown, size, overlap)
    about = documents.select("id", "title", "source_id", lineage(F.col("metadata"), source_id=F.col("source_id"), version=F.col("version"), checksum=F.col("checksum"), embedding_version=F.col("embedding_version")).alias("_m"))
    rows = pieces.join(about, "id")
    section = F.when(F.size("section_path") > 0, F.concat_ws(":", F.lit(namespace), "id", F.element_at("section_path", -1))).when(F.col("heading") != "", F.concat_ws(":", F.lit(namespace), "id", "heading")).otherwise("")
    marks = F.map_from_arrays(F.array(F.lit("chunk_index"), F.lit("chunk_total")), F.array(F.col("chunk_index").cast("string"), F.col("chunk_total").cast("string")))
    kept = F.map_filter("_m", lambda k, _: ~k.isin("chunk_index", "chunk_total"))
    return rows.select("chunk_id", F.lit(namespace).alias("namespace"), F.col("id").alias("doc_id"), "title", section.alias("section_id"), "section_path", "heading", "heading_level", "content", hash_embedding(F.col("content")).cast("array<float>").alias("vector"), F.map_concat(kept, marks).alias("metadata"), "source_id")


def import_counts(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunks, chunk_ids): what an import made of each document, ids in order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.col("metadata")["chunk_index"].cast("int").alias("i"), "chunk_id"))), lambda x: x["chunk_id"])
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), ids.alias("chunk_ids"))


def stale_chunks(stored: DataFrame, arriving: DataFrame, source: str = "source_id") -> DataFrame:
    """(chunk_id) of the stored chunks that an import removes: those of sources that arrive again, unless they arrive themselves."""
    again = arriving.where(F.coalesce(F.col(source), F.lit("")) != "").select(source).distinct()
    return stored.join(again, source, "left_semi").select("chunk_id").join(arriving.select("chunk_id"), "chunk_id", "left_anti")


def import_graph(stored: DataFrame, arriving: DataFrame, entities: DataFrame, relations: DataFrame, extract: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, entities, relations) after an import: sources replaced, stale chunks taken out of the graph, the new chunks' graph merged in.

    extract gives the entities and relations (as extracted, with source_chunk_ids) of chunks. A stored
    chunk that arrives again loses its old mentions too: they are what its new content says.
    """
    chunks = cut(upsert(without_sources(stored, arriving), arriving))
    old = stale_chunks(stored, arriving).unionByName(arriving.select("chunk_id")).distinct()
    found, links = extract(arriving)
    fresh = graph.canonical_entities(found)
    nodes = cut(graph.merge_entities(graph.remove_sources(entities, old), fresh))
    edges = cut(graph.merge_relations(graph.remove_sources(relations, old), graph.canonical_relations(links, nodes)))
    known = nodes.select(F.col("entity_id"))
    for end in ("source", "target"):
        edges = edges.join(known.withColumnRenamed("entity_id", end), end, "left_semi")
    return chunks, nodes, edges


#: Parts of a table of chunks; a source's chunks lie in one of them.
PARTS = 64


def _fs(spark: SparkSession, folder: str):  # noqa: ANN202
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether a finished write lies in the folder."""
    fs, path = _fs(spark, folder)
    return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The table of chunks in a folder."""
    return spark.read.parquet(folder).drop("_part")


def _replace_parts(spark: SparkSession, folder: str, touched: list[int], rows: DataFrame) -> None:
    """Put rows in place of what the touched parts hold; other parts stay as they are."""
    rows = cut(rows)  # so that no part is read while it is replaced
    left = {r[0] for r in rows.select("_part").distinct().collect()}  # at most PARTS numbers
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(folder)
    fs, path = _fs(spark, folder)
    for part in set(touched) - left:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, f"_part={part}"), True)


def commit(spark: SparkSession, folder: str, arriving: DataFrame, replace: bool = True) -> list[int]:
    """Write arriving chunks into the table of a folder and return the parts that changed.

    With replace, the chunks of every source that arrives again go first. A part changes as a whole
    or not at all; only parts that hold an arriving source or an arriving id are read and rewritten.
    The same chunks committed again leave the table as it is.
    """
    place = F.expr(f"cast(pmod(xxhash64(coalesce(source_id, ''), if(coalesce(source_id, '') = '', chunk_id, '')), {PARTS}) as int)")
    new = cut(arriving.withColumn("_part", place))
    touched = {r[0] for r in new.select("_part").distinct().collect()}
    if not exists(spark, folder):
        new.write.mode("overwrite").partitionBy("_part").parquet(folder)
        new.drop("_part").limit(0).write.parquet(f"{folder}/_part=-1")  # holds the schema of a table without rows
        return sorted(touched)
    stored = spark.read.parquet(folder)
    keys = stored.select("_part", "chunk_id", "source_id")
    touched |= {r[0] for r in keys.join(new.select("chunk_id"), "chunk_id", "left_semi").select("_part").distinct().collect()}
    old = stored.where(F.col("_part").isin(sorted(touched)))
    _replace_parts(spark, folder, sorted(touched), upsert(without_sources(old, new) if replace else old, new.select(*old.columns)))
    return sorted(touched)


def remove_chunks(spark: SparkSession, folder: str, gone: DataFrame) -> list[int]:
    """Take chunks (chunk_id) out of the table of a folder and return the parts that changed."""
    stored = spark.read.parquet(folder)
    touched = sorted(r[0] for r in stored.select("_part", "chunk_id").join(gone.select("chunk_id"), "chunk_id", "left_semi").select("_part").distinct().collect())
    if touched:
        _replace_parts(spark, folder, touched, stored.where(F.col("_part").isin(touched)).join(gone.select("chunk_id"), "chunk_id", "left_anti"))
    return touched


def import_stream(documents: DataFrame, folder: str, checkpoint: str, namespace: str, replace: bool = True, **options: object) -> StreamingQuery:
    """Import a stream of documents as far as it goes now. A batch that is tried again gives the same table: chunks are replaced by id."""

    def batch(rows: DataFrame, _: int) -> None:
        commit(rows.sparkSession, folder, import_chunks(rows, namespace, **options), replace)  # type: ignore[arg-type]

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

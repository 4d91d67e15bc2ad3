"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, fusion, knn, markup, packing, pii, split, subjects, topn, variants
from weft.llm.tables import current_chunks, read, usable_hits

Query = Callable[[SparkSession, str], DataFrame]

TOP = 5
CONTAINER = 1024
#: Bytes of text for one packing shard: about four bytes make a token.
SHARD_BYTES = 4 * CONTAINER * packing.SHARD_CONTAINERS


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["namespace", "query_id", "leg"]
    return topn.top_n(usable_hits(read(spark, sf_dir, "hits")), keys, "chunk_id", "score", TOP).select(*keys, "chunk_id")


def p1_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_n(usable_hits(read(spark, sf_dir, "hits")), ["namespace", "query_id", "leg"], "chunk_id", "score", TOP)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.linked_pairs(variants.name_classes(read(spark, sf_dir, "entities")))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.with_links(variants.name_classes(read(spark, sf_dir, "entities"))).select("entity_id", "kind", "class_id", "links")


def _chunk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = current_chunks(read(spark, sf_dir, "chunks"), "content", "section_path")
    return split.split_texts(chunks, "chunk_id", "content", sections="section_path")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_pieces(spark, sf_dir).where(F.col("piece") == 1).select("chunk_id")


def p3_chunk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_pieces(spark, sf_dir)


def p3_document_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_texts(read(spark, sf_dir, "documents"), "doc_id", "text")


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.nearest(current_chunks(read(spark, sf_dir, "chunks"), "namespace", "vector"), "namespace", "chunk_id", "vector")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.similar_pairs(_neighbours(spark, sf_dir), "chunk_id", 0.9)


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("namespace", "chunk_id", "neighbour", F.round("cosine", 6).alias("cosine"), "rank")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"), "doc_id", "text")


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(read(spark, sf_dir, "documents"), "doc_id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.structure(read(spark, sf_dir, "documents"), "doc_id", "text")


def p6_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_texts(read(spark, sf_dir, "documents"), "doc_id", "text")


def p6_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_headings(read(spark, sf_dir, "chunks"), "chunk_id", "heading")


def _listed(spark: SparkSession, sf_dir: str, table: str, column: str, most: int) -> list[str]:
    """The different values of a table that lists a system's parts; more than ``most`` of them are an error, not cut."""
    found = sorted(r[0] for r in read(spark, sf_dir, table).select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"{table} lists more than {most} values of {column}")
    return found


def _legs(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """The legs of the table of legs, weighted alike."""
    return dict.fromkeys(_listed(spark, sf_dir, "legs", "leg", 64), 1.0)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.unanimous_first(usable_hits(read(spark, sf_dir, "hits")), _legs(spark, sf_dir))


def p7_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = fusion.borda(usable_hits(read(spark, sf_dir, "hits")), _legs(spark, sf_dir))
    return ranked.select("query_id", "chunk_id", F.round("points", 4).alias("points"), "rank")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(read(spark, sf_dir, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tokens = bpe.encode_texts(documents, "doc_id", "text", lengths_only=True)
    return packing.pack(tokens, "doc_id", "n_tokens", CONTAINER, max(1, -(-size // SHARD_BYTES)))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_shares(spark, sf_dir).select("doc_id", "subject")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _listed(spark, sf_dir, "subjects", "subject", 1000)
    return subjects.subjects_of(read(spark, sf_dir, "documents"), read(spark, sf_dir, "doc_labels"), names)


def queries() -> dict[str, Query]:
    found = [p1_found, p1_top_scores, p2_found, p2_classes, p3_found, p3_chunk_pieces, p3_document_pieces, p4_found, p4_neighbours, p5_found, p5_redacted, p6_found, p6_text, p6_headings, p7_method, p7_found, p8_ids, p9_containers, p10_found, p10_shares]
    return {f.__name__: f for f in found}


_USABLE = """usable AS (
  SELECT query_id, namespace, leg, chunk_id, max(score) AS score FROM hits
  WHERE query_id IS NOT NULL AND namespace IS NOT NULL AND leg IS NOT NULL AND chunk_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
  GROUP BY ALL)"""
_TOP = f"""WITH {_USABLE}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY namespace, query_id, leg ORDER BY score DESC, chunk_id) AS rank FROM usable)
SELECT {{columns}} FROM ranked WHERE rank <= {TOP}"""
_CURRENT = """current AS (
  SELECT chunk_id, content, namespace FROM (
    SELECT chunk_id, content, namespace, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC, content DESC NULLS LAST) AS v FROM chunks WHERE chunk_id IS NOT NULL)
  WHERE v = 1)"""
_PLACES = f"""WITH {_USABLE}, scores AS (
  SELECT query_id, leg, chunk_id, max(score) AS score FROM usable WHERE leg IN (SELECT leg FROM legs) GROUP BY ALL), placed AS (
  SELECT *, rank() OVER (PARTITION BY query_id, leg ORDER BY score DESC) AS place, count(*) OVER (PARTITION BY query_id, leg, score) AS same,
    count(*) OVER (PARTITION BY query_id, leg) AS n FROM scores)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _TOP.format(columns="namespace, query_id, leg, chunk_id"),
        "p1_top_scores": _TOP.format(columns="namespace, query_id, leg, chunk_id, score, CAST(rank AS INTEGER) AS rank"),
        "p3_found": f"WITH {_CURRENT} SELECT chunk_id FROM current WHERE length(trim(content, E' \\t\\r\\n')) > 1200",
        "p4_found": """WITH newest AS (
  SELECT chunk_id, namespace, vector FROM (
    SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC, namespace DESC, vector DESC) AS v FROM chunks WHERE chunk_id IS NOT NULL) WHERE v = 1),
usable AS (
  SELECT chunk_id, namespace, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS v FROM newest
  WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
ranked AS (
  SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.v, b.v) AS c,
    row_number() OVER (PARTITION BY a.chunk_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.chunk_id) AS rank
  FROM usable a JOIN usable b ON a.namespace = b.namespace AND a.chunk_id <> b.chunk_id)
SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM ranked WHERE rank <= 5 AND c >= 0.9""",
        "p7_found": f"""{_PLACES}, unanimous AS (
  SELECT query_id, chunk_id FROM placed GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT leg) FROM legs) AND max(place) <= 3)
SELECT query_id, min(chunk_id) AS chunk_id FROM unanimous GROUP BY query_id HAVING count(*) = 1""",
        "p7_method": f"""{_PLACES}, items AS (SELECT query_id, chunk_id, count(*) OVER (PARTITION BY query_id) AS c FROM (SELECT DISTINCT query_id, chunk_id FROM placed)),
sizes AS (SELECT query_id, leg, max(n) AS n FROM placed GROUP BY ALL),
scored AS (
  SELECT i.query_id, i.chunk_id, sum(i.c - coalesce(p.place + (p.same - 1) / 2, (coalesce(s.n, 0) + 1 + i.c) / 2)) AS points
  FROM items i CROSS JOIN (SELECT DISTINCT leg FROM legs WHERE leg IS NOT NULL) l LEFT JOIN placed p ON p.query_id = i.query_id AND p.chunk_id = i.chunk_id AND p.leg = l.leg
  LEFT JOIN sizes s ON s.query_id = i.query_id AND s.leg = l.leg GROUP BY ALL)
SELECT query_id, chunk_id, round(points, 4) AS points, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, chunk_id) AS rank FROM scored""",
    }

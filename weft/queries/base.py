"""Views of the test tables that the queries share, in Spark and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.retrieve import lexical_top, prepare_queries
from weft.operators.store import latest
from weft.session import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


COLUMNS = ("chunk_id", "ingested_at", "namespace", "doc_id", "title", "section_path", "heading", "content")



def corpus(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The current version of every chunk; its namespace is its scope. Only the named columns are read, all without names."""
    kept = [c for c in COLUMNS if c in ("chunk_id", "ingested_at", "namespace", *(columns or COLUMNS))]
    return latest(read(spark, sf_dir, "chunks").select(*kept)).withColumn("scope", F.col("namespace"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_queries(read(spark, sf_dir, "queries"))


def lexical_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 hits with the query's and the chunk's texts; of the texts only those that were hit are gathered a second time."""
    questions = asked(spark, sf_dir)
    found = cut(lexical_top(questions, corpus(spark, sf_dir, "content")))
    rows = read(spark, sf_dir, "chunks").select(*COLUMNS).join(found.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return found.join(questions.select("query_id", "query_text", "top_k"), "query_id").join(latest(rows), "chunk_id")


# ---------------------------------------------------------------- SQL

SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def fields_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{SPACE}'), lambda t: t <> '')"


def tokens_sql(x: str) -> str:
    return f"""list_filter(list_transform(regexp_split_to_array(lower(coalesce({x}, '')), '{SPACE}'), lambda t: trim(t, '.,;:!?()[]{{}}"''')), lambda t: t <> '')"""


def buckets_sql(x: str) -> str:
    ascii_tokens = f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda t: t <> '')"
    return f"list_transform({ascii_tokens}, lambda t: list_reduce(list_prepend(5, list_transform(string_split(t, ''), lambda c: ascii(c))), lambda h, b: (xor(h, b) * 19) & 31))"


def counts_sql(buckets: str) -> str:
    return f"list_transform(range(32), lambda i: CAST(len(list_filter({buckets}, lambda b: b = i)) AS DOUBLE))"


def cosine_sql(a: str, b: str) -> str:
    size = f"sqrt(list_sum(list_transform({a}, lambda x: x * x))) * sqrt(list_sum(list_transform({b}, lambda x: x * x)))"
    return f"coalesce(least(1.0, greatest(0.0, list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2])) / nullif({size}, 0))), 0.0)"


CORPUS = """corpus AS (
  SELECT chunk_id, namespace AS scope, namespace, doc_id, title, coalesce(section_path, []) AS section_path, heading, content FROM (
    SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, namespace DESC, doc_id DESC, title DESC NULLS LAST, section_path DESC NULLS LAST, heading DESC NULLS LAST, content DESC NULLS LAST) AS v
    FROM chunks WHERE chunk_id IS NOT NULL) WHERE v = 1)"""
ASKED = f"""asked AS (
  SELECT query_id, scope, query_text, top_k FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY query_text, scope, top_k) AS v FROM (
      SELECT query_id, namespace AS scope, regexp_replace(query_text, '^{SPACE}|{SPACE}$', '', 'g') AS query_text, CAST(CASE WHEN top_k > 0 THEN top_k ELSE 5 END AS INTEGER) AS top_k
      FROM queries WHERE query_id IS NOT NULL AND namespace IS NOT NULL AND query_text IS NOT NULL) WHERE query_text <> '') WHERE v = 1)"""
BM25 = f"""
wanted AS (SELECT query_id, scope, top_k, unnest(list_distinct({tokens_sql("query_text")})) AS term FROM asked),
tokens AS (SELECT scope, chunk_id, {tokens_sql("content")} AS toks FROM corpus),
scopes AS (SELECT scope, count(*) AS n, avg(len(toks)) AS mean FROM tokens GROUP BY scope),
postings AS (SELECT scope, term, chunk_id, len, count(*) AS tf FROM (SELECT scope, chunk_id, len(toks) AS len, unnest(toks) AS term FROM tokens) GROUP BY ALL),
dfs AS (SELECT scope, term, count(*) AS df FROM postings GROUP BY ALL),
bm25 AS (
  SELECT w.query_id, p.chunk_id, w.top_k, round(sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.len / s.mean))), 6) AS score
  FROM wanted w JOIN postings p ON p.scope = w.scope AND p.term = w.term JOIN dfs d ON d.scope = w.scope AND d.term = w.term JOIN scopes s ON s.scope = w.scope
  GROUP BY ALL HAVING sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf) > 0)"""


def top_sql(table: str) -> str:
    return f"(SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {table}) WHERE rank <= top_k)"


LEXICAL = f"{CORPUS}, {ASKED}, {BM25}, lexical AS {top_sql('bm25')}"
HITS = f"{LEXICAL}, hitrows AS (SELECT l.*, a.query_text, a.top_k, c.namespace, c.doc_id, c.title, c.section_path, c.heading, c.content FROM lexical l JOIN asked a USING (query_id) JOIN corpus c USING (chunk_id))"
DENSE = f"""
qv AS (SELECT query_id, scope, top_k, {counts_sql("b")} AS v FROM (SELECT *, {buckets_sql("query_text")} AS b FROM asked)),
cv AS (SELECT chunk_id, scope, {counts_sql("b")} AS v FROM (SELECT chunk_id, scope, {buckets_sql("content")} AS b FROM corpus)),
dense_all AS (SELECT q.query_id, c.chunk_id, q.top_k, round({cosine_sql("q.v", "c.v")}, 6) AS score FROM qv q JOIN cv c USING (scope)),
dense AS {top_sql("dense_all")}"""

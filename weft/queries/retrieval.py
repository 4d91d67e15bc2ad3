"""Queries of retrieval: legs, fusion, structure, routes, variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.vectors import hash_counts
from weft.operators import retrieve as R
from weft.operators.match import cosine_top
from weft.queries.base import ASKED, BM25, CORPUS, DENSE, HITS, LEXICAL, SPACE, asked, buckets_sql, cosine_sql, corpus, counts_sql, lexical_hits, query, read, tokens_sql, top_sql


@query(f"WITH {LEXICAL} SELECT query_id, chunk_id, score, rank FROM lexical")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lexical_top(asked(spark, sf_dir), corpus(spark, sf_dir, "content"))


@query(f"SELECT doc_id, {counts_sql('b')} AS counts FROM (SELECT doc_id, {buckets_sql('text')} AS b FROM documents)")
def hash_embed_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", hash_counts(F.col("text")).alias("counts"))


@query(
    f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
pairs AS (SELECT a.vec_id, b.vec_id AS neighbour, round({cosine_sql("a.v", "b.v")}, 5) AS score FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT vec_id, neighbour, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour) AS rank FROM pairs) WHERE rank <= 5"""
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of the same label, for every vector: exact search within a namespace."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("scope"), F.col("vec_id").alias("query_id"), F.col("vec_id").alias("chunk_id"), F.lit(5).alias("top_k"), "embedding")
    best = cosine_top(rows.drop("chunk_id"), rows.drop("query_id", "top_k"), "embedding", "embedding", others=True)
    ranked = R.cut_top(best.withColumn("score", F.round("score", 5)))
    return ranked.select(F.col("query_id").alias("vec_id"), F.col("chunk_id").alias("neighbour"), "score", "rank")


@query(f"WITH {CORPUS}, {ASKED}, {DENSE} SELECT query_id, chunk_id, score, rank FROM dense")
def dense_text_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense_text_top(asked(spark, sf_dir), corpus(spark, sf_dir, "content"))


_FUSED = f"""WITH {LEXICAL}, {DENSE}, legs AS (SELECT query_id, chunk_id, rank, 0 AS lexical_rank, rank AS dense_rank FROM dense UNION ALL SELECT query_id, chunk_id, rank, rank, 0 FROM lexical),
fused_all AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score, max(dense_rank) AS dense_rank, max(lexical_rank) AS lexical_rank FROM legs GROUP BY ALL),
fused AS (SELECT f.*, a.top_k FROM fused_all f JOIN asked a USING (query_id)),
best AS {top_sql("fused")}"""


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, chunks = asked(spark, sf_dir), corpus(spark, sf_dir, "content")
    return R.fuse({"dense": R.dense_text_top(questions, chunks), "lexical": R.lexical_top(questions, chunks)}, questions)


@query(f"{_FUSED} SELECT query_id, chunk_id, score, rank FROM best")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir).select("query_id", "chunk_id", "score", "rank")


@query(f"{_FUSED} SELECT b.query_id, b.chunk_id, b.rank, f.dense_rank, f.lexical_rank FROM best b JOIN fused f USING (query_id, chunk_id)")
def rrf_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir).select("query_id", "chunk_id", "rank", "dense_rank", "lexical_rank")


@query(
    f"""WITH {CORPUS}, {ASKED}, q AS (SELECT query_id, scope, {tokens_sql("query_text")} AS t FROM asked), c AS (SELECT scope, chunk_id, {tokens_sql("content")} AS t FROM corpus)
SELECT query_id, chunk_id, CAST(len(list_filter(q.t, lambda x: list_contains(c.t, x))) AS INTEGER) AS overlap FROM q JOIN c USING (scope) WHERE len(list_filter(q.t, lambda x: list_contains(c.t, x))) > 0"""
)
def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lexical_overlap(asked(spark, sf_dir), corpus(spark, sf_dir, "content"))


_PATHS = "prefixes AS (SELECT DISTINCT scope, doc_id, section_path[1:n] AS path FROM (SELECT scope, doc_id, section_path, unnest(range(1, len(section_path) + 1)) AS n FROM corpus))"


@query(
    f"""WITH {CORPUS}, {_PATHS} SELECT scope AS namespace, doc_id, doc_id || ':' || array_to_string(path, '/') AS node_id, CAST(len(path) AS INTEGER) AS level,
  CASE WHEN len(path) > 1 THEN doc_id || ':' || array_to_string(path[1:len(path) - 1], '/') ELSE doc_id || ':root' END AS parent_id FROM prefixes"""
)
def section_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sections(corpus(spark, sf_dir, "doc_id", "section_path")).select(F.col("scope").alias("namespace"), "doc_id", "node_id", "level", "parent_id")


@query(
    f"""WITH {CORPUS} SELECT scope AS namespace, doc_id, chunk_id, CASE WHEN len(section_path) > 0 THEN doc_id || ':' || array_to_string(section_path, '/') ELSE doc_id || ':root' END AS parent_id
FROM corpus WHERE regexp_replace(coalesce(content, ''), '{SPACE}', '', 'g') <> ''"""
)
def section_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.leaves(corpus(spark, sf_dir, "doc_id", "section_path", "content")).select(F.col("scope").alias("namespace"), "doc_id", "chunk_id", "parent_id")


_COUNT = "len(list_filter(q.t, lambda x: contains({0}, x)))"
_STRUCTURE = f"""WITH {CORPUS}, {ASKED}, q AS (SELECT query_id, scope, top_k, {tokens_sql("query_text")} AS t FROM asked),
titles AS (SELECT scope, doc_id, arg_min(title, chunk_id) AS doc_title FROM corpus WHERE title IS NOT NULL GROUP BY ALL),
c AS (SELECT scope, chunk_id, list_transform(section_path, lambda p: lower(p)) AS p, lower(coalesce(doc_title, '')) AS dt, lower(coalesce(title, '')) AS own, lower(coalesce(heading, '')) AS h,
  {tokens_sql("content")} AS toks, regexp_replace(coalesce(content, ''), '{SPACE}', '', 'g') <> '' AS filled FROM corpus LEFT JOIN titles USING (scope, doc_id)),
pairs AS (SELECT q.query_id, c.chunk_id, q.top_k, c.filled, c.h <> '' AS hh, list_transform(c.p, lambda s: len(list_filter(q.t, lambda x: contains(s, x)))) AS l,
  CASE WHEN c.dt <> '' THEN {_COUNT.format("c.dt")} ELSE 0 END AS dt, CASE WHEN c.own <> '' THEN {_COUNT.format("c.own")} ELSE 0 END AS own, CASE WHEN c.h <> '' THEN {_COUNT.format("c.h")} ELSE 0 END AS h,
  len(list_filter(q.t, lambda x: list_contains(c.toks, x))) AS o FROM q JOIN c USING (scope)),
levels AS (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM pairs WHERE filled),
sections AS (SELECT query_id, chunk_id, top_k, o, i, len(l) - i + 1 AS below, 2.0 * (list_sum(l[1:i]) + l[i] + dt) AS m FROM levels),
direct AS (SELECT query_id, chunk_id, top_k, round(max(m + 0.2 * i + 1.5 + 0.1 * (8 - below) + 0.5) + 0.5 * max(o), 6) AS score FROM sections WHERE m > 0 AND below <= 8 GROUP BY query_id, chunk_id, top_k),
own AS (SELECT query_id, chunk_id, top_k, 2.0 * (coalesce(list_sum(l), 0) + h + own) AS s, h, len(l) AS depth, o FROM pairs),
fallback AS (SELECT query_id, chunk_id, top_k, round(CASE WHEN s > 0 THEN s + 1.5 * h + 0.1 * depth ELSE 0.5 * o END, 6) AS score FROM own WHERE query_id NOT IN (SELECT query_id FROM direct)),
scored AS (SELECT * FROM direct UNION ALL SELECT * FROM fallback WHERE score > 0)"""


@query(f"{_STRUCTURE} SELECT query_id, chunk_id, score, rank FROM {top_sql('scored')}")
def structure_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cut_top(R.structure(asked(spark, sf_dir), corpus(spark, sf_dir)))


_ROUTES = f"""{CORPUS}, {ASKED}, rq AS (SELECT query_id, scope, {tokens_sql("query_text")} AS t FROM asked),
firsts AS (SELECT scope, section_path AS path, arg_min({{'heading': heading, 'title': title}}, chunk_id) AS f FROM corpus WHERE len(section_path) > 0 GROUP BY ALL),
spaces AS (SELECT scope, path, list_concat(list_transform(path, lambda p: lower(p)), list_filter([lower(f.heading), lower(f.title)], lambda x: x IS NOT NULL AND x <> '')) AS s FROM firsts),
rscored AS (SELECT q.query_id, q.scope, s.path, list_sum(list_transform(s.s, lambda y: len(list_filter(q.t, lambda x: contains(y, x))))) AS hits FROM rq q JOIN spaces s USING (scope)),
rplaced AS (SELECT query_id, scope, path, round(2.0 * hits + 0.2 * len(path), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(2.0 * hits + 0.2 * len(path), 6) DESC, len(path) DESC, array_to_string(path, '/')) AS place
  FROM rscored WHERE hits > 0 AND round(2.0 * hits + 0.2 * len(path), 6) >= 2),
routes AS (SELECT *, round(score / max(score) OVER (PARTITION BY query_id), 6) AS confidence FROM rplaced WHERE place <= 3)"""
_PLAN = f"""{_ROUTES}, kept AS (SELECT *, lead(confidence) OVER (PARTITION BY query_id ORDER BY place) AS second FROM routes WHERE confidence >= 0.6 OR place = 1),
led AS (SELECT *, max(CASE WHEN place = 1 THEN confidence - second END) OVER (PARTITION BY query_id) AS lead FROM kept),
plan AS (SELECT query_id, scope, path, confidence, CAST(place AS INTEGER) AS place, CASE WHEN round(lead, 6) >= 0.3 THEN 'converged' ELSE 'fanout' END AS mode FROM led
  WHERE place <= CASE WHEN round(lead, 6) >= 0.3 THEN 1 ELSE 2 END)"""


@query(f"WITH {_ROUTES} SELECT query_id, array_to_string(path, ' > ') AS path, score, confidence, CAST(place AS INTEGER) AS place FROM routes")
def route_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.route_candidates(asked(spark, sf_dir), corpus(spark, sf_dir, "title", "section_path", "heading"))
    return found.select("query_id", F.array_join("path", " > ").alias("path"), "score", "confidence", "place")


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.plan_routes(R.route_candidates(asked(spark, sf_dir), corpus(spark, sf_dir, "title", "section_path", "heading")), gap=0.3, fanout=2)


@query(f"WITH {_PLAN} SELECT query_id, array_to_string(path, ' > ') AS path, confidence, place, mode FROM plan")
def route_gap_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("query_id", F.array_join("path", " > ").alias("path"), "confidence", "place", "mode")


def _renamed(sql: str) -> str:
    return sql.replace("asked", "rasked").replace("corpus", "rcorpus")


_FANOUT = f"""WITH {_PLAN},
rasked AS (SELECT a.query_id || '|' || array_to_string(list_transform(p.path, lambda x: lower(x)), '/') AS query_id, a.query_id AS whole, p.scope || '|' || array_to_string(list_transform(p.path, lambda x: lower(x)), '/') AS scope, a.query_text, a.top_k, p.confidence
  FROM asked a JOIN plan p USING (query_id)),
kinds AS (SELECT DISTINCT scope, list_transform(path, lambda x: lower(x)) AS path FROM plan),
rcorpus AS (SELECT c.chunk_id, c.content, k.scope || '|' || array_to_string(k.path, '/') AS scope FROM corpus c JOIN kinds k ON k.scope = c.scope AND list_transform(c.section_path[1:len(k.path)], lambda x: lower(x)) = k.path),
{_renamed(BM25)}, found AS {top_sql("bm25")},
merged AS (SELECT r.whole AS query_id, f.chunk_id, r.top_k, max(round(f.score + r.confidence, 6)) AS score FROM found f JOIN rasked r USING (query_id) GROUP BY ALL)
SELECT query_id, chunk_id, score, rank FROM {top_sql("merged")}"""


@query(_FANOUT)
def route_fanout_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.route_fanout(asked(spark, sf_dir), corpus(spark, sf_dir, "section_path", "content"), _plan(spark, sf_dir))


_PARTS = f"""parts AS (SELECT query_id, scope, top_k, CASE WHEN len(p) > 1 THEN p ELSE [query_text] END AS p FROM (
  SELECT *, list_filter(list_transform(regexp_split_to_array(query_text, '(?i)\\s+and\\s+'), lambda x: trim(x)), lambda x: len(x) >= 3) AS p FROM asked)),
subs AS (SELECT query_id, scope, top_k, CAST(unnest(range(len(p))) AS INTEGER) AS "order", unnest(p) AS query_text FROM parts)"""


@query(f'WITH {ASKED}, {_PARTS} SELECT query_id, "order", query_text FROM subs')
def multihop_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sub_questions(asked(spark, sf_dir)).select("query_id", "order", "query_text")


@query(
    f"""WITH {CORPUS}, {ASKED}, {_PARTS}, vasked AS (SELECT query_id || '|' || "order" AS query_id, query_id AS whole, scope, query_text, top_k FROM subs),
{BM25.replace("asked", "vasked")}, found AS {top_sql("bm25")},
merged AS (SELECT v.whole AS query_id, f.chunk_id, v.top_k, max(f.score) AS score FROM found f JOIN vasked v USING (query_id) GROUP BY ALL)
SELECT query_id, chunk_id, score, rank FROM {top_sql("merged")}"""
)
def variant_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.multi_hop(asked(spark, sf_dir), corpus(spark, sf_dir, "content"))


@query(
    f"""WITH {_ROUTES}, twice AS (SELECT query_id, path, score FROM routes UNION ALL SELECT query_id, path, score FROM routes WHERE place = 1),
summed AS (SELECT query_id, path, round(sum(score), 6) AS score FROM twice GROUP BY ALL)
SELECT query_id, array_to_string(path, ' > ') AS path, score, round(score / max(score) OVER (PARTITION BY query_id), 6) AS confidence FROM summed"""
)
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.route_candidates(asked(spark, sf_dir), corpus(spark, sf_dir, "title", "section_path", "heading"))
    both = found.select("query_id", "path", "score").unionByName(found.where("place = 1").select("query_id", "path", "score"))
    return R.merge_candidates(both).select("query_id", F.array_join("path", " > ").alias("path"), "score", "confidence")


@query(
    f"""WITH {LEXICAL}, {DENSE}, united AS (SELECT query_id, chunk_id, max(score) AS score, 4 AS top_k FROM (SELECT query_id, chunk_id, score FROM lexical UNION ALL SELECT query_id, chunk_id, score FROM dense) GROUP BY ALL)
SELECT query_id, chunk_id, score, rank FROM {top_sql("united")}"""
)
def hit_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, chunks = asked(spark, sf_dir), corpus(spark, sf_dir, "content")
    return R.union_hits(R.lexical_top(questions, chunks), R.dense_text_top(questions, chunks), 4)


@query(
    f"""WITH {_PLAN}, best1 AS (SELECT query_id, scope, path, 0.0 AS confidence FROM routes WHERE place = 1),
rasked AS (SELECT a.query_id || '|' || array_to_string(list_transform(p.path, lambda x: lower(x)), '/') AS query_id, a.query_id AS whole, p.scope || '|' || array_to_string(list_transform(p.path, lambda x: lower(x)), '/') AS scope, a.query_text, a.top_k
  FROM asked a JOIN best1 p USING (query_id) UNION ALL SELECT query_id || '|', query_id, scope, query_text, top_k FROM asked WHERE query_id NOT IN (SELECT query_id FROM best1)),
kinds AS (SELECT DISTINCT scope, list_transform(path, lambda x: lower(x)) AS path FROM best1),
rcorpus AS (SELECT c.chunk_id, c.content, k.scope || '|' || array_to_string(k.path, '/') AS scope FROM corpus c JOIN kinds k ON k.scope = c.scope AND list_transform(c.section_path[1:len(k.path)], lambda x: lower(x)) = k.path UNION ALL SELECT chunk_id, content, scope FROM corpus),
{_renamed(BM25)}, found AS {top_sql("bm25")}
SELECT r.whole AS query_id, f.chunk_id, f.score, f.rank FROM found f JOIN rasked r USING (query_id)"""
)
def auto_route_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical search inside each query's best route; everywhere for queries without one."""
    return R.auto_routed(asked(spark, sf_dir), corpus(spark, sf_dir, "title", "section_path", "heading", "content"), R.lexical_top)


@query()
def route_policy_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search in up to two planned routes of each query."""
    base = lambda q, c: R.fuse({"dense": R.dense_text_top(q, c), "lexical": R.lexical_top(q, c)}, q).select("query_id", "chunk_id", "score", "rank")
    return R.search_by_policy(asked(spark, sf_dir), corpus(spark, sf_dir, "title", "section_path", "heading", "content"), base, fanout=2, gap=0.3)


@query(f"WITH {HITS} SELECT query_id, array_to_string(flatten(list(section_path ORDER BY rank)), ' > ') AS trail FROM hitrows GROUP BY query_id")
def section_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexical_hits(spark, sf_dir).withColumn("section_id", F.lit(""))
    return R.section_trail(rows).select("query_id", F.array_join("trail", " > ").alias("trail"))


@query(
    f"""WITH {LEXICAL}, {_ROUTES.split("rq AS", 1)[0].replace(CORPUS + ", " + ASKED + ", ", "")}rq AS {_ROUTES.split("rq AS", 1)[1]}
SELECT a.query_id, coalesce(array_to_string(r.path, ' > '), '') AS route, coalesce(r.confidence, 0.0) AS confidence, coalesce(h.n, 0) AS hit_count, coalesce(h.ids, '') AS hit_ids
FROM asked a LEFT JOIN (SELECT * FROM routes WHERE place = 1) r USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n, string_agg(chunk_id, ',' ORDER BY rank) AS ids FROM lexical GROUP BY query_id) h USING (query_id)"""
)
def route_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, chunks = asked(spark, sf_dir), corpus(spark, sf_dir, "title", "section_path", "heading", "content")
    steps = R.trajectory(questions, R.lexical_top(questions, chunks), R.route_candidates(questions, chunks))
    return steps.select("query_id", F.array_join("route", " > ").alias("route"), "confidence", "hit_count", F.array_join("hit_ids", ",").alias("hit_ids"))


__all__ = ["hybrid", "lexical_hits"]

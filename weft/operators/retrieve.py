"""Retrieval legs over tables of queries: dense, lexical, structure and graph, their routes and their fusion.

A query row has query_id, scope, query_text and top_k; a corpus row has chunk_id, scope and the chunk's
columns. scope is what a query may see: its namespace, or a namespace with a route. Every leg joins by
scope or by scope and term, so there is no product of all queries with all chunks. Ties are always
broken by the smaller chunk_id, on scores rounded to six decimals.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.text import search_tokens
from weft.functions.vectors import hash_embedding
from weft.operators.match import DIGITS, Tokens, cosine_top, firsts, in_blocks
from weft.session import cut

K1, B = 1.2, 0.75
RRF_K = 60
ROUTE_MIN_SCORE, ROUTE_CANDIDATES, ROUTE_CONFIDENCE = 2.0, 3, 0.6
EXPANSION_DEPTH = 8


def prepare_queries(queries: DataFrame, scope: str = "namespace", default_k: int = 5) -> DataFrame:
    """(query_id, scope, query_text, top_k): different queries with a text; null or non-positive top_k gives the default.

    Copies count once; of several texts under one id the smallest counts.
    """
    text = F.regexp_replace(F.col("query_text"), r"(?U)^\s+|\s+$", "")
    known = queries.where(F.col("query_id").isNotNull() & F.col(scope).isNotNull() & F.col("query_text").isNotNull())
    slim = known.select("query_id", F.struct(text.alias("query_text"), F.col(scope).alias("scope"), F.when(F.col("top_k") > 0, F.col("top_k").cast("int")).otherwise(default_k).alias("top_k")).alias("_q"))
    one = slim.where(F.col("_q.query_text") != "").groupBy("query_id").agg(F.min("_q").alias("_q"))
    return one.select("query_id", "_q.scope", "_q.query_text", "_q.top_k")


def cut_top(scored: DataFrame, k: str = "top_k") -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best of each query; scores are rounded first."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    ranked = scored.withColumn("score", F.round("score", DIGITS)).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= F.col(k)).select("query_id", "chunk_id", "score", "rank")


def bm25(queries: DataFrame, corpus: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, chunk_id, score, top_k): Okapi BM25 of every chunk that shares a term with a query.

    A query's different terms count once. Chunks without tokens count among the scope's documents.
    k1 and b of 0 mean their defaults.
    """
    k1, b = k1 or K1, b or B
    wanted = queries.select("query_id", "scope", "top_k", F.explode(F.array_distinct(search_tokens(F.col("query_text")))).alias("term"))
    tokens = corpus.select("scope", "chunk_id", search_tokens(F.col("content")).alias("_tokens")).withColumn("_length", F.size("_tokens"))
    scope = tokens.groupBy("scope").agg(F.count("*").alias("_n"), F.avg("_length").alias("_mean"))
    postings = (
        tokens.select("scope", "chunk_id", "_length", F.explode("_tokens").alias("term"))
        .join(wanted.select("scope", "term").distinct(), ["scope", "term"], "left_semi")
        .groupBy("scope", "term", "chunk_id", "_length")
        .agg(F.count("*").alias("_tf"))
    )
    found = postings.groupBy("scope", "term").agg(F.count("*").alias("_df")).join(scope, "scope")
    rarity = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    terms = wanted.join(found.withColumn("_idf", rarity), ["scope", "term"])
    length = 1 - b + b * F.col("_length") / F.col("_mean")
    part = F.col("_idf") * F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * length)
    return postings.join(terms, ["scope", "term"]).groupBy("query_id", "chunk_id", "top_k").agg(F.sum(part).alias("score")).where(F.col("score") > 0)


def lexical_top(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    return cut_top(bm25(queries, corpus))


def dense(queries: DataFrame, corpus: DataFrame, query_vector: str, vector: str) -> DataFrame:
    """(query_id, chunk_id, score, rank): the top_k chunks of a query's scope by clamped cosine, exactly."""
    return cut_top(cosine_top(queries, corpus, query_vector, vector))


def dense_text_top(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Dense leg over hash embeddings of the texts."""
    q = queries.withColumn("_qv", hash_embedding(F.col("query_text")))
    c = corpus.select("scope", "chunk_id", hash_embedding(F.col("content")).alias("_cv"))
    return dense(q, c, "_qv", "_cv")


def fuse(legs: Mapping[str, DataFrame], queries: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, score, rank, rank of each leg): reciprocal rank fusion; a leg's rank is 0 where it lacks the chunk."""
    if not legs:
        raise ValueError("at least one leg is needed")
    rows = None
    for name, leg in legs.items():
        part = leg.select("query_id", "chunk_id", F.lit(name).alias("_leg"), F.col("rank").alias("_rank"))
        rows = part if rows is None else rows.unionByName(part)
    ranks = [F.coalesce(F.max(F.when(F.col("_leg") == name, F.col("_rank"))), F.lit(0)).alias(f"{name}_rank") for name in legs]
    fused = rows.groupBy("query_id", "chunk_id").agg(F.sum(1 / (k + F.col("_rank"))).alias("score"), *ranks)
    top = cut_top(fused.join(queries.select("query_id", "top_k"), "query_id"))
    return top.join(fused.drop("score"), ["query_id", "chunk_id"])


# ---------------------------------------------------------------- structure and routes


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, scope, top_k, needle, times): the different tokens of each query and how often it has them."""
    asked = queries.select("query_id", "scope", "top_k", F.explode(search_tokens(F.col("query_text"))).alias("needle"))
    return asked.groupBy("query_id", "scope", "top_k", "needle").agg(F.count("*").alias("times"))


def _space(path: Column, heading: Column, title: Column) -> Column:
    extra = F.filter(F.array(F.lower(heading), F.lower(title)), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.concat(F.transform(path, lambda p: F.lower(p)), extra)


def _path(column: str = "section_path") -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def sections(corpus: DataFrame) -> DataFrame:
    """(scope, doc_id, path, level, node_id, parent_id): the section nodes of every document's tree, one per path prefix."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("_p")), lambda n: F.slice(F.col("_p"), 1, n))
    nodes = corpus.withColumn("_p", _path()).where(F.size("_p") > 0).select("scope", "doc_id", F.explode(prefixes).alias("path")).distinct()
    key = F.concat(F.col("doc_id"), F.lit(":"), F.array_join("path", "/"))
    parent = F.when(F.size("path") > 1, F.concat(F.col("doc_id"), F.lit(":"), F.array_join(F.slice("path", 1, F.size("path") - 1), "/"))).otherwise(F.concat("doc_id", F.lit(":root")))
    return nodes.select("scope", "doc_id", "path", F.size("path").alias("level"), key.alias("node_id"), parent.alias("parent_id"))


def leaves(corpus: DataFrame) -> DataFrame:
    """(scope, doc_id, chunk_id, parent_id): the chunks with content under their section, or under the root."""
    path = _path()
    parent = F.when(F.size(path) > 0, F.concat(F.col("doc_id"), F.lit(":"), F.array_join(path, "/"))).otherwise(F.concat("doc_id", F.lit(":root")))
    return corpus.where(F.regexp_replace(F.coalesce("content", F.lit("")), r"(?U)\s+", "") != "").select("scope", "doc_id", "chunk_id", parent.alias("parent_id"))


def structure(queries: DataFrame, corpus: DataFrame, depth: int = EXPANSION_DEPTH) -> DataFrame:
    """(query_id, chunk_id, score, top_k): chunks under sections whose path, heading or title has tokens of the query.

    A matching section has 2 points per (text, token) and 0.2 per level. Its chunks add 1.5, 0.1 for
    every level that they are less than depth below it, 0.5 for being on its path and half their
    token overlap; the best section counts. A query that matches no section anywhere falls back on the
    chunks' own headings, or half their overlap. A document's title is that of its first chunk.
    """
    titles = corpus.groupBy("scope", "doc_id").agg(F.min_by("title", "chunk_id").alias("_doc_title"))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    full = F.regexp_replace(F.coalesce("content", F.lit("")), r"(?U)\s+", "") != ""
    chunks = corpus.join(titles, ["scope", "doc_id"]).select("scope", "chunk_id", F.transform(_path(), lambda p: F.lower(p)).alias("_p"), low("_doc_title").alias("_t"), low("title").alias("_own"), low("heading").alias("_h"), full.alias("_full"), F.array_distinct(search_tokens(F.col("content"))).alias("_words"))
    asked = queries.select("scope", "query_id", F.col("top_k").cast("int").alias("top_k"), search_tokens(F.col("query_text")).alias("_tokens"))

    def judge(q: pa.Table, c: pa.Table) -> pa.Table:
        """The best chunks of each query by section, and those by their own headings, of this block."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = []
        if q.num_rows and c.num_rows:
            tokens, place = Tokens(q["_tokens"].to_pylist()), {"": -1}
            of = lambda text: place.setdefault(text, len(place) - 1) if text is not None else -1
            paths = [[of(x) for x in path] for path in c["_p"].to_pylist()]
            title, own_title, heading = (np.array([of(x) for x in c[name].to_pylist()]) for name in ("_t", "_own", "_h"))
            size, filled = np.array([len(x) for x in paths]), c["_full"].to_numpy()
            levels = np.full((len(paths), int(size.max(initial=0))), -1)
            for i, path in enumerate(paths):
                levels[i, : len(path)] = path
            hits = tokens.in_texts([t for t in place if t])
            overlap, ks = tokens.among(c["_words"].to_pylist()), q["top_k"].to_numpy()
            for at in range(0, q.num_rows, 256):
                some, shared, k = hits[at : at + 256], 0.5 * overlap[at : at + 256].astype(np.float64), ks[at : at + 256, None]
                above, best = np.zeros(shared.shape), np.full(shared.shape, -np.inf)
                for i in range(1, levels.shape[1] + 1):
                    here = some[:, levels[:, i - 1]]
                    above = above + here
                    matched, below = 2.0 * (above + here + some[:, title]), size - i + 1
                    fits = (matched > 0) & (filled & (size >= i) & (below <= depth))
                    best = np.where(fits, np.maximum(best, matched + 0.2 * i + 1.5 + 0.1 * (depth - below) + 0.5), best)
                own = 2.0 * (above + some[:, heading] + some[:, own_title])
                alone = np.where(own > 0, own + 1.5 * some[:, heading] + 0.1 * size, shared)
                for scores, by_section in ((best + shared, True), (np.where(alone > 0, alone, -np.inf), False)):
                    r, x = np.nonzero(firsts(np.round(scores, DIGITS), k))
                    out.append((at + r, x, scores[r, x], by_section))
        r, x = (pa.array(np.concatenate([np.empty(0, np.int64), *[o[i] for o in out]])) for i in (0, 1))
        scores = np.concatenate([np.empty(0), *[o[2] for o in out]])
        return pa.table({"query_id": q["query_id"].take(r), "chunk_id": c["chunk_id"].take(x), "score": pa.array(scores), "top_k": q["top_k"].take(r), "_section": pa.array([o[3] for o in out for _ in o[0]], pa.bool_())})

    found = in_blocks(asked, chunks, "chunk_id", judge, f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id string, score double, top_k int, _section boolean")
    # a query that matched a section in any block has no fallback
    matched = found.withColumn("_any", F.max("_section").over(Window.partitionBy("query_id")))
    return matched.where(F.col("_section") == F.col("_any")).select("query_id", "chunk_id", "score", "top_k")


def route_candidates(queries: DataFrame, corpus: DataFrame, least: float = ROUTE_MIN_SCORE, most: int = ROUTE_CANDIDATES) -> DataFrame:
    """(query_id, scope, path, score, confidence, place): the section paths that fit a query best.

    A path is judged by its first chunk's path, heading and title. Equal scores: longer paths, then
    the smaller path. confidence is the score over the query's best.
    """
    heads = corpus.withColumn("_p", _path()).where(F.size("_p") > 0).groupBy("scope", F.col("_p").alias("path")).agg(F.min_by(F.struct("heading", "title"), "chunk_id").alias("_f"))
    key = F.concat(F.lpad((1000 - F.size("path")).cast("string"), 4, "0"), F.array_join("path", "/"))  # in the order of ties
    spaces = heads.select("scope", key.alias("_key"), "path", _space(F.col("path"), F.col("_f.heading"), F.col("_f.title")).alias("_s"))
    asked = queries.select("scope", "query_id", search_tokens(F.col("query_text")).alias("_tokens"))
    least, most = least or ROUTE_MIN_SCORE, most or ROUTE_CANDIDATES

    def judge(q: pa.Table, c: pa.Table) -> pa.Table:
        rows, columns, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if q.num_rows and c.num_rows:
            tokens, place = Tokens(q["_tokens"].to_pylist()), {"": -1}
            spaces = c["_s"].to_pylist()
            at = [(place.setdefault(t, len(place) - 1), i) for i, s in enumerate(spaces) for t in s if t]
            hits = tokens.in_texts([t for t in place if t])
            held = np.zeros((hits.shape[1], len(spaces)), np.float32)
            if at:
                np.add.at(held, tuple(np.array(at).T), 1)
            points = 2.0 * (hits @ held).astype(np.float64)
            total = np.round(points + 0.2 * np.array([len(p) for p in c["path"].to_pylist()]), DIGITS)
            seen = np.where((points > 0) & (total >= least), total, -np.inf)
            rows, columns = np.nonzero(firsts(seen, np.full((len(seen), 1), most)))
            scores = seen[rows, columns]
        r, x = pa.array(rows), pa.array(columns)
        return pa.table({"query_id": q["query_id"].take(r), "scope": q["scope"].take(r), "path": c["path"].take(x), "score": pa.array(scores)})

    scored = in_blocks(asked, spaces, "_key", judge, f"query_id {queries.schema['query_id'].dataType.simpleString()}, scope string, path array<string>, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.size("path")), F.asc(F.array_join("path", "/")))
    kept = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return kept.withColumn("confidence", F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), DIGITS))


def plan_routes(candidates: DataFrame, threshold: float = ROUTE_CONFIDENCE, gap: float = 0.0, fanout: int = 1) -> DataFrame:
    """(query_id, scope, path, confidence, place, mode): the routes to search.

    Candidates of the threshold or more stay, else the first one. With a gap, a first one that leads
    the second by it or more is taken alone (converged); otherwise up to fanout are.
    """
    whole = Window.partitionBy("query_id")
    order = whole.orderBy("place")
    kept = candidates.where((F.col("confidence") >= (threshold or ROUTE_CONFIDENCE)) | (F.col("place") == 1))
    second = kept.withColumn("_second", F.lead("confidence").over(order))
    lead = F.first(F.when(F.col("place") == 1, F.col("confidence") - F.col("_second")), ignorenulls=True).over(whole)
    mode = F.when((F.lit(gap) > 0) & (F.round(lead, DIGITS) >= gap), "converged").otherwise("fanout")
    modes = second.withColumn("mode", mode)
    return modes.where(F.col("place") <= F.when(F.col("mode") == "converged", 1).otherwise(max(1, fanout))).select("query_id", "scope", "path", "confidence", "place", "mode")


def in_route(path: Column, route: Column) -> Column:
    """Whether a path begins with the route, without regard to case; an empty route holds all."""
    low = lambda p: F.transform(p, lambda x: F.lower(x))
    return (F.size(path) >= F.size(route)) & (low(F.slice(path, 1, F.size(route))) == low(route))


def routed(queries: DataFrame, corpus: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries and corpus with a scope per route: a query comes once per route, a chunk once per route that holds it."""
    key = F.concat(F.col("scope"), F.lit("\x1f"), F.array_join(F.transform("path", lambda x: F.lower(x)), "\x1f"))
    own = routes.select("query_id", key.alias("_key"), "confidence")
    asked = queries.join(own, "query_id").drop("scope").withColumnRenamed("_key", "scope")
    kinds = routes.select("scope", key.alias("_key"), F.transform("path", lambda x: F.lower(x)).alias("_route")).distinct()
    held = corpus.join(kinds, "scope").where(in_route(_path(), F.col("_route"))).drop("scope", "_route").withColumnRenamed("_key", "scope")
    return asked, held


def best_of_variants(scored: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (query_id, chunk_id, score, order) of a query's variants: the highest score of each chunk counts, then the earliest variant."""
    merged = scored.groupBy("query_id", "chunk_id").agg(F.max(F.struct("score", -F.col("order"))).alias("_b"))
    flat = merged.select("query_id", "chunk_id", F.col("_b.score").alias("score"))
    return cut_top(flat.join(queries.select("query_id", "top_k"), "query_id"))


def sub_questions(queries: DataFrame) -> DataFrame:
    """(query_id, order, query_text): parts joined by "and"; the whole where there is only one part of three characters or more."""
    text = F.col("query_text")
    parts = F.transform(F.split(text, r"(?i)\s+and\s+"), lambda p: F.trim(p))
    parts = F.array_distinct(F.filter(parts, lambda p: F.length(p) >= 3))
    chosen = F.when(F.size(parts) > 1, parts).otherwise(F.array(text))
    return queries.select("query_id", "scope", "top_k", F.posexplode(chosen).alias("order", "query_text"))


def multi_hop(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Lexical search of every sub-question; a chunk keeps its best score."""
    parts = sub_questions(queries).withColumn("_id", F.struct("query_id", "order"))
    asked = parts.select(F.to_json("_id").alias("query_id"), F.col("query_id").alias("_whole"), "order", "scope", "query_text", "top_k")
    found = lexical_top(asked.select("query_id", "scope", "query_text", "top_k"), corpus)
    scored = found.join(asked.select("query_id", "_whole", "order"), "query_id").select(F.col("_whole").alias("query_id"), "chunk_id", "score", "order")
    return best_of_variants(scored, queries)


def route_fanout(queries: DataFrame, corpus: DataFrame, routes: DataFrame, base: Callable[[DataFrame, DataFrame], DataFrame] = lexical_top) -> DataFrame:
    """Search by base in every planned route; a route's confidence is added to its scores and the best counts."""
    asked, held = routed(queries, corpus, cut(routes))  # read three times: for the queries, the corpus and the confidences
    keyed = asked.withColumn("_id", F.to_json(F.struct("query_id", "scope")))
    found = base(keyed.select(F.col("_id").alias("query_id"), "scope", "query_text", "top_k"), held)
    scored = found.join(keyed.select(F.col("_id"), F.col("query_id").alias("_whole"), "confidence"), found.query_id == F.col("_id"))
    return best_of_variants(scored.select(F.col("_whole").alias("query_id"), "chunk_id", F.round(F.col("score") + F.col("confidence"), DIGITS).alias("score"), F.lit(0).alias("order")), queries)


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates of several variants or legs (query_id, path, score): scores of a path are added, confidence anew."""
    summed = candidates.groupBy("query_id", "path").agg(F.round(F.sum("score"), DIGITS).alias("score"))
    best = F.max("score").over(Window.partitionBy("query_id"))
    return summed.withColumn("confidence", F.when(best > 0, F.round(F.col("score") / best, DIGITS)).otherwise(0.0))


def union_hits(seed: DataFrame, more: DataFrame, k: int) -> DataFrame:
    """Hits (query_id, chunk_id, score) of two searches: the highest score of each chunk, the k best."""
    both = seed.select("query_id", "chunk_id", "score").unionByName(more.select("query_id", "chunk_id", "score"))
    return cut_top(both.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")).withColumn("top_k", F.lit(k)))


def linked_entities(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, entity_id): entities whose lower-case trimmed name is a word of the query or the whole query."""
    low = F.lower(F.trim(F.col("query_text")))
    words = F.array_distinct(F.concat(F.filter(F.split(low, r"(?U)\s+"), lambda w: w != ""), F.array(low)))
    asked = queries.select("query_id", F.explode(words).alias("_name"))
    named = entities.select("entity_id", F.lower(F.trim("name")).alias("_name"))
    return asked.join(named, "_name").select("query_id", "entity_id").distinct()


def graph_hits(reached: DataFrame, entities: DataFrame, queries: DataFrame, decay: float = 0.5) -> DataFrame:
    """Chunks that the reached entities (query_id, entity_id, depth) come from, scored decay^depth of the nearest entity."""
    sources = reached.join(entities.select("entity_id", F.explode("source_chunk_ids").alias("chunk_id")), "entity_id")
    nearest = sources.groupBy("query_id", "chunk_id").agg(F.min("depth").alias("_d"))
    scored = nearest.select("query_id", "chunk_id", F.pow(F.lit(decay), F.col("_d")).alias("score"))
    return cut_top(scored.join(queries.select("query_id", "top_k"), "query_id"))


def lexical_overlap(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, chunk_id, overlap) of the pairs of one scope that share a token."""
    tokens = query_tokens(queries)
    have = corpus.select("scope", "chunk_id", F.explode(F.array_distinct(search_tokens(F.col("content")))).alias("needle"))
    have = have.join(tokens.select("scope", "needle").distinct(), ["scope", "needle"], "left_semi")
    return tokens.join(have, ["scope", "needle"]).groupBy("query_id", "chunk_id").agg(F.sum("times").cast("int").alias("overlap"))


# ---------------------------------------------------------------- routes around whole searches


def auto_routed(queries: DataFrame, corpus: DataFrame, base: Callable[[DataFrame, DataFrame], DataFrame], least: float = ROUTE_MIN_SCORE) -> DataFrame:
    """Search by base, each query inside its best route; queries without a route search everything."""
    first = route_candidates(queries, corpus, least).where("place = 1").select("query_id", "scope", "path", F.lit(0.0).alias("confidence"))
    inside = route_fanout(queries, corpus, first, base)
    return inside.unionByName(base(queries.join(first, "query_id", "left_anti"), corpus).select(*inside.columns))


def search_by_policy(queries: DataFrame, corpus: DataFrame, base: Callable[[DataFrame, DataFrame], DataFrame], fanout: int = 1, threshold: float = ROUTE_CONFIDENCE, gap: float = 0.0, least: float = ROUTE_MIN_SCORE) -> DataFrame:
    """Search by base in the routes planned for each query, scores raised by a route's confidence; without routes everywhere.

    A fanout of one or less searches everything at once.
    """
    if fanout <= 1:
        return base(queries, corpus)
    routes = cut(plan_routes(route_candidates(queries, corpus, least, max(ROUTE_CANDIDATES, fanout)), threshold, gap, fanout))
    inside = route_fanout(queries, corpus, routes, base)
    return inside.unionByName(base(queries.join(routes.select("query_id").distinct(), "query_id", "left_anti"), corpus).select(*inside.columns))


def trajectory(queries: DataFrame, hits: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, route, confidence, mode, hit_count, hit_ids, rationale) of searches that took one route or none."""
    first = candidates.where("place = 1").select("query_id", F.col("path").alias("route"), "confidence")
    ids = hits.groupBy("query_id").agg(F.count("*").alias("hit_count"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("hit_ids"))
    none = F.array().cast("array<string>")
    rows = queries.select("query_id").join(first, "query_id", "left").join(ids, "query_id", "left")
    return rows.select("query_id", F.coalesce("route", none).alias("route"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.lit("single").alias("mode"), F.coalesce("hit_count", F.lit(0)).alias("hit_count"), F.coalesce("hit_ids", none).alias("hit_ids"), F.lit("single route execution").alias("rationale"))


def section_trail(hits: DataFrame) -> DataFrame:
    """(query_id, section_ids, trail) of hits in order: their different section ids, and their paths end to end."""
    order = F.array_sort(F.collect_list(F.struct("rank", F.coalesce("section_id", F.lit("")).alias("s"), _path().alias("p"))))
    rows = hits.groupBy("query_id").agg(order.alias("_o"))
    ids = F.array_distinct(F.filter(F.transform("_o", lambda x: x["s"]), lambda s: s != ""))
    return rows.select("query_id", ids.alias("section_ids"), F.flatten(F.transform("_o", lambda x: x["p"])).alias("trail"))


def communities_of(reached: DataFrame, communities: DataFrame) -> DataFrame:
    """(query_id, communities): the sorted ids of the communities that hold an entity the query reached."""
    members = communities.select("community_id", F.explode("entity_ids").alias("entity_id"))
    return reached.join(members, "entity_id").groupBy("query_id").agg(F.array_sort(F.collect_set("community_id")).alias("communities"))


def search(queries: DataFrame, corpus: DataFrame, base: Callable[[DataFrame, DataFrame], DataFrame], preprocess: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, effective_query, chunk_id, score, rank): search of queries that may be changed first; a blank query is an error."""
    text = F.regexp_replace(F.coalesce("query_text", F.lit("")), r"(?U)\s+", "")
    checked = queries.withColumn("query_text", F.when(text == "", F.raise_error(F.lit("the query is blank")).cast("string")).otherwise(F.col("query_text")))
    ready = cut(preprocess(checked) if preprocess else checked)
    return base(ready, corpus).join(ready.select("query_id", F.col("query_text").alias("effective_query")), "query_id").select("query_id", "effective_query", "chunk_id", "score", "rank")

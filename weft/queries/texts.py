"""Queries of text functions, the store, splitting, and what follows retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import guard, text
from weft.functions.vectors import hash_embedding
from weft.operators import evaluate, post, split, store
from weft.queries.base import CORPUS, HITS, SPACE, buckets_sql, corpus, counts_sql, cosine_sql, fields_sql, lexical_hits, query, read, tokens_sql


@query("SELECT coalesce(source, '') AS source, count(*) AS documents, sum(coalesce(len(text), 0)) AS chars FROM documents GROUP BY 1")
def stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("documents"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))


@query(f"""WITH newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, namespace DESC, vector DESC NULLS LAST) AS v FROM chunks WHERE chunk_id IS NOT NULL) WHERE v = 1)
SELECT namespace, count(*) AS chunks, CAST(coalesce(max(len(vector)), 0) AS BIGINT) AS dim FROM newest GROUP BY 1""")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stats(store.latest(read(spark, sf_dir, "chunks").select("chunk_id", "ingested_at", "namespace", "vector")))


@query("SELECT doc_id, source FROM documents WHERE metadata['lang'] = 'en' OR (metadata IS NOT NULL AND metadata['tenant'] = 'a')")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where(store.matches({"lang": "en"}) | store.matches({"tenant": "a"})).select("doc_id", "source")


@query("SELECT chunk_id, ingested_at FROM chunks WHERE metadata['chunk_index'] = '0' AND metadata['chunk_total'] = '1'")
def security_filter_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.visible(read(spark, sf_dir, "chunks"), {"chunk_total": "1"}, {"chunk_index": "0"}).select("chunk_id", "ingested_at")


@query("SELECT event_id, user_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0")
def json_props_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").cast("int") % 2 == 0).select("event_id", "user_id")


_SPLIT_AT = "2024-07-02 00:00:00"


def _versions(when: str) -> str:
    return f"""(SELECT chunk_id, namespace, doc_id, title, heading, content FROM (
    SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, namespace DESC, doc_id DESC, title DESC NULLS LAST, section_path DESC NULLS LAST, heading DESC NULLS LAST, content DESC NULLS LAST) AS v
    FROM chunks WHERE chunk_id IS NOT NULL AND {when}) WHERE v = 1)"""


@query(f"""WITH stored AS {_versions(f"(ingested_at IS NULL OR ingested_at < TIMESTAMP '{_SPLIT_AT}')")}, arriving AS {_versions(f"ingested_at >= TIMESTAMP '{_SPLIT_AT}'")}
SELECT * FROM arriving UNION ALL SELECT * FROM stored WHERE chunk_id NOT IN (SELECT chunk_id FROM arriving)""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was ingested up to some day is stored; what came later arrives, partly under ids that are stored with other values."""
    rows = read(spark, sf_dir, "chunks").select("chunk_id", "ingested_at", "namespace", "doc_id", "title", "section_path", "heading", "content")
    later = F.coalesce(F.col("ingested_at") >= F.lit(_SPLIT_AT).cast("timestamp_ntz"), F.lit(False))
    return store.upsert(store.latest(rows.where(~later)), store.latest(rows.where(later))).select("chunk_id", "namespace", "doc_id", "title", "heading", "content")


@query("SELECT doc_id, source FROM documents WHERE metadata IS NULL OR metadata['lang'] IS DISTINCT FROM 'en'")
def remove_by_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.remove_matching(read(spark, sf_dir, "documents"), {"lang": "en"})[0].select("doc_id", "source")


@query("""SELECT doc_id, source, 'old' AS origin FROM documents WHERE source IS NULL OR source NOT IN (SELECT source FROM documents WHERE lang = 'zh' AND source IS NOT NULL AND source <> '')
UNION ALL SELECT doc_id, source, 'new' FROM documents WHERE lang = 'zh'""")
def replace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    arriving = documents.where("lang = 'zh'").select("doc_id", "source", F.lit("new").alias("origin"))
    return store.replace_sources(documents.select("doc_id", "source", F.lit("old").alias("origin")), arriving, "source").select("doc_id", "source", "origin")


@query(r"""SELECT doc_id, CASE WHEN n <= 0 AND trim(t, E' \t\r\n') <> '' THEN 1 ELSE n END AS tokens FROM (SELECT doc_id, t, CAST(len(regexp_extract_all(t, '\p{Han}')) + floor(1.3 * len(regexp_extract_all(regexp_replace(t, '\p{Han}', ' ', 'g'), '[\p{L}\p{Nd}]+'))) AS BIGINT) AS n
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY term")
def tokenize_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_document = read(spark, sf_dir, "documents").select("doc_id", F.explode(text.search_tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("k"))
    return per_document.groupBy("term").agg(F.sum("k").alias("n"), F.count("*").alias("documents"))


@query(f"SELECT doc_id, len({fields_sql('lower(text)')}) AS words, len(list_distinct({fields_sql('lower(text)')})) AS different FROM documents")
def answer_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = read(spark, sf_dir, "documents").select("doc_id", text.answer_tokens(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("words"), F.size(F.array_distinct("t")).cast("long").alias("different"))


# Windows of the texts t of src, by key k: where each begins, and its piece.
_WALK = rf"""walk AS (
  SELECT k, t, 0 AS i, 0 AS pos, CAST(NULL AS VARCHAR) AS piece, t = '' AS done FROM src
  UNION ALL
  SELECT k, t, i + 1, CASE WHEN len(t) <= pos + 600 THEN pos ELSE greatest(cut + CASE WHEN blank > 0 THEN 2 ELSE 0 END - 50, pos + 1) END,
    CASE WHEN len(t) <= pos + 600 THEN substr(t, pos + 1) ELSE substr(t, pos + 1, cut - pos) END, len(t) <= pos + 600
  FROM (SELECT *, pos + CASE WHEN blank > 0 THEN blank - 1 WHEN space > 1 THEN space - 1 ELSE 500 END AS cut FROM (
    SELECT *, CASE WHEN contains(substr(t, pos + 1, 600), E'\n\n') THEN 601 - instr(reverse(substr(t, pos + 1, 600)), E'\n\n') - 1 ELSE 0 END AS blank,
      CASE WHEN contains(substr(t, pos + 1, 500), ' ') THEN 501 - instr(reverse(substr(t, pos + 1, 500)), ' ') ELSE 0 END AS space FROM walk WHERE NOT done)))"""


def _trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}|{SPACE}$', '', 'g')"


_SPLIT = f"""WITH RECURSIVE src AS (SELECT doc_id AS k, {_trimmed("text")} AS t FROM documents WHERE text IS NOT NULL), {_WALK}
SELECT k AS doc_id, CAST(row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS INTEGER) AS chunk_index, content FROM (SELECT k, i, {_trimmed("piece")} AS content FROM walk WHERE piece IS NOT NULL) WHERE content <> ''"""
_MARKDOWN = f"""WITH RECURSIVE split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, n, ls[n] AS line, {_trimmed("ls[n]")} AS bare FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS n FROM split)),
marked AS (SELECT *, CASE WHEN regexp_matches(bare, '^#+ ') THEN len(regexp_extract(bare, '^#+')) ELSE 0 END AS level FROM lines),
placed AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS s FROM marked),
heads AS (SELECT doc_id, s, level, {_trimmed("substr(bare, level + 1)")} AS title FROM placed WHERE level > 0),
paths AS (SELECT doc_id, s, level, title, [title] AS path FROM heads WHERE s = 1 UNION ALL SELECT h.doc_id, h.s, h.level, h.title, list_append(p.path[1:h.level - 1], h.title) FROM paths p JOIN heads h ON h.doc_id = p.doc_id AND h.s = p.s + 1),
bodies AS (SELECT doc_id, s, {_trimmed("string_agg(line, chr(10) ORDER BY n)")} AS t FROM placed WHERE level = 0 GROUP BY ALL),
parted AS (SELECT DISTINCT doc_id FROM bodies WHERE t <> '' AND doc_id IN (SELECT doc_id FROM heads)),
src AS (SELECT doc_id || '|' || s AS k, t FROM bodies WHERE doc_id IN (SELECT doc_id FROM parted) AND t <> '' UNION ALL SELECT doc_id || '|', {_trimmed("text")} FROM split WHERE doc_id NOT IN (SELECT doc_id FROM parted)),
{_WALK},
pieces AS (SELECT CAST(split_part(k, '|', 1) AS BIGINT) AS doc_id, coalesce(try_cast(split_part(k, '|', 2) AS BIGINT), 0) AS s, i, content FROM (SELECT k, i, {_trimmed("piece")} AS content FROM walk WHERE piece IS NOT NULL) WHERE content <> '')
SELECT c.doc_id, CAST(row_number() OVER (PARTITION BY c.doc_id ORDER BY c.s, c.i) - 1 AS INTEGER) AS chunk_index, c.content, array_to_string(coalesce(p.path, []), ' > ') AS section_path, coalesce(p.title, '') AS heading, CAST(coalesce(p.level, 0) AS INTEGER) AS heading_level
FROM pieces c LEFT JOIN paths p ON p.doc_id = c.doc_id AND p.s = c.s"""


@query(_SPLIT)
def char_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_documents(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "chunk_index", "content")


@query(_MARKDOWN)
def markdown_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split.split_documents(read(spark, sf_dir, "documents"), "doc_id", "text", markdown=True)
    return pieces.select("doc_id", "chunk_index", "content", F.array_join("section_path", " > ").alias("section_path"), "heading", "heading_level")


@query("""SELECT doc_id, k, v FROM (SELECT doc_id, unnest(map_entries(metadata)).key AS k, unnest(map_entries(metadata)).value AS v FROM documents) WHERE k NOT IN ('source_id', 'version', 'checksum', 'embedding_version')
UNION ALL SELECT doc_id, 'source_id', source FROM documents WHERE coalesce(source, '') <> '' UNION ALL SELECT doc_id, 'version', version FROM documents WHERE coalesce(version, '') <> ''
UNION ALL SELECT doc_id, 'checksum', checksum FROM documents WHERE coalesce(checksum, '') <> '' UNION ALL SELECT doc_id, 'embedding_version', embedding_version FROM documents WHERE coalesce(embedding_version, '') <> ''""")
def lineage_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = text.lineage(F.col("metadata"), source_id=F.col("source"), version=F.col("version"), checksum=F.col("checksum"), embedding_version=F.col("embedding_version"))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(marks).alias("k", "v"))


# Fixed values, stated a second time to check the library's: the redaction rules in their order.
def _redact_sql() -> tuple[str, str]:
    patterns = [("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED:SSN]"), ("credit_card", r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,4}\b", "[REDACTED:CREDIT_CARD]"), ("phone", r"\+?\b\d[\d ()-]{7,}\d\b", "[REDACTED:PHONE]"),
                ("ipv4", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[REDACTED:IPV4]"), ("email", r"(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}", "[REDACTED:EMAIL]")]
    expression, counts = "text", []
    for kind, pattern, mark in patterns:
        counts.append(f"coalesce(len(regexp_extract_all({expression}, '{pattern}')), 0) AS {kind}")
        expression = f"regexp_replace({expression}, '{pattern}', '{mark}', 'g')"
    return expression, ", ".join(counts)


_REDACTED, _COUNTS = _redact_sql()


@query(f"SELECT doc_id, {_REDACTED} AS redacted FROM documents")
def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", guard.redacted(F.col("text")).alias("redacted"))


@query(f"WITH c AS (SELECT {_COUNTS} FROM documents) SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (UNPIVOT c ON ssn, credit_card, phone, ipv4, email INTO NAME kind VALUE n) GROUP BY kind")
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = guard.redaction_counts(F.col("text"))
    totals = read(spark, sf_dir, "documents").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in counts.items()])
    return totals.unpivot([], list(counts), "kind", "n")


# Fixed values, stated a second time to check the library's: names and patterns of injection phrases.
_FLAGS = r"""list_filter([
  CASE WHEN regexp_matches(coalesce(content, ''), '(?i)ignore\s+(all\s+|the\s+)?(previous|prior|above)\s+(instructions|prompts?)') THEN 'instruction_override' END,
  CASE WHEN regexp_matches(coalesce(content, ''), '(?i)disregard\s+(everything\s+|all\s+)?(the\s+)?above') THEN 'disregard_above' END,
  CASE WHEN regexp_matches(coalesce(content, ''), '(?i)(you\s+are\s+now\b|new\s+instructions\s*:|forget\s+(everything|all\s+previous))') THEN 'role_override' END,
  CASE WHEN regexp_matches(coalesce(content, ''), '(?i)(reveal|print|show|repeat|display)\s+(your\s+|the\s+)?(system\s+)?(prompt|instructions)') THEN 'prompt_exfiltration' END], lambda x: x IS NOT NULL)"""


@query(f"SELECT chunk_id, ingested_at, array_to_string({_FLAGS}, ',') AS findings FROM chunks")
def injection_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "chunks").select("chunk_id", "ingested_at", F.array_join(guard.injection_findings(F.col("content")), ",").alias("findings"))


@query(f"SELECT chunk_id, ingested_at, '{guard.UNTRUSTED_HEAD}' || chr(10) || regexp_replace(coalesce(content, ''), '^{SPACE}|{SPACE}$', '', 'g') || chr(10) || '{guard.UNTRUSTED_TAIL}' AS content FROM chunks")
def neutralize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "chunks").select("chunk_id", "ingested_at", guard.neutralized(F.col("content")).alias("content"))


# ---------------------------------------------------------------- after retrieval

_HAVE = tokens_sql("concat_ws(' ', coalesce(title, ''), coalesce(content, ''), coalesce(heading, ''), array_to_string(section_path, ' '))")
_RERANK = f"""{HITS}, boosted AS (SELECT query_id, chunk_id, score AS score_in, rank AS rank_in, round(score + 0.05 * len(list_filter({tokens_sql("query_text")}, lambda t: list_contains({_HAVE}, t))), 6) AS score FROM hitrows),
reranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank_in) AS INTEGER) AS rank FROM boosted)"""


@query(f"WITH {_RERANK} SELECT query_id, chunk_id, score, rank FROM reranked")
def heuristic_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post.heuristic_rerank(lexical_hits(spark, sf_dir)).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {_RERANK} SELECT query_id, chunk_id, score_in, score AS score_out, rank_in, rank AS rank_out, round(score - score_in, 6) AS delta FROM reranked")
def rerank_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lexical_hits(spark, sf_dir)
    return post.rerank_deltas(hits, post.heuristic_rerank(hits))


def _sentences_sql(x: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all(coalesce({x}, ''), '[^.!?]*[.!?]|[^.!?]+$'), lambda s: regexp_replace(s, '^{SPACE}|{SPACE}$', '', 'g')), lambda s: s <> '')"


@query(f"SELECT doc_id, CAST(place AS INTEGER) AS place, sentence FROM (SELECT doc_id, unnest(range(len(s))) AS place, unnest(s) AS sentence FROM (SELECT doc_id, {_sentences_sql('text')} AS s FROM documents))")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("place", "sentence"))


@query(f"""WITH {HITS}, split AS (SELECT query_id, chunk_id, query_text, content, {_sentences_sql("content")} AS s FROM hitrows),
near AS (SELECT query_id, chunk_id, place, sentence, round({cosine_sql("qv", "sv")}, 6) AS n FROM (SELECT query_id, chunk_id, place, sentence, {counts_sql("qb")} AS qv, {counts_sql("sb")} AS sv FROM (
  SELECT *, {buckets_sql("query_text")} AS qb, {buckets_sql("sentence")} AS sb FROM (SELECT query_id, chunk_id, query_text, unnest(range(len(s))) AS place, unnest(s) AS sentence FROM split WHERE len(s) > 2)))),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY n DESC, place) AS r FROM near) WHERE r <= 2)
SELECT query_id, chunk_id, string_agg(sentence, ' ' ORDER BY place) AS content FROM kept GROUP BY ALL UNION ALL SELECT query_id, chunk_id, content FROM split WHERE len(s) <= 2""")
def extractive_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post.extractive_compress(lexical_hits(spark, sf_dir))


def _estimate_sql(x: str) -> str:
    han, words = rf"len(regexp_extract_all({x}, '\p{{Han}}'))", rf"len(regexp_extract_all(regexp_replace({x}, '\p{{Han}}', ' ', 'g'), '[\p{{L}}\p{{Nd}}]+'))"
    return rf"CASE WHEN {han} + floor(1.3 * {words}) <= 0 AND regexp_replace({x}, '{SPACE}', '', 'g') <> '' THEN 1 ELSE CAST({han} + floor(1.3 * {words}) AS BIGINT) END"


_PACK = f"""{HITS}, costs AS (SELECT query_id, chunk_id, rank, {_estimate_sql("'[' || chunk_id || '] ' || coalesce(title, '') || ' ' || coalesce(content, '')")} AS cost, {_estimate_sql("query_text")} AS question FROM hitrows),
used AS (SELECT *, question + sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM costs),
states AS (SELECT *, sum(CASE WHEN used > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS over FROM used)"""


@query(f"WITH {_PACK} SELECT query_id, chunk_id, rank, cost, CAST(used AS BIGINT) AS used, CASE WHEN over = 0 THEN 'selected' WHEN over = 1 THEN 'cut' ELSE 'dropped' END AS state FROM states")
def pack_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post.pack_plan(lexical_hits(spark, sf_dir)).select("query_id", "chunk_id", "rank", "cost", "used", "state")


_MARK = f"' {post.TRUNCATED.strip()}'"
_CUT = f"""{_PACK}, cuts AS (SELECT s.query_id, s.chunk_id, s.rank, coalesce(h.content, '') AS content, {fields_sql("h.content")} AS w, 300 - (s.used - s.cost) AS room, {_estimate_sql("'[' || s.chunk_id || '] '")} AS base FROM states s JOIN hitrows h USING (query_id, chunk_id) WHERE s.over = 1),
units AS (SELECT *, CASE WHEN len(w) > 1 THEN w ELSE string_split(content, '') END AS u FROM cuts),
tries AS (SELECT *, unnest(range(1, len(u) + 1)) AS m FROM units WHERE room > base + 2 AND room - base > {_estimate_sql(_MARK)}),
fitting AS (SELECT query_id, chunk_id, max(m) AS m FROM tries WHERE {_estimate_sql(f"CASE WHEN len(w) > 1 THEN array_to_string(u[1:m], ' ') ELSE array_to_string(u[1:m], '') END || {_MARK}")} <= room - base GROUP BY ALL)"""


@query(f"""WITH {_CUT} SELECT s.query_id, s.chunk_id, s.rank, h.content, CASE WHEN s.over = 0 THEN 'selected' ELSE 'dropped' END AS state FROM states s JOIN hitrows h USING (query_id, chunk_id) WHERE s.over <> 1
UNION ALL SELECT c.query_id, c.chunk_id, c.rank, CASE WHEN f.m IS NULL THEN h.content ELSE CASE WHEN len(c.w) > 1 THEN array_to_string(c.u[1:f.m], ' ') ELSE array_to_string(c.u[1:f.m], '') END || {_MARK} END, CASE WHEN f.m IS NULL THEN 'dropped' ELSE 'truncated' END FROM units c JOIN hitrows h USING (query_id, chunk_id) LEFT JOIN fitting f USING (query_id, chunk_id)""")
def pack_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post.pack(lexical_hits(spark, sf_dir))


@query(f"""WITH {HITS} SELECT query_id, '{post.INSTRUCTIONS}' || chr(10) || chr(10) || 'Context:' || chr(10) || string_agg('[' || chunk_id || CASE WHEN len(section_path) > 0 THEN ' | ' || array_to_string(section_path, ' > ') ELSE '' END || '] ' || coalesce(content, '') || chr(10) || chr(10), '' ORDER BY rank)
|| 'Question: ' || min(query_text) AS prompt FROM hitrows GROUP BY query_id""")
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post.render(lexical_hits(spark, sf_dir))


@query(f"""WITH {HITS} SELECT query_id, count(*) AS hits, arg_min(score, rank) AS top_score, count(DISTINCT nullif(doc_id, '')) AS unique_docs FROM hitrows GROUP BY query_id""")
def evidence_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.evidence(lexical_hits(spark, sf_dir))


@query(f"""WITH {HITS}, rounds AS (SELECT query_id, count(*) AS hits, arg_min(score, rank) AS top_score, count(DISTINCT nullif(doc_id, '')) AS unique_docs, 1 AS round FROM hitrows GROUP BY query_id)
SELECT query_id, CASE WHEN hits >= 3 AND top_score >= 2.5 AND unique_docs >= 2 THEN 'satisfied' ELSE 'continue' END AS stop_reason, CASE WHEN hits >= 3 AND top_score >= 2.5 AND unique_docs >= 2 THEN 'stop' ELSE 'continue' END AS decision FROM rounds""")
def reflection_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = evaluate.evidence(lexical_hits(spark, sf_dir)).withColumn("round", F.lit(1))
    return evaluate.reflection_rule(rounds, min_hits=3, min_score=2.5, min_docs=2, max_rounds=2).select("query_id", "stop_reason", "decision")


@query(f"""WITH {HITS} SELECT query_id, array_to_string(list_distinct_first, ',') AS documents FROM (
  SELECT query_id, list(doc_id ORDER BY r) AS list_distinct_first FROM (SELECT query_id, doc_id, min(rank) AS r FROM hitrows WHERE coalesce(doc_id, '') <> '' GROUP BY ALL) GROUP BY query_id)""")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
    return lexical_hits(spark, sf_dir).groupBy("query_id").agg(in_order.alias("d")).select("query_id", F.array_join(text.union_kept(F.col("d")), ",").alias("documents"))


@query(f"SELECT query_id, sha256('v1' || chr(0) || 'grader' || chr(0) || array_to_string({fields_sql('lower(query_text)')}, ' ') || chr(0) || 'relevance') AS key FROM queries WHERE query_text IS NOT NULL")
def grader_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "queries").where("query_text is not null")
    return rows.select("query_id", evaluate.cache_key("grader", F.col("query_text"), F.lit("relevance")).alias("key"))


@query(f"""WITH {HITS}, c AS (SELECT * FROM corpus) SELECT query_id, chunk_id, score FROM hitrows""".replace(", c AS (SELECT * FROM corpus)", ""))
def noop_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_hits(spark, sf_dir).select("query_id", "chunk_id", "score")


__all__ = ["corpus", "hash_embedding"]

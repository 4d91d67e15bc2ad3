"""Queries of evaluation: retrieval and answer metrics, comparison of runs, readers of replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.parsers import grader_score, judgement
from weft.operators import evaluate
from weft.queries.base import HITS, fields_sql, lexical_hits, query, read

# The gold of a query, for want of labels: the document of the chunk that most legs returned for it, so that no leg judges itself.
_GOLD = """legs_of AS (SELECT query_id, chunk_id, count(DISTINCT leg) AS n FROM hits WHERE query_id IS NOT NULL AND namespace IS NOT NULL AND chunk_id IS NOT NULL AND leg IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
gold AS (SELECT query_id, [arg_max(split_part(chunk_id, ':', 1), (n, chunk_id))] AS docs, [arg_max(chunk_id, (n, chunk_id))] AS chunks FROM legs_of GROUP BY query_id)"""
_PER = f"""{HITS}, {_GOLD}, per AS (SELECT g.query_id, len(list_intersect(g.docs, coalesce(t.docs, []))) / 5 AS p, len(list_intersect(g.docs, coalesce(t.docs, []))) / len(g.docs) AS r,
  coalesce(1 / (SELECT min(h.rank) FROM hitrows h WHERE h.query_id = g.query_id AND h.rank <= 5 AND list_contains(g.docs, h.doc_id)), 0) AS rr, list_has_any(g.chunks, coalesce(t.chunks, [])) AS gr
  FROM gold g LEFT JOIN (SELECT query_id, list(DISTINCT doc_id) AS docs, list(DISTINCT chunk_id) AS chunks FROM hitrows WHERE rank <= 5 GROUP BY query_id) t USING (query_id))"""


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = read(spark, sf_dir, "hits").where("query_id is not null and namespace is not null and chunk_id is not null and leg is not null and score is not null and not isnan(score)")
    counted = usable.groupBy("query_id", "chunk_id").agg(F.count_distinct("leg").alias("n"))
    best = counted.groupBy("query_id").agg(F.max(F.struct("n", "chunk_id")).alias("b"))
    return best.select("query_id", F.array(F.split_part("b.chunk_id", F.lit(":"), F.lit(1))).alias("gold_doc_ids"), F.array("b.chunk_id").alias("gold_chunk_ids"))


@query(f"WITH {_PER} SELECT count(*) AS queries, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(CAST(gr AS INTEGER)), 6) AS grounding FROM per")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.retrieval_metrics(evaluate.retrieval_scores(lexical_hits(spark, sf_dir), _gold(spark, sf_dir), 5))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as an answer; the smallest text of its language and length and its own title are the gold answers."""
    rows = read(spark, sf_dir, "documents")
    twin = rows.where("text is not null").groupBy(F.length("text").alias("_size"), "lang").agg(F.min("text").alias("_twin"))
    rows = rows.join(twin, (F.length("text") == F.col("_size")) & rows.lang.eqNullSafe(twin.lang), "left").drop(twin.lang)
    return rows.select("doc_id", F.coalesce("text", F.lit("")).alias("answer"), F.array(F.coalesce("_twin", F.lit("")), F.coalesce("title", F.lit(""))).alias("gold_answers"), F.array(F.lit("the"), F.coalesce("source", F.lit("?"))).alias("required_phrases"))


_ANSWERS = """twins AS (SELECT length(text) AS size, lang, min(text) AS twin FROM documents WHERE text IS NOT NULL GROUP BY ALL),
answers AS (SELECT d.doc_id, coalesce(d.text, '') AS answer, [coalesce(t.twin, ''), coalesce(d.title, '')] AS golds, ['the', coalesce(d.source, '?')] AS phrases FROM documents d LEFT JOIN twins t ON length(d.text) = t.size AND d.lang IS NOT DISTINCT FROM t.lang)"""
_PLAIN = "array_to_string({0}, ' ')"


@query(f"WITH {_ANSWERS} SELECT doc_id, len(list_filter(golds, lambda g: {_PLAIN.format(fields_sql('lower(g)'))} = {_PLAIN.format(fields_sql('lower(answer)'))})) > 0 AS exact_match FROM answers")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("doc_id", evaluate.exact_match(F.col("answer"), F.col("gold_answers")).alias("exact_match"))


_F1 = f"""{_ANSWERS}, tok AS (SELECT doc_id, {fields_sql("lower(answer)")} AS a, unnest(list_transform(golds, lambda g: {fields_sql("lower(g)")})) AS g FROM answers),
one AS (SELECT doc_id, coalesce(list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))), 0) AS shared, len(a) + len(g) AS both_len FROM tok),
f1 AS (SELECT doc_id, max(CASE WHEN shared > 0 THEN 2.0 * shared / both_len ELSE 0 END) AS f FROM one GROUP BY doc_id)"""


@query(f"WITH {_F1} SELECT doc_id, round(f, 6) AS f1 FROM f1")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("doc_id", F.round(evaluate.token_f1(F.col("answer"), F.col("gold_answers")), 6).alias("f1"))


@query(f"WITH {_ANSWERS} SELECT doc_id, CAST(len(list_filter(phrases, lambda p: contains(answer, p))) AS INTEGER) AS hits, 2 AS total FROM answers")
def phrase_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = evaluate.answer_scores(_answers(spark, sf_dir))
    return scored.select("doc_id", F.col("required_phrase_hits").alias("hits"), F.col("required_phrase_total").alias("total"))


def _scored(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    """Answer scores with run records made from the id, so that two runs differ."""
    n = F.col("doc_id") + shift
    rows = evaluate.answer_scores(_answers(spark, sf_dir))
    return rows.withColumns({"reflection_rounds": (n % 4).cast("int"), "adopted_round": (n % 3).cast("int"), "grader_enabled": n % 2 == 0, "active_enabled": n % 5 == 0, "active_fired": n % 10 == 0, "followups_used": (n % 6).cast("int"), "groundedness": F.when(n % 7 == 0, (n % 100) / 100), "answer_relevance": F.when(n % 7 == 0, (n % 10) / 10)})


_METRICS = ("Examples", "ExactMatch", "F1Token", "RequiredPhraseRecall", "ReflectionRoundsMean", "GraderAdoptionRate", "FollowupQueriesUsedMean", "ActiveRetrievalFireRate", "MeanGroundedness", "MeanAnswerRelevance")


def _run_sql(shift: int) -> str:
    return f"""SELECT CAST(count(*) AS DOUBLE) AS Examples, round(avg(em), 6) AS ExactMatch, round(avg(f), 6) AS F1Token, round(sum(ph) / sum(2), 6) AS RequiredPhraseRecall, round(avg(CASE WHEN n % 4 > 0 THEN n % 4 END), 6) AS ReflectionRoundsMean,
  round(avg(CASE WHEN n % 2 = 0 THEN CASE WHEN n % 3 > 0 AND n % 3 <> n % 4 THEN 1.0 ELSE 0.0 END END), 6) AS GraderAdoptionRate, round(avg(CASE WHEN n % 5 = 0 THEN n % 6 END), 6) AS FollowupQueriesUsedMean, round(avg(CASE WHEN n % 5 = 0 THEN CASE WHEN n % 10 = 0 THEN 1.0 ELSE 0.0 END END), 6) AS ActiveRetrievalFireRate,
  round(avg(CASE WHEN n % 7 = 0 THEN (n % 100) / 100 END), 6) AS MeanGroundedness, round(avg(CASE WHEN n % 7 = 0 THEN (n % 10) / 10 END), 6) AS MeanAnswerRelevance
FROM (SELECT a.doc_id + {shift} AS n, f, len(list_filter(phrases, lambda p: contains(answer, p))) AS ph, CASE WHEN len(list_filter(golds, lambda g: {_PLAIN.format(fields_sql("lower(g)"))} = {_PLAIN.format(fields_sql("lower(answer)"))})) > 0 THEN 1.0 ELSE 0.0 END AS em FROM answers a JOIN f1 USING (doc_id))"""


@query(f"WITH {_F1} {_run_sql(0)}")
def benchmark_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.benchmark_metrics(_scored(spark, sf_dir, 0)).withColumn("Examples", F.col("Examples").cast("double"))


def _long(metrics: DataFrame) -> DataFrame:
    return metrics.select(*[F.col(m).cast("double").alias(m) for m in _METRICS]).unpivot([], list(_METRICS), "metric", "value")


_HIGH, _LOW = str(evaluate.HIGHER), "('FollowupQueriesUsedMean')"


@query(f"""WITH {_F1}, m0 AS ({_run_sql(0)}), m1 AS ({_run_sql(1)}), before AS (SELECT * FROM (UNPIVOT m0 ON COLUMNS(*) INTO NAME metric VALUE v)), after AS (SELECT * FROM (UNPIVOT m1 ON COLUMNS(*) INTO NAME metric VALUE v))
SELECT metric, b.v AS prev, a.v AS curr, round(a.v - b.v, 6) AS delta, CASE WHEN a.v - b.v IS NULL OR metric NOT IN {str((*evaluate.HIGHER, *evaluate.LOWER))} THEN 'undefined' WHEN abs(a.v - b.v) < 1e-9 THEN 'unchanged'
  WHEN (metric IN {_HIGH} AND a.v > b.v) OR (metric IN {_LOW} AND a.v < b.v) THEN 'improved' ELSE 'regressed' END AS direction FROM before b JOIN after a USING (metric)""")
def benchmark_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.compare_metrics(_long(evaluate.benchmark_metrics(_scored(spark, sf_dir, 0))), _long(evaluate.benchmark_metrics(_scored(spark, sf_dir, 1))))


@query("""WITH a AS (SELECT doc_id % 3 AS bucket, count(*) AS n FROM documents WHERE doc_id % 3 > 0 GROUP BY 1), b AS (SELECT (doc_id + 1) % 3 AS bucket, count(*) AS n FROM documents WHERE (doc_id + 1) % 3 > 0 GROUP BY 1)
SELECT CAST(coalesce(a.bucket, b.bucket) AS INTEGER) AS bucket, coalesce(a.n, 0) AS prev, coalesce(b.n, 0) AS curr, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.bucket = b.bucket""")
def histogram_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = [evaluate.adopted_histogram(_scored(spark, sf_dir, s)).select(F.col("adopted_round").alias("bucket"), F.col("examples").alias("n")) for s in (0, 1)]
    return evaluate.histogram_drift(*runs)


@query("""SELECT query, 'new' AS change FROM (SELECT DISTINCT query_text AS query FROM queries WHERE top_k >= 5 EXCEPT SELECT query_text FROM queries WHERE top_k < 5) UNION ALL
SELECT query, 'dropped' FROM (SELECT DISTINCT query_text AS query FROM queries WHERE top_k < 5 EXCEPT SELECT query_text FROM queries WHERE top_k >= 5)""")
def example_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "queries").withColumn("query", F.col("query_text"))
    return evaluate.example_diff(rows.where("top_k < 5"), rows.where("top_k >= 5"))


@query("""WITH r AS (SELECT hit_id, CASE WHEN hit_id % 3 = 0 THEN 'no object' ELSE 'Sure: {"groundedness": ' || CAST((hit_id % 15) / 10 AS VARCHAR) || ', "answer_relevance": -0.5, "rationale": "r' || hit_id % 7 || '"} end' END AS reply FROM hits)
SELECT hit_id, CASE WHEN hit_id % 3 > 0 THEN least(1.0, (hit_id % 15) / 10) END AS groundedness, CASE WHEN hit_id % 3 > 0 THEN 0.0 END AS answer_relevance, CASE WHEN hit_id % 3 > 0 THEN 'r' || hit_id % 7 END AS rationale FROM r""")
def parse_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("hit_id")
    reply = F.when(n % 3 == 0, "no object").otherwise(F.concat(F.lit('Sure: {"groundedness": '), ((n % 15) / 10).cast("string"), F.lit(', "answer_relevance": -0.5, "rationale": "r'), (n % 7).cast("string"), F.lit('"} end')))
    return read(spark, sf_dir, "hits").select("hit_id", judgement(reply).alias("j")).select("hit_id", "j.groundedness", "j.answer_relevance", "j.rationale")


@query("SELECT hit_id, CASE WHEN score IS NULL OR isnan(score) OR hit_id % 4 = 0 THEN 0.5 ELSE least(1.0, greatest(0.0, score)) END AS graded FROM hits")
def grader_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.when(F.col("hit_id") % 4 == 0, "no idea").otherwise(F.concat(F.lit("Because.\n Score = "), F.col("score").cast("string"), F.lit(" \nscore=0.1")))
    return read(spark, sf_dir, "hits").select("hit_id", grader_score(reply).alias("graded"))


_GRADES = "grades AS (SELECT query_id, CAST(hit_id % 3 + 1 AS INTEGER) AS round, chunk_id, (hit_id % 11) / 10 AS relevance, (hit_id % 7) / 6 AS support FROM hits WHERE query_id IS NOT NULL)"


def _grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("hit_id")
    return read(spark, sf_dir, "hits").where("query_id is not null").select("query_id", (n % 3 + 1).cast("int").alias("round"), "chunk_id", ((n % 11) / 10).alias("relevance"), ((n % 7) / 6).alias("support"))


@query(f"""WITH {_GRADES}, means AS (SELECT query_id, round, round(0.5 * avg(relevance) + 0.5 * avg(support), 6) AS score FROM grades GROUP BY ALL)
SELECT query_id, round, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, round) AS r FROM means) WHERE r = 1""")
def best_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_round(_grades(spark, sf_dir))


@query(f"""WITH {_GRADES}, distinct_grades AS (SELECT query_id, round, chunk_id, max(relevance) AS relevance, max(support) AS support FROM grades WHERE chunk_id IS NOT NULL GROUP BY ALL)
SELECT CAST(query_id AS VARCHAR) AS query, round, chunk_id, relevance, support, round = 2 AND relevance >= 0.5 AS adopted FROM distinct_grades""")
def grader_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = _grades(spark, sf_dir).where("chunk_id is not null").groupBy("query_id", "round", "chunk_id").agg(F.max("relevance").alias("relevance"), F.max("support").alias("support"))
    rounds = graded.groupBy("query_id", "round").agg(F.collect_set(F.when(F.col("relevance") >= 0.5, F.col("chunk_id"))).alias("prompt_chunk_ids"), F.collect_list(F.struct("chunk_id", "relevance", "support")).alias("chunk_scores"))
    answers = rounds.groupBy("query_id").agg(F.collect_list(F.struct("round", "prompt_chunk_ids", "chunk_scores")).alias("rounds"))
    shaped = answers.select(F.col("query_id").cast("string").alias("query"), F.lit("").alias("answer"), F.lit(2).alias("adopted_round"), "rounds")
    return evaluate.grader_dataset(shaped).drop("answer")


@query("SELECT query_id, string_agg(leg || ': ' || chunk_id, chr(10) ORDER BY hit_id) AS history FROM (SELECT DISTINCT hit_id, query_id, leg, chunk_id FROM hits WHERE query_id IS NOT NULL AND leg IS NOT NULL AND chunk_id IS NOT NULL) GROUP BY query_id")
def history_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as "role: content" lines in their order, one text per conversation."""
    turns = read(spark, sf_dir, "hits").where("query_id is not null and leg is not null and chunk_id is not null").select("query_id", "hit_id", F.concat_ws(": ", "leg", "chunk_id").alias("line")).distinct()
    return turns.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hit_id", "line"))), lambda x: x["line"]), "\n").alias("history"))



"""Evaluation as aggregations: retrieval and answer metrics, benchmark totals, comparison of runs."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import answer_tokens

DIGITS = 6
UNCHANGED = 1e-9
# Metrics for which more is better, and less is.
HIGHER = ("ExactMatch", "F1Token", "RequiredPhraseRecall", "MeanGroundedness", "MeanAnswerRelevance")
LOWER = ("FollowupQueriesUsedMean",)


def retrieval_scores(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per query: precision, recall, reciprocal_rank and grounded of its first k hits.

    hits has query_id, chunk_id, doc_id and rank; gold query_id, gold_doc_ids and gold_chunk_ids.
    precision is the number of different gold documents found, over k even if there are fewer hits.
    recall is null without gold documents. The rank is that of the first gold document.
    """
    empty = F.array().cast("array<string>")
    top = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set(F.col("doc_id").cast("string")).alias("_docs"), F.collect_set("chunk_id").alias("_chunks"))
    wanted = gold.select("query_id", F.coalesce("gold_doc_ids", empty).alias("_gold"), F.coalesce("gold_chunk_ids", empty).alias("_goldc"))
    first = hits.where(F.col("rank") <= k).join(wanted, "query_id").where(F.array_contains("_gold", F.col("doc_id").cast("string"))).groupBy("query_id").agg(F.min("rank").alias("_first"))
    rows = wanted.join(top, "query_id", "left").join(first, "query_id", "left")
    found = F.size(F.array_intersect("_gold", F.coalesce("_docs", empty)))
    return rows.select(
        "query_id", (found / F.lit(k)).alias("precision"), F.when(F.size("_gold") > 0, found / F.size(F.array_distinct("_gold"))).alias("recall"), F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.arrays_overlap("_goldc", F.coalesce("_chunks", empty)), F.lit(False)).alias("grounded")
    )


def retrieval_metrics(scores: DataFrame) -> DataFrame:
    """One row: queries, precision, recall (over queries with gold), mrr, grounding; null over nothing."""
    mean = lambda c: F.round(F.avg(c), DIGITS)
    return scores.agg(F.count("*").alias("queries"), mean("precision").alias("precision"), mean("recall").alias("recall"), mean("reciprocal_rank").alias("mrr"), mean(F.col("grounded").cast("int")).alias("grounding"))


def _plain(text: Column) -> Column:
    return F.array_join(answer_tokens(text), " ")


def exact_match(answer: Column, golds: Column) -> Column:
    """Whether the answer equals a gold answer, case and white space aside; false without gold answers."""
    return F.coalesce(F.exists(golds, lambda g: _plain(g) == _plain(answer)), F.lit(False))


def token_f1(answer: Column, golds: Column) -> Column:
    """The best F1 of the answer's tokens against a gold answer's, repeated tokens counted; 0 where either is empty."""

    @F.pandas_udf("double")
    def best(mine: pd.Series, golds_: pd.Series) -> pd.Series:
        out = []
        for tokens, theirs in zip(mine, golds_):
            have, top = Counter(tokens if tokens is not None else ()), 0.0
            for gold in theirs if theirs is not None else ():
                want = Counter(gold if gold is not None else ())
                if shared := (have & want).total():
                    top = max(top, 2.0 * shared / (have.total() + want.total()))
            out.append(top)
        return pd.Series(out, dtype=float)

    return best(answer_tokens(answer), F.transform(golds, answer_tokens))


def phrase_hits(answer: Column, phrases: Column) -> Column:
    """How many of the phrases stand in the answer, case counted."""
    return F.coalesce(F.size(F.filter(phrases, lambda p: F.coalesce(F.coalesce(answer, F.lit("")).contains(p), F.lit(False)))), F.lit(0))


def answer_scores(rows: DataFrame) -> DataFrame:
    """rows (answer, gold_answers, required_phrases) with exact_match, f1_token, required_phrase_hits and _total."""
    total = F.greatest(F.size(F.coalesce("required_phrases", F.array().cast("array<string>"))), F.lit(0))
    return rows.withColumns({"exact_match": exact_match(F.col("answer"), F.col("gold_answers")), "f1_token": token_f1(F.col("answer"), F.col("gold_answers")), "required_phrase_hits": phrase_hits(F.col("answer"), F.col("required_phrases")), "required_phrase_total": total})


def benchmark_metrics(scored: DataFrame) -> DataFrame:
    """One row of means over examples; a metric whose feature no example used is null.

    Besides the answer scores, scored has reflection_rounds, adopted_round, grader_enabled,
    active_enabled, active_fired, followups_used, groundedness and answer_relevance (null: no judge).
    """
    share = lambda cond, among: F.round(F.avg(F.when(among, F.when(cond, 1.0).otherwise(0.0))), DIGITS)
    mean = lambda c, among=F.lit(True): F.round(F.avg(F.when(among, F.col(c).cast("double"))), DIGITS)
    reflected = F.col("reflection_rounds") > 0
    return scored.agg(
        F.count("*").alias("Examples"), share(F.col("exact_match"), F.lit(True)).alias("ExactMatch"), mean("f1_token").alias("F1Token"), F.round(F.try_divide(F.sum("required_phrase_hits"), F.sum("required_phrase_total")), DIGITS).alias("RequiredPhraseRecall"),
        mean("reflection_rounds", reflected).alias("ReflectionRoundsMean"), share((F.col("adopted_round") > 0) & (F.col("adopted_round") != F.col("reflection_rounds")), F.col("grader_enabled")).alias("GraderAdoptionRate"),
        mean("followups_used", F.col("active_enabled")).alias("FollowupQueriesUsedMean"), share(F.col("active_fired"), F.col("active_enabled")).alias("ActiveRetrievalFireRate"), mean("groundedness").alias("MeanGroundedness"), mean("answer_relevance").alias("MeanAnswerRelevance"),
    )


def adopted_histogram(scored: DataFrame) -> DataFrame:
    """(adopted_round, examples) over examples with an adopted round."""
    return scored.where("adopted_round > 0").groupBy("adopted_round").agg(F.count("*").alias("examples"))


def compare_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, prev, curr, delta, direction) of two tables (metric, value)."""
    joined = before.select("metric", F.col("value").alias("prev")).join(after.select("metric", F.col("value").alias("curr")), "metric", "full")
    known = F.coalesce(~F.isnan("prev"), F.lit(False)) & F.coalesce(~F.isnan("curr"), F.lit(False))
    delta = F.when(known, F.col("curr") - F.col("prev"))
    better = F.when(F.col("metric").isin(*HIGHER), F.col("_d") > 0).when(F.col("metric").isin(*LOWER), F.col("_d") < 0)
    direction = F.when(F.col("_d").isNull() | better.isNull(), "undefined").when(F.abs("_d") < UNCHANGED, "unchanged").when(better, "improved").otherwise("regressed")
    return joined.withColumn("_d", delta).select("metric", "prev", "curr", F.round("_d", DIGITS).alias("delta"), direction.alias("direction"))


def histogram_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(bucket, prev, curr, delta): counts (bucket, n) of two runs, missing ones 0; the L1 distance is the sum of |delta|."""
    joined = before.select("bucket", F.col("n").alias("prev")).join(after.select("bucket", F.col("n").alias("curr")), "bucket", "full").fillna(0, ["prev", "curr"])
    return joined.withColumn("delta", F.col("curr") - F.col("prev"))


def example_diff(before: DataFrame, after: DataFrame, column: str = "query") -> DataFrame:
    """(query, change): texts that only one of the runs has."""
    old, new = before.select(column).distinct(), after.select(column).distinct()
    return new.exceptAll(old).withColumn("change", F.lit("new")).unionByName(old.exceptAll(new).withColumn("change", F.lit("dropped")))


def reflection_rule(rounds: DataFrame, min_hits: int = 0, min_score: float = 0.0, min_docs: int = 0, citations: bool = False, max_rounds: int = 1) -> DataFrame:
    """rounds (round, hits, top_score, unique_docs, citations) with decision and stop_reason."""
    enough = (F.col("hits") >= min_hits) & (F.col("top_score") >= min_score) & (F.col("unique_docs") >= min_docs)
    enough = enough & (F.col("citations") > 0) if citations else enough
    last = F.col("round") >= (max_rounds if max_rounds > 0 else 1)
    reason = F.when(enough, "satisfied").when(last, "max_rounds").otherwise("continue")
    return rounds.withColumn("stop_reason", reason).withColumn("decision", F.when(reason == "continue", "continue").otherwise("stop"))


def best_round(graded: DataFrame, relevance_weight: float = 0.0, support_weight: float = 0.0) -> DataFrame:
    """(query_id, round, score): the round of the best weighted means of its chunks' grades; the earliest wins ties.

    Weights of 0 or less, both of them, mean a half each.
    """
    if relevance_weight <= 0 and support_weight <= 0:
        relevance_weight = support_weight = 0.5
    means = graded.groupBy("query_id", "round").agg(F.round(relevance_weight * F.avg("relevance") + support_weight * F.avg("support"), DIGITS).alias("score"))
    return means.groupBy("query_id").agg(F.max(F.struct("score", -F.col("round"))).alias("_b")).select("query_id", (-F.col("_b.col2")).alias("round"), F.col("_b.score").alias("score"))


def grader_dataset(answers: DataFrame) -> DataFrame:
    """One row per round and chunk score of an answer's rounds; adopted where the adopted round's prompt held the chunk.

    answers has query, answer, adopted_round and rounds: array<struct<round, prompt_chunk_ids,
    chunk_scores: array<struct<chunk_id, relevance, support>>>>.
    """
    rounds = answers.select("query", "answer", "adopted_round", F.explode("rounds").alias("r"))
    flat = rounds.select("query", "answer", F.col("r.round").alias("round"), F.explode("r.chunk_scores").alias("s"), ((F.col("r.round") == F.col("adopted_round")) & F.array_contains("r.prompt_chunk_ids", F.col("s.chunk_id"))).alias("adopted"))
    return flat.select("query", "answer", "round", "s.chunk_id", "s.relevance", "s.support", F.coalesce("adopted", F.lit(False)).alias("adopted"))


def evidence(hits: DataFrame) -> DataFrame:
    """(query_id, hits, top_score, unique_docs): the first hit's score and the number of different non-empty documents."""
    return hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.min_by("score", "rank").alias("top_score"), F.count_distinct(F.nullif(F.col("doc_id").cast("string"), F.lit(""))).alias("unique_docs"))


def cache_key(kind: str, *parts: Column) -> Column:
    """SHA-256 of a version mark, the kind and the normalised parts, each ended by a zero byte but the last."""
    whole = F.concat(F.lit(f"v1\x00{kind}\x00"), *[x for p in parts for x in (_plain(p), F.lit("\x00"))][:-1])
    return F.sha2(whole, 256)

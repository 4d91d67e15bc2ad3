"""Evaluation runs over tables of labelled questions: triad, benchmark, graph comparison, judged global and drift answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.parsers import judgement
from weft.operators import evaluate
from weft.plans.answer import Asker, Options, Retriever
from weft.plans.seams import Model, Usage, generate
from weft.session import cut

DIGITS = evaluate.DIGITS


def judged(rows: DataFrame, judge: Model, usage: Usage | None = None) -> DataFrame:
    """rows (query_text, answer, contexts) with groundedness and answer_relevance, null where the reply can't be read."""
    prompt = F.concat(F.lit("Question: "), "query_text", F.lit("\nAnswer: "), F.coalesce("answer", F.lit("")), F.lit("\nContext:\n"), F.array_join("contexts", "\n"), F.lit('\nReply: {"groundedness": 0 to 1, "answer_relevance": 0 to 1, "rationale": ""}'))
    read = generate(rows.withColumn("_prompt", prompt), "_prompt", judge, "_reply", "judge_eval", usage).withColumn("_j", judgement(F.col("_reply")))
    return cut(read.withColumns({"groundedness": F.col("_j.groundedness"), "answer_relevance": F.col("_j.answer_relevance")}).drop("_prompt", "_reply", "_j"))


def judge_means(rows: DataFrame) -> DataFrame:
    """One row: examples, groundedness, answer_relevance; null over nothing."""
    return rows.agg(F.count("*").alias("examples"), F.round(F.avg("groundedness"), DIGITS).alias("groundedness"), F.round(F.avg("answer_relevance"), DIGITS).alias("answer_relevance"))


def graph_comparison(queries: DataFrame, gold: DataFrame, off: Retriever, on: Retriever, corpus: DataFrame, k: int) -> DataFrame:
    """One row: recall and mrr of a retriever without and with the graph, and what the graph adds."""
    docs = corpus.select("chunk_id", "doc_id")
    arms = [evaluate.retrieval_metrics(evaluate.retrieval_scores(r(queries, corpus).join(docs, "chunk_id"), gold, k)) for r in (off, on)]
    rows = [a.select(*[F.col(c).alias(f"{c}_{name}") for c in ("recall", "mrr")]) for a, name in zip(arms, ("off", "on"))]
    both = rows[0].crossJoin(F.broadcast(rows[1]))  # one row each
    return both.withColumns({f"{c}_delta": F.round(F.col(f"{c}_on") - F.col(f"{c}_off"), DIGITS) for c in ("recall", "mrr")})


def triad(asker: Asker, questions: DataFrame, gold: DataFrame, judge: Model, k: int, options: Options | None = None, usage: Usage | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Retrieval metrics (one row), judge means (one row) and the answers of each question, each question asked once."""
    if k <= 0:
        raise ValueError("k must be 1 or more")
    answers = judged(asker.ask(questions.withColumn("top_k", F.lit(k)), options).withColumnRenamed("question", "query_text"), judge, usage)
    hits = answers.select("query_id", F.posexplode("chunk_ids").alias("_at", "chunk_id")).join(asker.corpus.select("chunk_id", "doc_id"), "chunk_id").withColumn("rank", F.col("_at") + 1)
    return evaluate.retrieval_metrics(evaluate.retrieval_scores(hits, gold, k)), judge_means(answers), answers


def benchmark(asker: Asker, examples: DataFrame, options: Options | None = None, judge: Model | None = None, progress: Callable[[str, int], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics, scored examples) of examples (query_id, scope, query_text, top_k, gold_answers, required_phrases).

    All examples run as one job; the first failure ends the run. progress hears of each stage and its rows.
    """
    options = options or Options()
    told = asker.ask(examples.select("query_id", "scope", "query_text", "top_k"), options)
    rows = examples.select("query_id", "query_text", "gold_answers", "required_phrases").join(told.drop("question"), "query_id")
    if progress:
        progress("answered", rows.count())
    if judge is not None:
        rows = judged(rows, judge, asker.usage)
        if progress:
            progress("judged", rows.count())
    else:
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in ("groundedness", "answer_relevance")})
    graded, active = options.grade and asker.grader is not None, options.relevance_floor > 0
    followed = F.coalesce("followups_used", F.lit(0)) if "followups_used" in rows.columns else F.lit(0)
    scored = evaluate.answer_scores(rows).withColumns({"reflection_rounds": F.col("rounds") if options.mode != "off" else F.lit(0), "adopted_round": F.col("round") if options.mode != "off" else F.lit(0), "grader_enabled": F.lit(graded), "active_enabled": F.lit(active), "active_fired": followed > 0, "followups_used": followed})
    scored = cut(scored)
    return evaluate.benchmark_metrics(scored), scored


def report_contexts(answers: DataFrame, reports: DataFrame) -> DataFrame:
    """answers (query_id, answer, communities) with contexts: "title: summary" of the reports they drew on, in order."""
    each = answers.select("query_id", F.posexplode("communities").alias("_at", "community_id")).join(reports.select("community_id", "title", "summary"), "community_id")
    text = F.struct("_at", F.concat_ws(": ", F.nullif("title", F.lit("")), "summary").alias("t"))
    held = each.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(text)), lambda x: x["t"]).alias("contexts"))
    return answers.join(held, "query_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))


def evaluate_reports(answers: DataFrame, questions: DataFrame, reports: DataFrame, judge: Model, usage: Usage | None = None) -> tuple[DataFrame, DataFrame]:
    """(judge means, judged answers) of global or drift answers, judged against the reports they drew on."""
    rows = judged(report_contexts(answers, reports).join(questions.select("query_id", "query_text"), "query_id"), judge, usage)
    return judge_means(rows), rows


def total_usage(rounds: DataFrame) -> DataFrame:
    """(query_id, prompt_tokens, completion_tokens, total_tokens, estimated, stages) over a question's rounds.

    rounds has query_id, round, the tokens, estimated and stages: array<struct<stage, seconds>>.
    Tokens are added, stages put end to end in order of rounds; estimated if any round was.
    """
    in_order = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("round", "stages"))), lambda x: x["stages"]))
    return rounds.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")], F.bool_or("estimated").alias("estimated"), in_order.alias("stages"))

"""Answer pipelines over tables of questions: one round, reflection, follow-up retrieval, conversations, corrections.

Every stage is a DataFrame transformation for all open questions at once; a loop only decides which
of them take part in the next round. Each round is written before the next begins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.parsers import decision, extraction_lines, grader_score, judgement, planned_queries, sub_queries
from weft.operators import evaluate, post, retrieve
from weft.plans.seams import Model, Usage, generate
from weft.session import cut

Retriever = Callable[[DataFrame, DataFrame], DataFrame]
#: The grade of a chunk whose grader failed, and the most follow-up queries of a question over all its rounds.
FAILED_GRADE, FOLLOW_UPS = 0.5, 4


@dataclass(frozen=True)
class Options:
    """mode: off, rule, model or hybrid. selection: the last round's answer or the best graded one.

    relevance_floor: below it follow-up queries are planned, up to per_round of them.
    """

    budget: int = 300
    rerank: bool = False
    compress: int = 0
    screen: str = ""  # "", neutralize or drop
    structure: bool = False
    mode: str = "off"
    max_rounds: int = 1
    min_hits: int = 0
    min_score: float = 0.0
    min_docs: int = 0
    allow_rewrite: bool = False
    fail_open: bool = False
    grade: bool = False
    selection: str = "last"
    relevance_weight: float = 0.0
    support_weight: float = 0.0
    adaptive_below: float = 0.0
    relevance_floor: float = 0.0
    per_round: int = 2


def hybrid(queries: DataFrame, corpus: DataFrame, structure: bool = False) -> DataFrame:
    legs = {"dense": retrieve.dense_text_top(queries, corpus), "lexical": retrieve.lexical_top(queries, corpus)}
    if structure:
        legs["structure"] = retrieve.cut_top(retrieve.structure(queries, corpus))
    return retrieve.fuse(legs, queries)


class Asker:
    """Answers questions (query_id, scope, query_text, top_k) from a corpus with a model."""

    def __init__(self, corpus: DataFrame, model: Model, grader: Model | None = None, planner: Model | None = None, judge: Model | None = None, usage: Usage | None = None) -> None:
        self.corpus, self.model, self.usage = corpus, model, usage
        self.grader, self.planner, self.judge = grader, planner, judge
        self.followed = 0  # follow-up queries that a question of this ask may have used so far

    def _hits(self, questions: DataFrame, options: Options) -> DataFrame:
        found = hybrid(questions, self.corpus, options.structure).select("query_id", "chunk_id", "score", "rank")
        if options.relevance_floor > 0 and self.grader and self.planner:
            found = self._follow_up(questions, found, options)
        return self._with_texts(found, questions)

    def _with_texts(self, found: DataFrame, questions: DataFrame) -> DataFrame:
        return found.join(questions.select("query_id", "query_text"), "query_id").join(self.corpus.drop("scope"), "chunk_id")

    def _graded(self, hits: DataFrame) -> DataFrame:
        prompt = F.concat(F.lit("Query: "), "query_text", F.lit("\nChunk: "), "chunk_id", F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\nHow relevant is the chunk, from 0 to 1? Reply: score=<number>"))
        rated = generate(hits.withColumn("_prompt", prompt), "_prompt", self.grader, "_reply", "grade", self.usage, skip_failures=True)
        return rated.withColumn("relevance", F.when(F.col("_reply").isNull(), FAILED_GRADE).otherwise(grader_score(F.col("_reply")))).drop("_prompt", "_reply")

    def _follow_up(self, questions: DataFrame, found: DataFrame, options: Options) -> DataFrame:
        """Search again where no hit reaches the floor, with planned queries; the best score of each chunk counts."""
        graded = self._graded(self._with_texts(found, questions))
        weak = graded.groupBy("query_id").agg(F.max("relevance").alias("_best")).where(F.col("_best") < options.relevance_floor)
        asked = questions.join(weak.select("query_id"), "query_id")
        prompt = F.concat(F.lit("Question: "), "query_text", F.lit(f"\nUp to {options.per_round} search queries for missing evidence, one per line."))
        planned = generate(asked.withColumn("_prompt", prompt), "_prompt", self.planner, "_reply", "plan", self.usage, skip_failures=True)
        most = max(0, min(options.per_round, FOLLOW_UPS - self.followed))
        self.followed += most

        @F.pandas_udf("array<string>")
        def lines(replies: pd.Series) -> pd.Series:
            return pd.Series([planned_queries(r or "", most) for r in replies], dtype=object)

        more = planned.select("query_id", "scope", "top_k", F.posexplode(lines("_reply")).alias("_n", "query_text")).withColumn("_whole", F.col("query_id")).withColumn("query_id", F.to_json(F.struct("query_id", "_n")))
        hits = hybrid(more.select("query_id", "scope", "query_text", "top_k"), self.corpus, options.structure).join(more.select("query_id", "_whole"), "query_id")
        both = found.select("query_id", "chunk_id", "score").unionByName(hits.select(F.col("_whole").alias("query_id"), "chunk_id", "score"))
        best = both.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
        return retrieve.cut_top(best.join(questions.select("query_id", "top_k"), "query_id"))

    def round(self, questions: DataFrame, options: Options) -> DataFrame:
        """(query_id, query_text, prompt, answer, chunk_ids, hits, top_score, unique_docs, contexts); every question has a row."""
        hits = self._hits(questions, options)
        if options.rerank:
            hits = post.heuristic_rerank(hits)
        hits = cut(hits)
        texts = hits
        if options.compress > 0:
            texts = hits.drop("content").join(post.extractive_compress(hits, options.compress), ["query_id", "chunk_id"])
        packed = post.pack(texts, options.budget).where(F.col("state").isin("selected", "truncated"))
        shown = packed.select("query_id", "chunk_id", "content").join(hits.drop("content"), ["query_id", "chunk_id"])
        if options.screen:
            shown = post.screen(shown, drop=options.screen == "drop")
        shown = cut(shown)
        by_rank = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c])
        signals = evaluate.evidence(hits).drop("unique_docs")
        used = shown.groupBy("query_id").agg(by_rank("chunk_id").alias("chunk_ids"), by_rank("content").alias("contexts"), F.count_distinct(F.nullif(F.col("doc_id").cast("string"), F.lit(""))).alias("unique_docs"))
        empty = F.concat(F.lit(post.INSTRUCTIONS + "\n\nContext:\nQuestion: "), F.col("query_text"))
        rows = questions.join(post.render(shown), "query_id", "left").join(signals, "query_id", "left").join(used, "query_id", "left").withColumn("prompt", F.coalesce("prompt", empty))
        none = F.array().cast("array<string>")
        rows = rows.fillna({"hits": 0, "top_score": 0.0, "unique_docs": 0}).withColumns({"chunk_ids": F.coalesce("chunk_ids", none), "contexts": F.coalesce("contexts", none)})
        return cut(generate(rows, "prompt", self.model, "answer", "answer", self.usage))

    def _decide(self, rows: DataFrame, options: Options, number: int) -> DataFrame:
        """rows with decision, stop_reason and next_query, by rule or by model."""
        ruled = evaluate.reflection_rule(rows.withColumn("round", F.lit(number)).withColumn("citations", F.size("chunk_ids")), options.min_hits, options.min_score, options.min_docs, False, options.max_rounds)
        ruled = ruled.withColumn("next_query", F.col("query_text")).drop("citations")
        if options.mode == "rule":
            return ruled
        same = F.coalesce(F.array_sort(F.array_distinct("chunk_ids")) == F.array_sort(F.array_distinct("_before")), F.lit(False))
        text = F.concat(F.lit("Question: "), "_original", F.lit("\nAnswer: "), F.coalesce("answer", F.lit("")), F.lit("\nHits: "), F.col("hits").cast("string"), F.lit("\nReply with lines decision=<stop|continue|rewrite_and_continue>, reason=, rewrite="))
        done = same | ((ruled.stop_reason == "satisfied") & F.lit(options.mode == "hybrid"))
        asked = generate(ruled.withColumn("_prompt", F.when(~done, text)), "_prompt", self.model, "_reply", "reflect", self.usage)
        allow, fail_open = options.allow_rewrite, options.fail_open

        @F.pandas_udf("decision string, rewrite string")
        def read(replies: pd.Series) -> pd.DataFrame:
            out = []
            for reply in replies:
                try:
                    choice, _, rewrite = decision(reply) if reply is not None else ("", "", "")
                except ValueError:
                    if not fail_open:
                        raise
                    choice, rewrite = "failed", ""
                out.append((choice, rewrite if allow and choice == "rewrite_and_continue" else ""))
            return pd.DataFrame(out, columns=["decision", "rewrite"])

        made = asked.withColumn("_d", read("_reply"))
        unchanged = (F.col("_d.rewrite") != "") & (F.trim("_d.rewrite") == F.trim("query_text"))
        reason = F.when(same, "evidence_unchanged").when(F.col("_d.decision") == "", "satisfied").when(F.col("_d.decision") == "failed", "decision_error").when(F.col("_d.decision") == "stop", "model_stop").when(unchanged, "rewrite_unchanged").when(F.lit(number >= options.max_rounds), "max_rounds").otherwise("continue")
        following = F.when(F.col("_d.rewrite") != "", F.col("_d.rewrite")).otherwise(F.col("query_text"))
        return made.withColumn("stop_reason", reason).withColumn("decision", F.when(reason == "continue", "continue").otherwise("stop")).withColumn("next_query", following).drop("_prompt", "_reply", "_d")

    def ask(self, questions: DataFrame, options: Options | None = None) -> DataFrame:
        """(query_id, question, round, rounds, answer, chunk_ids, stop_reason): each question's adopted answer."""
        options = options or Options()
        if options.mode not in ("off", "rule", "model", "hybrid"):
            raise ValueError(options.mode)
        self.followed = 0
        limit = max(1, options.max_rounds) if options.mode != "off" else 1
        options = replace(options, max_rounds=limit)
        open_rows = questions.withColumn("_original", F.col("query_text")).withColumn("_before", F.lit(None).cast("array<string>"))
        rounds: DataFrame | None = None
        for number in range(1, limit + 1):
            rows = self.round(open_rows, options)
            rows = rows.withColumns({"stop_reason": F.lit("single"), "decision": F.lit("stop"), "next_query": F.col("query_text")}) if options.mode == "off" else self._decide(rows, options, number)
            rows = rows.withColumn("round", F.lit(number))
            graded = options.grade and self.grader is not None
            if graded:
                rows = self._grade_round(rows)
                if options.adaptive_below > 0 and number == 1 and limit > 1:
                    again = (F.col("decision") == "stop") & (F.col("relevance") < options.adaptive_below)
                    rows = rows.withColumn("next_query", F.when(again, F.col("_original")).otherwise(F.col("next_query"))).withColumn("decision", F.when(again, "continue").otherwise(F.col("decision")))
            rows = cut(rows)
            rounds = rows if rounds is None else rounds.unionByName(rows)
            open_rows = rows.where("decision = 'continue'").select("query_id", "scope", "top_k", F.col("next_query").alias("query_text"), "_original", F.col("chunk_ids").alias("_before"))
            if open_rows.isEmpty():
                break
        return self._adopt(rounds, options)

    def _grade_round(self, rows: DataFrame) -> DataFrame:
        """rows with the mean and greatest relevance and the mean support of the chunks they used."""
        pairs = rows.select("query_id", "query_text", "answer", F.explode(F.arrays_zip("chunk_ids", "contexts")).alias("c")).select("query_id", "query_text", "answer", F.col("c.chunk_ids").alias("chunk_id"), F.col("c.contexts").alias("content"))
        rated = self._graded(pairs)
        prompt = F.concat(F.lit("Answer: "), F.coalesce("answer", F.lit("")), F.lit("\nChunk: "), "chunk_id", F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\nHow well does the chunk support the answer, from 0 to 1? Reply: score=<number>"))
        rated = generate(rated.withColumn("_prompt", prompt), "_prompt", self.grader, "_reply", "grade", self.usage, skip_failures=True).withColumn("support", F.when(F.col("_reply").isNull(), FAILED_GRADE).otherwise(grader_score(F.col("_reply"))))
        means = rated.groupBy("query_id").agg(F.max("relevance").alias("relevance"), F.avg("relevance").alias("mean_relevance"), F.avg("support").alias("mean_support"))
        return rows.join(means, "query_id", "left").fillna(0.0, ["relevance", "mean_relevance", "mean_support"])

    def _adopt(self, rounds: DataFrame, options: Options) -> DataFrame:
        order = F.desc("round")
        if options.selection == "best" and "mean_support" in rounds.columns:
            rw, sw = (0.5, 0.5) if options.relevance_weight <= 0 and options.support_weight <= 0 else (options.relevance_weight, options.support_weight)
            order = F.desc(F.round(rw * F.col("mean_relevance") + sw * F.col("mean_support"), 6))
        whole = Window.partitionBy("query_id")
        rows = rounds.withColumn("rounds", F.count("*").over(whole)).withColumn("_r", F.row_number().over(whole.orderBy(order, F.asc("round"))))
        return rows.where("_r = 1").select("query_id", F.col("_original").alias("question"), "round", "rounds", "answer", "chunk_ids", "contexts", "stop_reason")

    def ask_conversation(self, turns: DataFrame, questions: DataFrame, options: Options | None = None) -> DataFrame:
        """ask, with each question first rewritten to stand alone, given its conversation (query_id, turn, role, content).

        A question without history, or with an empty reply, stays as it is.
        """
        line = F.concat_ws(": ", "role", "content")
        history = turns.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("_history"))
        rows = questions.join(history, "query_id", "left")
        prompt = F.when(F.col("_history").isNotNull(), F.concat(F.lit("Conversation:\n"), "_history", F.lit("\nRewrite the latest question so that it stands alone.\nLatest question: "), "query_text"))
        told = generate(rows.withColumn("_prompt", prompt), "_prompt", self.model, "_reply", "condense", self.usage)
        alone = F.coalesce(F.nullif(F.trim("_reply"), F.lit("")), F.col("query_text"))
        return self.ask(told.select("query_id", "scope", alone.alias("query_text"), "top_k"), options)

    def ask_corrected(self, questions: DataFrame, options: Options | None = None, least: float = 0.5, retries: int = 2) -> DataFrame:
        """ask, judged; questions whose answer is less grounded are asked anew in other words, up to retries times. The best grounded answer stays."""
        if self.judge is None:
            raise ValueError("a judge is needed")
        attempts: DataFrame | None = None
        open_rows = questions.withColumn("_first", F.col("query_text"))
        for number in range((retries if retries > 0 else 2) + 1):
            answers = self.ask(open_rows.drop("_first"), options).join(open_rows.select("query_id", "_first", "scope", "top_k"), "query_id")
            prompt = F.concat(F.lit("Question: "), "_first", F.lit("\nAnswer: "), F.coalesce("answer", F.lit("")), F.lit("\nContext:\n"), F.array_join("contexts", "\n"), F.lit('\nReply: {"groundedness": 0 to 1, "answer_relevance": 0 to 1, "rationale": ""}'))
            judged = generate(answers.withColumn("_prompt", prompt), "_prompt", self.judge, "_reply", "judge_eval", self.usage)
            rows = cut(judged.withColumn("groundedness", judgement(F.col("_reply"))["groundedness"]).drop("_prompt", "_reply").withColumn("attempt", F.lit(number)))
            attempts = rows if attempts is None else attempts.unionByName(rows)
            weak = rows.where(F.coalesce("groundedness", F.lit(0.0)) < (least if least > 0 else 0.5))
            if number == retries or weak.isEmpty():
                break
            prompt = F.concat(F.lit("Question: "), "_first", F.lit("\nPrevious answer: "), F.coalesce("answer", F.lit("")), F.lit("\nA better search query:"))
            told = generate(weak.withColumn("_prompt", prompt), "_prompt", self.model, "_reply", "reformulate", self.usage)
            open_rows = cut(told.select("query_id", "scope", "top_k", F.coalesce(F.nullif(F.trim("_reply"), F.lit("")), F.col("_first")).alias("query_text"), "_first"))
        best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("groundedness"), F.asc("attempt"))
        whole = Window.partitionBy("query_id")
        return attempts.withColumn("attempts", F.count("*").over(whole)).withColumn("_r", F.row_number().over(best)).where("_r = 1").select("query_id", F.col("_first").alias("question"), "answer", "chunk_ids", "groundedness", "attempts")


def expand(queries: DataFrame, model: Model | None, variants: int = 0, hypothetical: bool = False, step_back: bool = False, usage: Usage | None = None) -> DataFrame:
    """(query_id, order, scope, query_text, top_k): the query and its variants, each once without regard to case."""
    kinds = [(variants > 0, f"Rewrite the query in {variants or 3} other ways, one per line.\nQuery: "), (hypothetical, "Write a short answer that a document might give.\nQuestion: "), (step_back, "Ask a more general question.\nQuestion: ")]
    rows = queries.withColumn("_all", F.array("query_text"))
    for i, (on, text) in enumerate(kinds):
        if not on:
            continue
        if model is None:
            raise ValueError("a model is needed")
        told = generate(rows.withColumn("_prompt", F.concat(F.lit(text), F.col("query_text"))), "_prompt", model, "_reply", "expand", usage)
        whole = F.regexp_replace(F.coalesce("_reply", F.lit("")), r"(?U)^\s+|\s+$", "")
        lines = F.slice(F.filter(F.transform(F.split(whole, "\n"), lambda x: F.regexp_replace(F.trim(x), r"^[0-9.\-* \t]+", "")), lambda x: x != ""), 1, variants or 3) if i == 0 else F.array(whole)
        rows = told.withColumn("_all", F.concat("_all", lines)).drop("_prompt", "_reply")
    spread = rows.select("query_id", "scope", "top_k", F.posexplode("_all").alias("order", "query_text")).where(F.trim("query_text") != "")
    first = Window.partitionBy("query_id", F.lower(F.trim("query_text"))).orderBy("order")
    return spread.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def retrieve_variants(queries: DataFrame, corpus: DataFrame, variants: DataFrame) -> DataFrame:
    """Hybrid search of every variant; a chunk keeps its best score, the earlier variant winning ties."""
    keyed = variants.withColumn("_whole", F.col("query_id")).withColumn("query_id", F.to_json(F.struct("query_id", "order")))
    found = hybrid(keyed.select("query_id", "scope", "query_text", "top_k"), corpus).join(keyed.select("query_id", "_whole", "order"), "query_id")
    return retrieve.best_of_variants(found.select(F.col("_whole").alias("query_id"), "chunk_id", "score", "order"), queries)


def abstractive_compress(hits: DataFrame, model: Model, usage: Usage | None = None) -> DataFrame:
    """(query_id, chunk_id, content): each chunk summarised towards its query; an empty reply keeps the text."""
    prompt = F.concat(F.lit("Summarize the passage, keeping only what helps with the query. Reply with the summary only.\n\nQuery: "), "query_text", F.lit("\n\nPassage:\n"), F.coalesce("content", F.lit("")))
    told = generate(hits.withColumn("_prompt", prompt), "_prompt", model, "_reply", "compress", usage)
    return told.select("query_id", "chunk_id", F.coalesce(F.nullif(F.regexp_replace("_reply", r"(?U)^\s+|\s+$", ""), F.lit("")), F.col("content")).alias("content"))


def decompose(queries: DataFrame, model: Model, most: int = 5, usage: Usage | None = None) -> DataFrame:
    """(query_id, order, scope, query_text, top_k): up to most sub-questions that a model finds; the question itself if it finds none."""
    prompt = F.concat(F.lit("Break the question into simpler ones, one per line.\nQuestion: "), "query_text")
    told = generate(queries.withColumn("_prompt", prompt), "_prompt", model, "_reply", "decompose", usage)

    @F.pandas_udf("array<string>")
    def lines(replies: pd.Series) -> pd.Series:
        return pd.Series([sub_queries(r or "", most) for r in replies], dtype=object)

    parts = told.withColumn("_l", lines("_reply"))
    chosen = F.when(F.size("_l") > 0, F.col("_l")).otherwise(F.array("query_text"))
    return parts.select("query_id", "scope", "top_k", F.posexplode(chosen).alias("order", "query_text"))


def extract_graph(chunks: DataFrame, model: Model, usage: Usage | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and relations that a model names in chunks (chunk_id, content), with the chunk as their source.

    Lines that aren't ENTITY | name | type | description or RELATION | source | target | relation |
    description are passed over.
    """
    prompt = F.concat(F.lit("List the entities and relations of the text, one per line:\nENTITY | name | type | description\nRELATION | source | target | relation | description\nText:\n"), F.coalesce("content", F.lit("")))
    told = generate(chunks.select("chunk_id", prompt.alias("_prompt")), "_prompt", model, "_reply", "extract", usage)
    lines = cut(told.select("chunk_id", F.posexplode(extraction_lines(F.col("_reply"))).alias("_n", "l")).withColumn("_k", F.upper(F.get("l", 0))))
    part = lambda i: F.coalesce(F.get("l", i), F.lit(""))
    row = F.xxhash64("chunk_id", "_n")
    found = lines.where((F.col("_k") == "ENTITY") & (part(1) != "")).select(row.alias("entity_id"), part(1).alias("name"), part(2).alias("type"), part(3).alias("description"), F.array("chunk_id").alias("source_chunk_ids"))
    links = lines.where((F.col("_k") == "RELATION") & (part(1) != "") & (part(2) != "")).select(row.alias("relation_id"), part(1).alias("source"), part(2).alias("target"), part(3).alias("relation"), part(4).alias("description"), F.lit(1.0).alias("weight"), F.array("chunk_id").alias("source_chunk_ids"))
    return found, links

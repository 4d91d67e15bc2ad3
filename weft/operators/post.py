"""What follows retrieval: reranking, compression, packing, screening and the prompt."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.guard import injection_findings, neutralized
from weft.functions.text import TRUNCATED, estimated_tokens, search_tokens, sentences
from weft.functions.vectors import cosine, hash_embedding
from weft.session import cut

DIGITS = 6
# The default texts of the answer prompt.
SYSTEM = "You answer questions using retrieved context."
INSTRUCTIONS = "Use the context below to answer the question. Cite chunk IDs in [brackets] when relevant."


def ranked(hits: DataFrame) -> DataFrame:
    """hits with a rank by score, equal scores by their former rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("rank"))
    return hits.withColumn("_new", F.row_number().over(order)).drop("rank").withColumnRenamed("_new", "rank")


def heuristic_rerank(hits: DataFrame, boost: float = 0.05) -> DataFrame:
    """hits (with the query's and the chunk's texts) plus boost per query token found in title, content, heading and path."""
    words = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")), F.coalesce("heading", F.lit("")), F.array_join(F.coalesce("section_path", F.array().cast("array<string>")), " "))
    marked = hits.withColumn("_have", search_tokens(words))
    found = F.size(F.filter(search_tokens(F.col("query_text")), lambda t: F.array_contains("_have", t)))
    return ranked(marked.withColumn("score", F.round(F.col("score") + boost * found, DIGITS)).drop("_have"))


def model_rerank(hits: DataFrame, model: Callable[[list[tuple[str, str]]], list[float]], top: int = 0) -> DataFrame:
    """hits scored anew by a model of (query, passage) pairs; a reply of another length is an error. top > 0 keeps the best.

    The model sees batches of rows, once each; its scores are written before anything reads them.
    """
    schema = "query_id " + hits.schema["query_id"].dataType.simpleString() + ", chunk_id string, _model double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = model(list(zip(frame["query_text"], frame["content"])))
            if len(scores) != len(frame):
                raise ValueError(f"the model returned {len(scores)} scores for {len(frame)} passages")
            yield pd.DataFrame({"query_id": frame["query_id"], "chunk_id": frame["chunk_id"], "_model": scores})

    scored = cut(hits.select("query_id", "chunk_id", "query_text", "content").mapInPandas(run, schema))
    again = ranked(hits.join(scored, ["query_id", "chunk_id"]).drop("score").withColumnRenamed("_model", "score"))
    return again.where(F.col("rank") <= top) if top > 0 else again


def rerank_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, chunk_id, scores and ranks before and after, delta); nothing before gives 0."""
    old = before.select("query_id", "chunk_id", F.col("score").alias("score_in"), F.col("rank").alias("rank_in"))
    new = after.select("query_id", "chunk_id", F.col("score").alias("score_out"), F.col("rank").alias("rank_out"))
    joined = new.join(old, ["query_id", "chunk_id"], "left").fillna({"rank_in": 0})
    delta = F.when(F.col("score_in").isNull(), 0.0).otherwise(F.round(F.col("score_out") - F.col("score_in"), DIGITS))
    return joined.select("query_id", "chunk_id", F.coalesce("score_in", F.lit(0.0)).alias("score_in"), "score_out", "rank_in", "rank_out", delta.alias("delta"))


def extractive_compress(hits: DataFrame, keep: int = 2) -> DataFrame:
    """(query_id, chunk_id, content): the sentences nearest to the query, in their order, joined by spaces.

    Nearness is the cosine of hash embeddings, rounded; earlier sentences win ties. Texts of at most
    keep sentences stay as they are.
    """
    keep = keep if keep > 0 else 2
    split = hits.select("query_id", "chunk_id", "query_text", "content", sentences(F.col("content")).alias("_s"))
    long = split.where(F.size("_s") > keep).select("query_id", "chunk_id", hash_embedding(F.col("query_text")).alias("_q"), F.posexplode("_s").alias("_at", "_sentence"))
    near = long.withColumn("_near", F.round(cosine(F.col("_q"), hash_embedding(F.col("_sentence"))), DIGITS))
    order = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("_near"), F.asc("_at"))
    best = near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= keep)
    joined = best.groupBy("query_id", "chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_sentence"))), lambda x: x["_sentence"]), " ").alias("content"))
    return split.where(F.size("_s") <= keep).select("query_id", "chunk_id", "content").unionByName(joined)


def _rendered() -> Column:
    return F.concat(F.lit("["), F.col("chunk_id"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))


def pack_plan(hits: DataFrame, budget: int = 300) -> DataFrame:
    """(query_id, chunk_id, rank, cost, used, state) in rank order: selected while all before fit, then one candidate to cut, then dropped.

    The question's tokens are spent first.
    """
    budget = budget if budget > 0 else 300
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    costs = hits.withColumn("cost", estimated_tokens(_rendered())).withColumn("_question", estimated_tokens(F.col("query_text")))
    used = costs.withColumn("used", F.col("_question") + F.sum("cost").over(before))
    over = F.sum(F.when(F.col("used") > budget, 1).otherwise(0)).over(before)
    state = F.when(over == 0, "selected").when(over == 1, "cut").otherwise("dropped")
    return used.withColumn("state", state).drop("_question")


_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿々〇〡-〩〸-〻⺀-⿕\U00020000-\U0003134f]")


def count_tokens(text: str) -> int:
    """The token estimate of one string, as estimated_tokens."""
    han = len(_HAN.findall(text))
    words = len(re.findall(r"[^\W_]+", _HAN.sub(" ", text)))
    total = han + int(words * 1.3)
    return 1 if total <= 0 and text.strip() else total


def cut_text(text: str, budget: int, count: Callable[[str], int] = count_tokens) -> str | None:
    """As many words, or characters of a single word, as fit together with the mark; None if nothing fits."""
    if budget <= count(TRUNCATED):
        return None
    words = text.split()
    units, glue = (words, " ") if len(words) > 1 else (list(text), "")
    low, high = 0, len(units)  # the count never falls as text is added, so the longest fit can be bisected
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if count(glue.join(units[:middle]) + TRUNCATED) <= budget else (low, middle - 1)
    return glue.join(units[:low]) + TRUNCATED if low else None


def pack(hits: DataFrame, budget: int = 300) -> DataFrame:
    """(query_id, chunk_id, rank, content, state): what goes into the prompt, the one cut text included; the rest is dropped."""
    plan = pack_plan(hits, budget)
    budget = budget if budget > 0 else 300

    @F.pandas_udf("string")
    def shorten(ids: pd.Series, texts: pd.Series, room: pd.Series) -> pd.Series:
        out = []
        for key, text, left in zip(ids, texts, room):
            base = count_tokens(f"[{key}] ")
            out.append(cut_text(text or "", int(left) - base) if left > base + 2 else None)
        return pd.Series(out, dtype=object)

    room = F.lit(budget) - (F.col("used") - F.col("cost"))
    short = plan.where("state = 'cut'").withColumn("_short", shorten("chunk_id", "content", room))
    truncated = short.select("query_id", "chunk_id", "rank", F.coalesce("_short", "content").alias("content"), F.when(F.col("_short").isNull(), "dropped").otherwise("truncated").alias("state"))
    return plan.where("state <> 'cut'").select("query_id", "chunk_id", "rank", "content", "state").unionByName(truncated)


def screen(hits: DataFrame, drop: bool = False) -> DataFrame:
    """hits with findings; texts with any are put between lines that mark them as data, or their rows dropped."""
    marked = hits.withColumn("findings", injection_findings(F.col("content")))
    if drop:
        return marked.where(F.size("findings") == 0)
    return marked.withColumn("content", F.when(F.size("findings") > 0, neutralized(F.col("content"))).otherwise(F.col("content")))


def render(hits: DataFrame, instructions: str = INSTRUCTIONS) -> DataFrame:
    """(query_id, prompt): instructions, the chunks in rank order with ids and paths, and the question."""
    path = F.coalesce("section_path", F.array().cast("array<string>"))
    head = F.when(F.size(path) > 0, F.concat(F.col("chunk_id"), F.lit(" | "), F.array_join(path, " > "))).otherwise(F.col("chunk_id"))
    line = F.concat(F.lit("["), head, F.lit("] "), F.coalesce("content", F.lit("")), F.lit("\n\n"))
    lines = hits.select("query_id", "query_text", F.struct("rank", line.alias("line")).alias("_l"))
    context = F.array_join(F.transform(F.array_sort(F.collect_list("_l")), lambda x: x["line"]), "")
    return lines.groupBy("query_id").agg(F.concat(F.lit(instructions + "\n\nContext:\n"), context, F.lit("Question: "), F.min("query_text")).alias("prompt"))


def usage(rows: DataFrame, prompt: str = "prompt", answer: str = "answer") -> DataFrame:
    """rows with prompt_tokens, completion_tokens, total_tokens and estimated: reported counts if any is positive, else the estimate."""
    reported = (F.coalesce("reported_prompt", F.lit(0)) > 0) | (F.coalesce("reported_completion", F.lit(0)) > 0)
    first = F.when(reported, F.coalesce("reported_prompt", F.lit(0))).otherwise(estimated_tokens(F.col(prompt)))
    second = F.when(reported, F.coalesce("reported_completion", F.lit(0))).otherwise(estimated_tokens(F.col(answer)))
    return rows.withColumn("prompt_tokens", first.cast("long")).withColumn("completion_tokens", second.cast("long")).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")).withColumn("estimated", ~reported)

"""Answers from a graph's communities: map and reduce over reports, and exploration from a primer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weft.functions.parsers import community_report, follow_up_names, map_score
from weft.operators import community, graph, post
from weft.plans.seams import Model, Usage, generate
from weft.session import cut

NO_ANSWER = "I could not find relevant information in the knowledge graph to answer this question."
ROUNDS, MOST_ROUNDS, CHUNKS = 2, 3, 8


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


@F.pandas_udf(_struct(title=T.StringType(), summary=T.StringType()))
def _report(replies: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([community_report(r or "") for r in replies], columns=["title", "summary"])


@F.pandas_udf(_struct(score=T.IntegerType(), text=T.StringType()))
def _mapped(replies: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([map_score(r or "") for r in replies], columns=["score", "text"])


@F.pandas_udf(_struct(text=T.StringType(), names=T.ArrayType(T.StringType())))
def _local(replies: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([follow_up_names(r or "") for r in replies], columns=["text", "names"])


def write_reports(table: DataFrame, nodes: DataFrame, edges: DataFrame, reports: DataFrame, model: Model, usage: Usage | None = None) -> DataFrame:
    """reports (namespace, community_id, content_hash, title, summary) with those missing or out of date written anew."""
    old = community.stale(table, reports)
    who = old.select("namespace", "community_id", F.explode("entity_ids").alias("entity_id")).join(nodes, "entity_id")
    kind, about = F.when(F.col("type") != "", F.concat(F.lit(" ("), "type", F.lit(")"))).otherwise(""), F.when(F.col("description") != "", F.concat(F.lit(": "), "description")).otherwise("")
    members = who.groupBy("namespace", "community_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "name", kind, about))), "\n").alias("_members"))
    links = old.select("namespace", "community_id", F.explode("relation_ids").alias("relation_id")).join(edges.select("relation_id", "source", "relation", "target"), "relation_id")
    links = links.groupBy("namespace", "community_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), F.concat_ws(" ", "source", "relation", "target")))), "\n").alias("_links"))
    rows = old.join(members, ["namespace", "community_id"], "left").join(links, ["namespace", "community_id"], "left")
    prompt = F.concat(F.lit("Describe this community; first line: Title: <title>.\nEntities:\n"), F.coalesce("_members", F.lit("")), F.lit("\nRelations:\n"), F.coalesce("_links", F.lit("")))
    told = generate(rows.withColumn("_prompt", prompt), "_prompt", model, "_reply", "report", usage).withColumn("_r", _report("_reply"))
    fresh = told.select("namespace", "community_id", "content_hash", "_r.title", "_r.summary")
    return cut(reports.join(fresh.select("namespace", "community_id"), ["namespace", "community_id"], "left_anti").select(*fresh.columns).unionByName(fresh))


def _primer(questions: DataFrame, table: DataFrame, nodes: DataFrame, reports: DataFrame, model: Model, most: int, usage: Usage | None) -> DataFrame:
    """(query_id, community_id, score, text): the partial answer of each chosen community's report."""
    chosen = community.select_for(questions.withColumnRenamed("scope", "namespace"), table, nodes, most)
    told = chosen.join(questions.select("query_id", F.col("scope").alias("namespace"), "query_text"), "query_id").join(reports, ["namespace", "community_id"])
    prompt = F.concat(F.lit("Community report\nTitle: "), "title", F.lit("\n"), "summary", F.lit("\n\nFirst line: Score: <0 to 100>, then the partial answer.\nQuestion: "), "query_text")
    replies = generate(told.withColumn("_prompt", prompt), "_prompt", model, "_reply", "map", usage).withColumn("_m", _mapped("_reply"))
    return cut(replies.select("query_id", "community_id", "_m.score", "_m.text"))


def ask_global(questions: DataFrame, table: DataFrame, nodes: DataFrame, reports: DataFrame, model: Model, most: int = 8, usage: Usage | None = None) -> DataFrame:
    """(query_id, answer, communities): partial answers of the communities by score, reduced to one; a fixed text where none helps."""
    parts = _primer(questions, table, nodes, reports, model, most, usage).where("score > 0")
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "community_id", "text")))
    grouped = parts.groupBy("query_id").agg(in_order.alias("_p"))
    rows = questions.join(grouped, "query_id", "left")
    lines = F.array_join(F.transform("_p", lambda x, i: F.concat(F.lit("- ["), (i + 1).cast("string"), F.lit("] "), x["text"])), "\n")
    prompt = F.when(F.col("_p").isNotNull(), F.concat(F.lit("Question: "), "query_text", F.lit("\n\nPartial answers (most helpful first):\n"), lines))
    told = generate(rows.withColumn("_prompt", prompt), "_prompt", model, "_reply", "reduce", usage)
    used = F.coalesce(F.transform("_p", lambda x: x["community_id"]), F.array().cast("array<string>"))
    return cut(told.select("query_id", F.coalesce("_reply", F.lit(NO_ANSWER)).alias("answer"), used.alias("communities")))


def ask_drift(questions: DataFrame, table: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, reports: DataFrame, model: Model, rounds: int = ROUNDS, budget: int = 300, usage: Usage | None = None) -> DataFrame:
    """(query_id, answer): a primer over communities, rounds of local reading around their members, and a synthesis.

    Seeds are the members of communities that score above 0, else of all chosen ones; a round reads
    the first chunks by id of the seeds' neighbourhood, and the names it wants to follow seed the next.
    """
    primer = _primer(questions, table, nodes, reports, model, CHUNKS, usage)
    some = primer.where("score > 0").select("query_id").distinct()
    good = primer.where("score > 0").unionByName(primer.join(some, "query_id", "left_anti"))
    member = table.select("community_id", F.explode("entity_ids").alias("entity_id")).distinct()
    seeds = cut(good.join(member, "community_id").select("query_id", "entity_id").distinct())
    notes = good.select("query_id", F.lit(0).alias("round"), F.when(F.col("score") > 0, F.col("text")).alias("text")).where("text is not null and trim(text) <> ''")
    for number in range(1, min(MOST_ROUNDS, max(1, rounds)) + 1):
        if seeds.isEmpty():
            break
        reached = graph.neighbourhood(seeds, edges, nodes, 1)
        ids = reached.join(nodes.select("entity_id", F.explode("source_chunk_ids").alias("chunk_id")), "entity_id").select("query_id", "chunk_id").distinct()

        first = ids.join(chunks.select("chunk_id", "title", "content"), "chunk_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))).where(F.col("rank") <= CHUNKS)
        packed = post.pack(first.join(questions.select("query_id", "query_text"), "query_id"), budget).where("state in ('selected', 'truncated')")
        text = packed.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: F.concat(F.lit("- "), F.trim(x["content"]))), "\n").alias("_context"))
        rows = questions.join(seeds.select("query_id").distinct(), "query_id").join(text, "query_id", "left")
        prompt = F.concat(F.lit("Question: "), "query_text", F.lit("\n\nContext:\n"), F.coalesce("_context", F.lit("(no passages)")), F.lit("\nAnswer in part; last line: Follow-up: <entity names or none>"))
        told = generate(rows.withColumn("_prompt", prompt), "_prompt", model, "_reply", "local", usage).withColumn("_l", _local("_reply"))
        told = cut(told.select("query_id", "_l.text", "_l.names"))
        notes = notes.unionByName(told.where("trim(text) <> ''").select("query_id", F.lit(number).alias("round"), "text"))
        wanted = told.select("query_id", F.explode("names").alias("_n")).select("query_id", F.lower(F.trim("_n")).alias("_n"))
        seeds = cut(wanted.join(nodes.select("entity_id", graph.normal_name(F.col("name")).alias("_n")), "_n").select("query_id", "entity_id").distinct())
    lines = notes.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("round", "text"))), lambda x: F.concat(F.when(x["round"] == 0, "- [P] ").otherwise("- [L] "), F.trim(x["text"]))), "\n").alias("_notes"))
    rows = questions.join(lines, "query_id", "left")
    prompt = F.when(F.col("_notes").isNotNull(), F.concat(F.lit("Question: "), "query_text", F.lit("\n\nPartial answers:\n"), "_notes"))
    told = generate(rows.withColumn("_prompt", prompt), "_prompt", model, "_reply", "synthesis", usage)
    return cut(told.select("query_id", F.coalesce("_reply", F.lit(NO_ANSWER)).alias("answer")))

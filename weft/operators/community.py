"""Communities of an entity graph: detection, content hashes, choice for a question, stale reports."""

from __future__ import annotations

from collections import defaultdict
from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Graph = dict[str, dict[str, float]]
SWEEPS, LEVELS, PASSES = 100, 64, 100


def propagate_labels(graph: Graph) -> dict[str, str]:
    """Each node's label after sweeps in the order of ids, every change being seen at once.

    A node takes the label of the greatest weight around it; it keeps its own if that is among the
    greatest, else prefers the label that shares the longest beginning with its own, then the smallest.
    """
    label = {n: n for n in graph}
    for _ in range(SWEEPS):
        still = True
        for node in sorted(graph):
            weight: dict[str, float] = defaultdict(float)
            for other in sorted(graph[node]):
                weight[label[other]] += graph[node][other]
            if not weight:
                continue
            most = max(weight.values())
            if weight.get(label[node]) == most:
                continue
            ours = label[node].encode()
            tied = [x for x in weight if weight[x] == most]
            label[node] = min(tied, key=lambda x: (-len(commonprefix([x.encode(), ours])), x))
            still = False
        if still:
            break
    return label


def _moves(graph: Graph, resolution: float) -> dict[str, str]:
    """One level: nodes move to the neighbouring community of the greatest modularity gain until none does."""
    degree = {n: sum(graph[n][m] for m in sorted(graph[n])) for n in graph}
    total = sum(degree[n] for n in sorted(graph))
    home = {n: n for n in graph}
    if not total:
        return home
    load = dict(degree)
    for _ in range(PASSES):
        moved = False
        for node in sorted(graph):
            pull: dict[str, float] = defaultdict(float)
            for other in sorted(graph[node]):
                if other != node:
                    pull[home[other]] += graph[node][other]
            load[home[node]] -= degree[node]
            best, gain = home[node], 0.0
            for place in sorted({*pull, home[node]}):
                value = pull.get(place, 0.0) / total - resolution * degree[node] * load[place] / total**2
                if value > gain or value == gain and place < best:
                    best, gain = place, value
            load[best] += degree[node]
            moved |= best != home[node]
            home[node] = best
        if not moved:
            break
    smallest: dict[str, str] = {}
    for node in sorted(graph, reverse=True):
        smallest[home[node]] = node
    return {n: smallest[home[n]] for n in graph}


def louvain(graph: Graph, resolution: float = 1.0) -> list[dict[str, str]]:
    """The community of every node on each level; the level without progress is kept as the top one."""
    members = {n: [n] for n in graph}
    levels = []
    for _ in range(LEVELS if graph else 0):
        home = _moves(graph, resolution if resolution > 0 else 1.0)
        levels.append({m: home[n] for n in graph for m in members[n]})
        if len(set(home.values())) >= len(graph):
            break
        grouped: dict[str, list[str]] = defaultdict(list)
        for n in sorted(graph):
            grouped[home[n]] += members[n]
        name = {place: min(group) for place, group in grouped.items()}
        smaller: Graph = {name[place]: defaultdict(float) for place in grouped}
        for n in sorted(graph):
            for m in sorted(graph[n]):
                smaller[name[home[n]]][name[home[m]]] += graph[n][m]
        members = {name[place]: sorted(group) for place, group in grouped.items()}
        graph = smaller
    return levels


def detect(entities: DataFrame, adjacency: DataFrame, method: str = "louvain", resolution: float = 1.0) -> DataFrame:
    """(namespace, level, label, entity_id): the communities of each namespace's graph.

    entities has namespace and entity_id, adjacency namespace, entity_id, neighbour and weight. The
    algorithms are sequential by definition (each move sees those before it), so the graph of one
    namespace, as ids and weights, must fit one task; namespaces run in parallel.
    """
    if method not in ("louvain", "labels"):
        raise ValueError(method)
    nodes = entities.select("namespace", "entity_id", F.lit(None).cast("string").alias("neighbour"), F.lit(0.0).alias("weight")).distinct()
    rows = nodes.unionByName(adjacency.select("namespace", "entity_id", "neighbour", "weight"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        graph: Graph = {n: {} for n in frame["entity_id"]}
        for a, b, w in zip(frame["entity_id"], frame["neighbour"], frame["weight"]):
            if b is not None:
                graph[a][b] = float(w)
        levels = louvain(graph, resolution) if method == "louvain" else [propagate_labels(graph)]
        out = [(frame["namespace"].iloc[0], i, label, n) for i, level in enumerate(levels) for n, label in level.items()]
        return pd.DataFrame(out, columns=["namespace", "level", "label", "entity_id"])

    return rows.groupBy("namespace").applyInPandas(run, "namespace string, level int, label string, entity_id string")


def communities(labels: DataFrame, relations: DataFrame) -> DataFrame:
    """(namespace, community_id, level, parent_id, entity_ids, relation_ids) from labels.

    An id is L, the level, a dash and the smallest member; relations with both ends inside belong to
    communities of level 0; the parent is the community one level up that holds the members.
    """
    named = labels.withColumn("_first", F.min("entity_id").over(Window.partitionBy("namespace", "level", "label")))
    named = named.select("namespace", "level", "entity_id", F.concat(F.lit("L"), F.col("level"), F.lit("-"), F.col("_first")).alias("community_id"))
    base = named.groupBy("namespace", "level", "community_id").agg(F.array_sort(F.collect_list("entity_id")).alias("entity_ids"), F.min("entity_id").alias("entity_id"))
    above = named.select("namespace", (F.col("level") - 1).alias("level"), "entity_id", F.col("community_id").alias("parent_id"))
    zero = named.where("level = 0")
    a, b = zero.select("namespace", F.col("entity_id").alias("source"), "community_id"), zero.select("namespace", F.col("entity_id").alias("target"), "community_id")
    inner = relations.select("namespace", "relation_id", "source", "target").join(a, ["namespace", "source"]).join(b, ["namespace", "target", "community_id"])
    inner = inner.groupBy("namespace", "community_id").agg(F.array_sort(F.collect_set("relation_id")).alias("relation_ids"))
    full = base.join(above, ["namespace", "level", "entity_id"], "left").join(inner, ["namespace", "community_id"], "left")
    return full.select("namespace", "community_id", "level", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "entity_ids", F.coalesce("relation_ids", F.array().cast("array<string>")).alias("relation_ids"))


def content_hash(table: DataFrame) -> DataFrame:
    """table with content_hash: SHA-256 over the sorted ids of entities and relations, each ended by 0x1f, 0x1e between."""
    end = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat(x, F.lit("\x1f"))), "")
    return table.withColumn("content_hash", F.sha2(F.concat(end("entity_ids"), F.lit("\x1e"), end("relation_ids")), 256))


def select_for(queries: DataFrame, table: DataFrame, names: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, community_id, overlap): up to most communities of the top level whose members' names share most words with the query.

    queries has query_id, namespace and query_text; names has entity_id and name.
    """
    top = table.withColumn("_max", F.max("level").over(Window.partitionBy("namespace"))).where("level = _max")
    words = lambda c: F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != "")
    members = top.select("namespace", "community_id", F.explode("entity_ids").alias("entity_id")).join(names.select("entity_id", F.explode(words(F.col("name"))).alias("_w")), "entity_id")
    counted = members.groupBy("namespace", "community_id", "_w").agg(F.count("*").alias("_n"))
    asked = queries.select("query_id", "namespace", F.explode(F.array_distinct(words(F.col("query_text")))).alias("_w"))
    overlap = asked.join(counted, ["namespace", "_w"]).groupBy("query_id", "community_id").agg(F.sum("_n").alias("overlap"))
    most = most if most > 0 else 8
    # communities without a common word only fill up, in order of their ids: more than most of a namespace are never needed
    first = Window.partitionBy("namespace").orderBy("community_id")
    filler = top.select("namespace", "community_id").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most)
    idle = queries.select("query_id", "namespace").join(filler, "namespace").select("query_id", "community_id", F.lit(0).cast("long").alias("overlap"))
    filled = overlap.unionByName(idle).groupBy("query_id", "community_id").agg(F.max("overlap").alias("overlap"))
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), F.asc("community_id"))
    return filled.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def stale(table: DataFrame, reports: DataFrame) -> DataFrame:
    """Communities whose report is missing or was written for other content."""
    return content_hash(table).join(reports.select("namespace", "community_id", "content_hash"), ["namespace", "community_id", "content_hash"], "left_anti")

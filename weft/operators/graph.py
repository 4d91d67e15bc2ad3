"""Entity graphs: extraction by a gazetteer, canonical form, merging, removal, neighbourhoods, paths, resolution."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.text import union_kept
from weft.functions.vectors import hash_counts
from weft.operators.match import STRIP, containing
from weft.session import cut, unsized

FANOUT, MAX_DEPTH = 64, 2
DIGITS = 6
#: Most different name vectors of a block.
KINDS = 4096


def normal_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""))


def gazetteer_entities(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(chunk_id, name, type) of every term (name, type) whose lower-case form stands anywhere in the chunk's text.

    The terms are a dictionary: each block of texts is searched once for all of them.
    """
    wanted = terms.where(F.coalesce("name", F.lit("")) != "").select("name", "type", F.lower("name").alias("needle")).dropDuplicates(["name"])
    texts = chunks.select(F.lit(0).alias("scope"), F.col("chunk_id").alias("id"), F.lower("content").alias("text"))
    found = containing(wanted.select(F.lit(0).alias("scope"), "needle"), texts)
    return found.join(wanted, "needle").select(F.col("id").alias("chunk_id"), "name", "type")


def co_occurrences(found: DataFrame) -> DataFrame:
    """(chunk_id, source, target, relation, weight): the pairs of terms of one chunk, in order of their names."""
    a, b = found.select("chunk_id", F.col("name").alias("source")), found.select("chunk_id", F.col("name").alias("target"))
    pairs = a.join(b, "chunk_id").where("source < target")
    return pairs.select("chunk_id", "source", "target", F.lit("co-occurs").alias("relation"), F.lit(1.0).alias("weight"))


def with_sources(rows: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """rows with the sorted union of the sources of each key; each source of a key is moved once, whatever rows name it."""
    each = sources.select(key, F.explode("source_chunk_ids").alias("_c")).where("_c is not null").distinct().groupBy(key).agg(F.array_sort(F.collect_list("_c")).alias("source_chunk_ids"))
    return rows.join(each, key, "left").withColumn("source_chunk_ids", F.coalesce("source_chunk_ids", F.array().cast("array<string>")))


def canonical_entities(entities: DataFrame) -> DataFrame:
    """(entity_id, name, type, description, source_chunk_ids): one row per type and lower-case trimmed name.

    The name of the first row (smallest id) stays; different descriptions are joined by "; " in the
    order in which they first come; sources are the sorted union. Blank names are dropped.
    """
    rows = entities.where(F.coalesce(normal_name(F.col("name")), F.lit("")) != "").select(
        F.col("entity_id").alias("_row"), F.concat(F.coalesce("type", F.lit("")), F.lit(":"), normal_name(F.col("name"))).alias("entity_id"), "name", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("description", F.lit("")).alias("description"), "source_chunk_ids"
    )
    heads = rows.groupBy("entity_id", "type").agg(F.min_by("name", F.struct("_row", "name")).alias("name"))
    texts = rows.where("description <> ''").groupBy("entity_id", "description").agg(F.min("_row").alias("_at"))
    texts = texts.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "description"))), lambda x: x["description"]), "; ").alias("description"))
    sources = rows.select("entity_id", F.explode("source_chunk_ids").alias("c")).where("c <> ''").groupBy("entity_id").agg(F.array_sort(F.collect_set("c")).alias("source_chunk_ids"))
    full = heads.join(texts, "entity_id", "left").join(sources, "entity_id", "left")
    return full.select("entity_id", "name", "type", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("source_chunk_ids", F.array().cast("array<string>")).alias("source_chunk_ids"))


def canonical_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(relation_id, source, target, relation, description, weight, source_chunk_ids) between canonical entities.

    Ends are found by name alone: of several types the last id counts. Relations without both ends
    are dropped; weights are added (null as 0), the first description stays even if empty.
    """
    by_name = entities.groupBy(normal_name(F.col("name")).alias("_n")).agg(F.max("entity_id").alias("_id"))
    ends = [by_name.select(F.col("_n").alias(f"_{e}"), F.col("_id").alias(f"_{e}_id")) for e in ("source", "target")]
    rows = relations.withColumn("_source", normal_name(F.col("source"))).withColumn("_target", normal_name(F.col("target"))).join(ends[0], "_source").join(ends[1], "_target")
    keyed = rows.withColumn("_key", F.concat_ws("::", "_source_id", F.coalesce("relation", F.lit("")), "_target_id"))
    weight = F.when(F.isnan("weight"), 0.0).otherwise(F.coalesce("weight", F.lit(0.0)))
    out = keyed.groupBy(F.col("_key").alias("relation_id"), F.col("_source_id").alias("source"), F.col("_target_id").alias("target"), F.coalesce("relation", F.lit("")).alias("relation")).agg(
        F.min_by(F.coalesce("description", F.lit("")), F.struct("relation_id", F.coalesce("description", F.lit("")))).alias("description"), F.round(F.sum(weight), DIGITS).alias("weight")
    )
    out = with_sources(out, keyed.select(F.col("_key").alias("relation_id"), "source_chunk_ids"), "relation_id")
    return out.select("relation_id", "source", "target", "relation", "description", "weight", "source_chunk_ids")


def merge_entities(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """Both tables' entities by id: stored name and type first, different descriptions joined, sources united."""
    a = stored.select("entity_id", *[F.col(c).alias(f"_a_{c}") for c in ("name", "type", "description", "source_chunk_ids")])
    b = arriving.select("entity_id", *[F.col(c).alias(f"_b_{c}") for c in ("name", "type", "description", "source_chunk_ids")])
    both = a.join(b, "entity_id", "full")
    first = lambda c: F.coalesce(F.nullif(F.col(f"_a_{c}"), F.lit("")), F.col(f"_b_{c}"), F.lit(""))
    texts = F.array_distinct(F.flatten(F.array(*[F.filter(F.split(F.coalesce(f"_{s}_description", F.lit("")), "; "), lambda x: x != "") for s in "ab"])))
    return both.select("entity_id", first("name").alias("name"), first("type").alias("type"), F.array_join(texts, "; ").alias("description"), union_kept(F.col("_a_source_chunk_ids"), F.col("_b_source_chunk_ids")).alias("source_chunk_ids"))


def merge_relations(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """Both tables' relations by id: weights added, the stored description unless empty, sources united."""
    a = stored.select("relation_id", "source", "target", "relation", "description", "weight", "source_chunk_ids", F.lit(0).alias("_o"))
    rows = a.unionByName(arriving.select("relation_id", "source", "target", "relation", "description", "weight", "source_chunk_ids", F.lit(1).alias("_o")))
    merged = rows.groupBy("relation_id").agg(
        F.min_by("source", "_o").alias("source"), F.min_by("target", "_o").alias("target"), F.min_by("relation", "_o").alias("relation"), F.coalesce(F.min_by("description", F.when(F.col("description") != "", F.col("_o"))), F.lit("")).alias("description"), F.round(F.sum("weight"), DIGITS).alias("weight")
    )
    return with_sources(merged, rows, "relation_id")


def remove_sources(rows: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """Rows without the given sources (chunk_id); those left with none are dropped, those that had none stay."""
    key = "entity_id" if "entity_id" in rows.columns else "relation_id"
    kept = rows.select(key, F.explode("source_chunk_ids").alias("chunk_id")).join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_anti")
    left = kept.groupBy(key).agg(F.array_sort(F.collect_set("chunk_id")).alias("_left"))
    return rows.join(left, key, "left").where(F.col("_left").isNotNull() | (F.coalesce(F.size("source_chunk_ids"), F.lit(0)) <= 0)).withColumn("source_chunk_ids", F.coalesce("_left", "source_chunk_ids")).drop("_left")


def adjacency(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, neighbour, weight), both ways: parallel edges added, weights of 0 or less as 1, loops and unknown ends dropped."""
    known = entities.select("entity_id").distinct()
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    edges = relations.where("source <> target").select("source", "target", weight.alias("weight"))
    edges = edges.join(known.withColumnRenamed("entity_id", "source"), "source", "left_semi").join(known.withColumnRenamed("entity_id", "target"), "target", "left_semi")
    both = edges.select(F.col("source").alias("entity_id"), F.col("target").alias("neighbour"), "weight").unionByName(edges.select(F.col("target").alias("entity_id"), F.col("source").alias("neighbour"), "weight"))
    return both.groupBy("entity_id", "neighbour").agg(F.round(F.sum("weight"), DIGITS).alias("weight"))


def neighbourhood(seeds: DataFrame, relations: DataFrame, entities: DataFrame, depth: int = 1, fanout: int = FANOUT) -> DataFrame:
    """(query_id, entity_id, depth): entities within depth undirected steps of a query's seeds, at most two.

    Of each entity the first fanout entries of its sorted adjacency are followed; parallel edges each
    take one. Unknown seeds and ends are skipped.
    """
    depth = max(0, min(depth, MAX_DEPTH))
    known = entities.select("entity_id").distinct()
    entries = relations.select(F.col("source").alias("entity_id"), F.col("target").alias("_to")).unionByName(relations.where("source <> target").select(F.col("target").alias("entity_id"), F.col("source").alias("_to")))
    order = Window.partitionBy("entity_id").orderBy("_to")
    bounded = entries.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= fanout).select("entity_id", "_to").distinct()
    bounded = bounded.join(known.withColumnRenamed("entity_id", "_to"), "_to", "left_semi")
    front = seeds.join(known, "entity_id", "left_semi").select("query_id", "entity_id", F.lit(0).alias("depth")).distinct()
    reached = front
    for step in range(1, depth + 1):
        front = front.join(bounded, "entity_id").select("query_id", F.col("_to").alias("entity_id"), F.lit(step).alias("depth")).distinct()
        reached = reached.unionByName(front)
    return reached.groupBy("query_id", "entity_id").agg(F.min("depth").alias("depth"))


def induced_edges(reached: DataFrame, relations: DataFrame) -> DataFrame:
    """(query_id, relation_id) of the relations between reached entities."""
    a = reached.select("query_id", F.col("entity_id").alias("source"))
    b = reached.select("query_id", F.col("entity_id").alias("target"))
    return relations.select("relation_id", "source", "target").join(a, "source").join(b, ["query_id", "target"]).select("query_id", "relation_id")


def seed_pairs(seeds: DataFrame) -> DataFrame:
    """(query_id, a, b), a < b: the pairs of each query's seeds."""
    a, b = seeds.select("query_id", F.col("entity_id").alias("a")), seeds.select("query_id", F.col("entity_id").alias("b"))
    return a.join(b, "query_id").where("a < b").distinct()


def rank_paths(pairs: DataFrame, relations: DataFrame, decay: float = 0.5, bonus: float = 0.1) -> DataFrame:
    """(query_id, entities, relations, score, rank): paths of one or two relations between the ends of each pair.

    The score is decay^(edges - 1) times the weights (0 or less as 1), and 1 + bonus more if two
    consecutive relations share a source chunk.
    """
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    edges = relations.where("source <> target").select("relation_id", "source", "target", weight.alias("w"), "source_chunk_ids")
    steps = edges.select("relation_id", F.col("source").alias("x"), F.col("target").alias("y"), "w", "source_chunk_ids").unionByName(edges.select("relation_id", F.col("target").alias("x"), F.col("source").alias("y"), "w", "source_chunk_ids"))
    one = pairs.join(steps, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))).select("query_id", F.array("a", "b").alias("entities"), F.array("relation_id").alias("relations"), F.col("w").alias("score"))
    s1 = steps.select(F.col("relation_id").alias("r1"), F.col("x").alias("a"), F.col("y").alias("m"), F.col("w").alias("w1"), F.col("source_chunk_ids").alias("c1"))
    s2 = steps.select(F.col("relation_id").alias("r2"), F.col("x").alias("m"), F.col("y").alias("b"), F.col("w").alias("w2"), F.col("source_chunk_ids").alias("c2"))
    share = F.when(F.coalesce(F.arrays_overlap("c1", "c2"), F.lit(False)), 1 + bonus).otherwise(1.0)
    two = pairs.join(s1, "a").join(s2, ["m", "b"]).where("m <> a and m <> b")
    two = two.select("query_id", F.array("a", "m", "b").alias("entities"), F.array("r1", "r2").alias("relations"), (decay * F.col("w1") * F.col("w2") * share).alias("score"))
    both = one.unionByName(two).withColumn("score", F.round("score", DIGITS))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.array_join("entities", "\x00"), F.array_join("relations", "\x00"))
    return both.withColumn("rank", F.row_number().over(order))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) is connected with.

    Each round hands labels to neighbours and then jumps to the label's label, so that rounds grow
    with the logarithm of a chain's length; every round is cut by a checkpoint, also from what
    Spark's planner estimates its size to be.
    """
    both = unsized(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct())
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
    labels = unsized(labels)
    for _ in range(rounds):
        spread = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("_near"))
        near = labels.join(spread, labels.node == spread.a).select("node", F.least("label", "_near").alias("_l"), F.col("label").alias("_old"))
        jump = labels.select(F.col("node").alias("_l"), F.col("label").alias("_far"))
        new = unsized(near.join(jump, "_l", "left").select("node", F.least("_l", F.coalesce("_far", "_l")).alias("label"), "_old"))
        moved = new.where("label <> _old").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle")


def _stars(counts: np.ndarray, threshold: float) -> np.ndarray:
    """For each vector of bucket counts the place of the first one that it is connected with by cosines of at least the threshold."""
    size, first = np.linalg.norm(counts, axis=1), np.arange(len(counts))
    left = np.arange(len(counts))
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):  # each vector is once in front, so all of this is one product of every two
            met = np.zeros(len(left), bool)
            for at in range(0, len(front), STRIP):
                some = front[at : at + STRIP]
                met |= (np.round(counts[some] @ counts[left].T / (size[some, None] * size[left]), DIGITS) >= threshold).any(axis=0)
            front, left = left[met], left[~met]
            first[front] = root
    return first


def alike_names(kinds: DataFrame, threshold: float) -> DataFrame:
    """(a, b): edges that connect the nodes of kinds (type, node, counts) as far as cosines of at least the threshold within a type do.

    The vectors of a type are cut into blocks; every two blocks are one task's matrix product, of which
    only one edge a vector leaves the task.
    """
    cuts = kinds.groupBy("type").agg(F.ceil(F.count("*") / KINDS).cast("int").alias("_of"))
    held = kinds.join(cuts, "type").withColumn("_own", F.expr("cast(pmod(xxhash64(node), _of) as int)")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    held = held.where("_own <> _other or _of = 1").select("type", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "node", "counts")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")
        first = _stars(np.array([c.split(",") for c in table["counts"].to_pylist()], dtype=np.float64), threshold)
        linked = np.nonzero(first != np.arange(len(first)))[0]
        return pa.table({"a": table["node"].take(pa.array(linked)), "b": table["node"].take(pa.array(first[linked]))})

    return held.groupBy("type", "_i", "_j").applyInArrow(run, "a string, b string")


def resolve(entities: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(type, name, canonical): names of one type that mean the same, by equal normal names or the cosine of their embeddings.

    Every two names of a type are compared, by their different vectors: names of one vector are one
    node of the graph, those without a token one node by normal name. The canonical name of a
    component is the longest in bytes, then the smallest.
    """
    names = entities.where(F.coalesce(normal_name(F.col("name")), F.lit("")) != "").select(F.coalesce("type", F.lit("")).alias("type"), F.trim("name").alias("name")).distinct()
    keyed = names.withColumn("_n", normal_name(F.col("name"))).withColumn("_v", hash_counts(F.col("name")))
    counts = F.when(F.exists("_v", lambda x: x > 0) & F.lit(threshold <= 1), F.array_join(F.transform("_v", lambda x: x.cast("int").cast("string")), ","))
    keyed = keyed.select("type", "name", "_n", counts.alias("counts"))
    keyed = cut(keyed.withColumn("node", F.concat("type", F.lit("\x1f"), F.coalesce("counts", F.concat(F.lit("\x1f"), "_n")))))
    near = alike_names(keyed.where("counts is not null").select("type", "node", "counts").distinct(), threshold)
    same = keyed.groupBy("type", "_n").agg(F.array_sort(F.collect_set("node")).alias("_s")).where(F.size("_s") > 1)
    equal = same.select(F.explode(F.slice("_s", 2, F.size("_s") - 1)).alias("a"), F.get("_s", F.lit(0)).alias("b"))
    longest = F.min_by("name", F.struct(-F.octet_length("name"), F.col("name")))
    placed = keyed.groupBy("node").agg(longest.alias("name")).join(components(equal.unionByName(near)), "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = placed.groupBy("component").agg(longest.alias("canonical"))
    return keyed.join(placed.join(heads, "component").select("node", "canonical"), "node").select("type", "name", "canonical")


def rewrite(entities: DataFrame, relations: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations with every resolved name (name, canonical) replaced, by name alone and whatever the type.

    A name that several types resolve differently goes to the longest canonical name, then the smallest.
    """
    best = names.groupBy(F.col("name").alias("_n")).agg(F.min_by("canonical", F.struct(-F.octet_length("canonical"), F.col("canonical"))).alias("_to"))

    def replaced(rows: DataFrame, column: str) -> DataFrame:
        joined = rows.withColumn("_n", F.trim(F.col(column))).join(best, "_n", "left")
        return joined.withColumn(column, F.coalesce("_to", F.col(column))).drop("_n", "_to").select(*rows.columns)

    return replaced(entities, "name"), replaced(replaced(relations, "source"), "target")


def snapshot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, place) of a graph's entities and relations, each kind in the order of its ids."""
    ids = nodes.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id")).unionByName(edges.select(F.lit("relation").alias("kind"), F.col("relation_id").alias("id")))
    return ids.distinct().withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("id")))


def find_entities(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, entity_id, entity_name) of the entities that have a name of the list (name), without regard to case and outer blanks."""
    wanted = names.select("name", normal_name(F.col("name")).alias("_n")).where("_n <> ''").distinct()
    return wanted.join(nodes.select("entity_id", F.col("name").alias("entity_name"), normal_name(F.col("name")).alias("_n")), "_n").select("name", "entity_id", "entity_name")

"""Problem 7: one ranking from several differently-scaled scores, by Borda count.

Only places enter, never score values, so no leg dominates by its range. A leg's counts are summed
over order-keeping buckets first and rows are ranked inside their bucket, so no task ever sorts a
whole hot group.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.topn import score_bucket
from weft.session import cut

#: Buckets per doubling of a score: enough to part a hot group, few enough for the counts of all groups to be small.
COARSE = 4


def leg_places(hits: DataFrame, query: str = "query_id", leg: str = "leg", item: str = "chunk_id", score: str = "score") -> DataFrame:
    """(query, leg, item, score, place, mean_place, n): competition places within query and leg.

    The highest of an item's scores counts. place is 1 + the number of items with a strictly higher
    score; items of equal score share mean_place, the mean of the places they fill; n is the number
    of items. Rows with a null in these columns or a NaN score take no part.

    Only counts by bucket are summed over a whole group; its rows are sorted bucket by bucket.
    """
    known = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(query).isNotNull() & F.col(leg).isNotNull() & F.col(item).isNotNull()
    best = (
        hits.where(known)
        .select(F.col(query).alias("_q"), F.col(leg).alias("_leg"), F.col(item).alias("_item"), F.col(score).cast("double").alias("_score"))
        .groupBy("_q", "_leg", "_item")
        .agg(F.max("_score").alias("_score"))
        .withColumn("_bucket", score_bucket(F.col("_score"), COARSE))
    )
    whole = Window.partitionBy("_q", "_leg")
    higher = whole.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        best.groupBy("_q", "_leg", "_bucket")
        .agg(F.count("*").alias("_in"))
        .select("_q", "_leg", "_bucket", F.coalesce(F.sum("_in").over(higher), F.lit(0)).alias("_above"), F.sum("_in").over(whole).alias("_n"))
    )
    # the join and both windows share one partitioning
    inside = Window.partitionBy("_q", "_leg", "_bucket")
    placed = best.join(blocks, ["_q", "_leg", "_bucket"]).withColumn("_place", F.col("_above") + F.rank().over(inside.orderBy(F.desc("_score"))))
    same = F.count("*").over(Window.partitionBy("_q", "_leg", "_bucket", "_score"))
    return placed.select(
        F.col("_q").alias("query_id"), F.col("_leg").alias("leg"), F.col("_item").alias("chunk_id"), F.col("_score").alias("score"), F.col("_place").alias("place"), (F.col("_place") + (same - 1) / 2).alias("mean_place"), F.col("_n").alias("n")
    )


def _numbered(hits: DataFrame, names: list[str]) -> DataFrame:
    """Hits of these legs only, with the leg's number from 1 in place of its name, which is less to move."""
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("leg")).cast("int")
    return hits.select("query_id", "chunk_id", "score", number.alias("leg")).where(F.col("leg") > 0)


def borda(hits: DataFrame, legs: Mapping[str, float]) -> DataFrame:
    """(query_id, chunk_id, legs, worst_place, points, rank): one ranking per query.

    legs maps each leg that counts to its weight; other legs are ignored. With c candidates of the
    query, a leg gives weight * (c - mean place) points. An item without a score there gets the
    middle of the places the leg leaves open, (n + 1 + c) / 2; a leg that returned nothing thus
    treats all alike. Equal points: the smaller chunk_id first.
    """
    if not legs:
        raise ValueError("at least one leg is needed")
    names = sorted(legs)
    weight = F.element_at(F.array(*[F.lit(float(legs[n])) for n in names]), F.col("leg"))
    placed = leg_places(_numbered(hits, names))
    # a candidate's known points, and the sizes of the legs they come from: all that later steps need of its places
    items = placed.groupBy("query_id", "chunk_id").agg(
        F.count("*").alias("legs"), F.max("place").alias("worst_place"), F.sum(weight * F.col("mean_place")).alias("_spent"), *[F.max(F.when(F.col("leg") == i + 1, F.col("n"))).alias(f"_n{i}") for i in range(len(names))]
    )
    items = cut(items)  # read for the candidates of each query, for the counts by bucket and for the ranking
    per_query = items.groupBy("query_id").agg(F.count("*").alias("_c"), *[F.coalesce(F.max(f"_n{i}"), F.lit(0)).alias(f"_t{i}") for i in range(len(names))])
    whole, absent = sum(float(x) for x in legs.values()), F.lit(0.0)
    for i, name in enumerate(names):
        absent = absent + F.when(F.col(f"_n{i}").isNotNull(), 0.0).otherwise(float(legs[name]) * (F.col(f"_t{i}") + 1 + F.col("_c")) / 2)
    points = F.lit(whole) * F.col("_c") - F.col("_spent") - absent
    scored = items.join(per_query, "query_id").select("query_id", "chunk_id", "legs", "worst_place", points.alias("points")).withColumn("_bucket", score_bucket(F.col("points"), COARSE))
    above = Window.partitionBy("query_id").orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = scored.groupBy("query_id", "_bucket").agg(F.count("*").alias("_in")).select("query_id", "_bucket", F.coalesce(F.sum("_in").over(above), F.lit(0)).alias("_above"))
    inside = Window.partitionBy("query_id", "_bucket").orderBy(F.desc("points"), F.asc("chunk_id"))
    return scored.join(blocks, ["query_id", "_bucket"]).select("query_id", "chunk_id", "legs", "worst_place", "points", (F.col("_above") + F.row_number().over(inside)).alias("rank"))


def unanimous_first(hits: DataFrame, legs: Mapping[str, float], within: int = 3) -> DataFrame:
    """(query_id, chunk_id): the only candidate placed 1 to ``within`` in every leg, if there is just one.

    No sum of points finds it: places 1, 1, 1, 4 give more points than 3, 3, 3, 3. So this is a rule of
    its own over the places that the ranking counts; rows of a worse place can't matter and are left
    before the candidates' legs are brought together.
    """
    return (
        leg_places(_numbered(hits, sorted(legs)))
        .where(F.col("place") <= within)
        .groupBy("query_id", "chunk_id")
        .agg(F.count("*").alias("_legs"))
        .where(F.col("_legs") == len(legs))
        .groupBy("query_id")
        .agg(F.count("*").alias("_k"), F.min("chunk_id").alias("chunk_id"))
        .where(F.col("_k") == 1)
        .select("query_id", "chunk_id")
    )

"""Problem 1: the N best items of every group.

Scores fall into buckets by sign and logarithm, which keep their order and part them at any scale, so no
pass for minimum and maximum is needed. A histogram per group gives the highest bucket bound that at least N different
items reach; rows below it can't be among the best and go before anything is sorted. The histogram
counts items by a bit set, so repeated rows of an item never raise the bound too far.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets per doubling of a score: scores a thousandth apart differ, at whatever scale.
RESOLUTION = 1024
#: Doublings from the smallest to the largest double.
DOUBLINGS = 2200
#: Bits that stand for one wanted item, so that few of N items share a bit.
BITS_PER_ITEM = 4
SALTS = 8


def score_bucket(score: Column, resolution: int = RESOLUTION) -> Column:
    """An integer that never falls as the score rises: its sign and logarithm, so every scale has as many buckets.

    Zero gets 0, infinities the outermost buckets.
    """
    size = F.least(F.greatest((F.log2(F.abs(score)) + DOUBLINGS // 2) * resolution, F.lit(1.0)), F.lit(float(DOUBLINGS * resolution)))
    return F.when(score > 0, F.floor(size)).when(score < 0, -F.floor(size)).otherwise(0).cast("int")


def thresholds(rows: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """(keys, _floor): a bucket that at least n different items of the group reach.

    ``rows`` has the keys, _item and _bucket. Groups with fewer than 4n rows, where nothing is
    gained, or without n items have no row.
    """
    words = max(1, -(-n * BITS_PER_ITEM // 64))
    bit = F.expr(f"pmod(xxhash64(_item), {64 * words})")
    marked = rows.withColumn("_bit", bit.cast("int"))
    sets = [
        F.bit_or(F.when(F.floor(F.col("_bit") / 64) == w, F.expr("shiftleft(1L, _bit % 64)")).otherwise(F.lit(0).cast("long"))).alias(f"_s{w}")
        for w in range(words)
    ]
    histogram = marked.groupBy(*keys, "_bucket").agg(*sets, F.count("*").alias("_rows"))
    group = Window.partitionBy(*keys)
    above = group.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = sum((F.bit_count(F.bit_or(f"_s{w}").over(above)) for w in range(words)), F.lit(0))
    return (
        histogram.select(*keys, "_bucket", seen.alias("_seen"), F.sum("_rows").over(group).alias("_total"))
        .where((F.col("_seen") >= n) & (F.col("_total") > 4 * n))
        .groupBy(*keys)
        .agg(F.max("_bucket").alias("_floor"))
    )


def top_n(rows: DataFrame, keys: Sequence[str], item: str, score: str, n: int) -> DataFrame:
    """(keys, item, score, rank): the n items of the highest score in each group.

    Of several rows of an item its highest score counts; of equal scores the smaller item goes
    first, so the result doesn't depend on the order of the input. Rows with a null key, item or
    score, or a NaN score, take no part; groups with fewer than n items come out whole; an empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    names = [f"_k{i}" for i in range(len(keys))]
    known = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(item).isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    slim = rows.where(known).select(
        *[F.col(k).alias(a) for k, a in zip(keys, names)], F.col(item).alias("_item"), F.col(score).alias("_score"), score_bucket(F.col(score).cast("double")).alias("_bucket")
    )
    # The floor of a hot group is copied once per salt, so that its rows needn't meet in one task.
    floors = thresholds(slim, names, n).withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    salted = slim.withColumn("_salt", F.expr(f"cast(pmod(hash(_item), {SALTS}) as int)"))
    kept = salted.join(floors, [*names, "_salt"], "left").where(F.col("_floor").isNull() | (F.col("_bucket") >= F.col("_floor")))
    best = kept.groupBy(*names, "_item").agg(F.max("_score").alias("_score"))
    order = Window.partitionBy(*names).orderBy(F.desc("_score"), F.asc("_item"))
    return (
        best.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= n)
        .select(*[F.col(a).alias(k) for k, a in zip(keys, names)], F.col("_item").alias(item), F.col("_score").alias(score), F.col("_rank").alias("rank"))
    )

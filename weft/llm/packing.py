"""Problem 9: fill containers of fixed capacity, by best-fit decreasing.

Rows are spread over shards of a few thousand containers' worth of tokens; each shard is packed by
itself, so at most one container per shard is left poorly filled. A segment tree over remaining
capacities finds the tightest open container in logarithmic time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a shard, in containers, at which the one ill-filled container it may leave is negligible.
SHARD_CONTAINERS = 2048


class Capacities:
    """Segment tree over remaining capacities 0..capacity: how many open containers have each."""

    def __init__(self, capacity: int) -> None:
        self.width = 1
        while self.width <= capacity:
            self.width *= 2
        self.count = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.width
        while i:
            self.count[i] += by
            i //= 2

    def put(self, container: int, room: int) -> None:
        self.open[room].append(container)
        self._add(room, 1)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the open container with the least room that is at least size: (container, room)."""
        i = size + self.width
        if not self.count[i]:
            while i > 1 and (i % 2 or not self.count[i + 1]):  # climb to the first subtree on the right that isn't empty
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.width
        self._add(room, -1)
        return self.open[room].pop(), room


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[int]:
    """The container of each item, from 0; items of size 0 get -1. Sizes above capacity are an error."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])  # stable: equal sizes keep their order
    tree, out, made = Capacities(capacity), [-1] * len(sizes), 0
    for i in order:
        size = sizes[i]
        if size > capacity:
            raise ValueError("an item exceeds the capacity")
        if size <= 0:
            break
        found = tree.tightest(size)
        container, room = found if found else (made, capacity)
        made += found is None
        out[i] = container
        if room - size:
            tree.put(container, room - size)
    return out


def pack(sizes: DataFrame, key: str, size: str, capacity: int, shards: int) -> DataFrame:
    """(key, part, first, n_tokens, shard, container): where each item, or part of one, lies.

    Only an item larger than the capacity is divided: into parts of the capacity and a rest; first
    is the number of its tokens before the part. Items of a null or non-positive size need no room:
    part 0 with a null container. Repeated rows are packed each for itself. A container is named by
    shard and container together. Rows with a null key are packed like others.
    """
    if capacity < 1 or shards < 1:
        raise ValueError("capacity and shards must be 1 or more")
    kind = sizes.schema[key].dataType.simpleString()
    slim = sizes.select(F.col(key).alias("_key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
    parts = slim.select(
        "_key", F.posexplode(F.expr(f"transform(sequence(0L, greatest(_size - 1, 0L), {capacity}L), x -> struct(x as first, least(_size - x, {capacity}L) as n))")).alias("part", "_at")
    ).select("_key", "part", F.col("_at.first").alias("first"), F.greatest(F.col("_at.n"), F.lit(0)).alias("n_tokens"))
    # Copies of a key and its parts spread too, so no key makes a shard hot.
    sharded = parts.withColumn("shard", F.expr(f"cast(pmod(xxhash64(_key, part, n_tokens), {shards}) as int)"))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "_key", "part"], ascending=[False, True, True], kind="stable", ignore_index=True)
        boxes = np.array(best_fit_decreasing(frame["n_tokens"].tolist(), capacity), dtype=np.int64)
        frame["container"] = pd.array(boxes, dtype="Int64")
        frame.loc[boxes < 0, "container"] = pd.NA
        return frame[["_key", "part", "first", "n_tokens", "shard", "container"]]

    packed = sharded.groupBy("shard").applyInPandas(fill, f"_key {kind}, part int, first bigint, n_tokens bigint, shard int, container bigint")
    return packed.withColumnRenamed("_key", key)

"""Problem 4: the k most similar vectors of every vector, by an inverted file with product-quantised residuals.

Coarse centroids and the codebooks of the residuals are fitted on a bounded sample; every vector is
indexed. A query probes the lists of the cells nearest to its own, distances between the query as it
is and codes come from products with the vectors that codes stand for, and the best candidates are
ranked again by exact cosine.

The work is cut by group (namespace) and by block of asking vectors. A group within ``unit`` vectors
is one list of items. A larger one is cut into packs of coarse cells, and a pack that is still too
large by salt; its queries are copied to the packs they probe. So no task holds an unbounded group,
and vectors of small groups are moved once. Equal vectors are searched as one and brought apart again afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.session import cut

DIM = 64


@dataclass(frozen=True)
class Settings:
    """sample: most vectors the index is fitted on; cells: most coarse centroids; parts, codes: of the
    product quantiser; probes: cells whose lists a vector is compared with, those nearest to its own
    cell; scan: and further cells until it meets so many vectors; rerank: least candidates ranked
    exactly, or the root of the vectors met if that is more; unit: most vectors of a task's list;
    block: most vectors that ask in a task."""

    sample: int = 16_384
    cells: int = 256
    parts: int = 16
    codes: int = 256
    probes: int = 64
    scan: int = 4096
    rerank: int = 64
    unit: int = 65_536
    block: int = 12_288


def usable(vector: Column, dim: int = DIM) -> Column:
    """Whether a vector has dim finite numbers, not all zero; null gives false."""
    finite = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def k_means(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of the points, starting from the first k different ones; fewer if there are fewer."""
    _, first = np.unique(points, axis=0, return_index=True)
    centroids = points[np.sort(first)[:k]].copy()
    for _ in range(rounds):
        nearest = assign(points, centroids)
        order = np.argsort(nearest, kind="stable")
        used, at = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(points[order], at, axis=0)
        centroids[used] = sums / np.diff(np.append(at, len(points)))[:, None]
    return centroids


def assign(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each point."""
    bias = (centroids**2).sum(1) / 2
    out = np.empty(len(points), dtype=np.int32)
    for at in range(0, len(points), 8192):
        out[at : at + 8192] = np.argmax(points[at : at + 8192] @ centroids.T - bias, axis=1)
    return out


@dataclass
class Index:
    centroids: np.ndarray  # cells x dim
    books: np.ndarray  # parts x codes x dim of a part

    def __post_init__(self) -> None:
        # near[c]: all cells, those nearest to the centroid of c first
        self.near = np.argsort(-(self.centroids @ self.centroids.T - (self.centroids**2).sum(1) / 2), axis=1, kind="stable")

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        out = self.centroids[cell]
        width = self.books.shape[2]
        for m, book in enumerate(self.books):
            out[:, m * width : (m + 1) * width] += book[codes[:, m]]
        return out

    def line(self) -> np.ndarray:
        """The place of each cell in an order that keeps near ones together: halves by the main axis, again and again."""

        def halves(cells: np.ndarray) -> list[int]:
            if len(cells) < 3:
                return cells.tolist()
            middle = self.centroids[cells] - self.centroids[cells].mean(axis=0)
            along = np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")
            return halves(cells[along[: len(cells) // 2]]) + halves(cells[along[len(cells) // 2 :]])

        return np.argsort(halves(np.arange(len(self.centroids))))

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each point, and the codes of its residual, one column per part."""
        cell = assign(points, self.centroids)
        rest = points - self.centroids[cell]
        width = self.books.shape[2]
        codes = np.stack([assign(np.ascontiguousarray(rest[:, m * width : (m + 1) * width]), book) for m, book in enumerate(self.books)], axis=1)
        return cell, codes


def unit_length(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)  # so that no square overflows
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def fit(points: np.ndarray, cells: int, s: Settings) -> Index:
    points = points.astype(np.float32)
    centroids = k_means(points, max(1, min(cells, len(points) // 16 or 1)))
    rest = points - centroids[assign(points, centroids)]
    width = points.shape[1] // s.parts
    books = [k_means(np.ascontiguousarray(rest[:, m * width : (m + 1) * width]), s.codes, 5) for m in range(s.parts)]
    longest = max(map(len, books))
    # parts with fewer different values repeat their last codeword, which changes nothing
    return Index(centroids, np.stack([np.concatenate([b, np.repeat(b[-1:], longest - len(b), axis=0)]) for b in books]))


def search(index: Index, queries: np.ndarray, items: np.ndarray, same: np.ndarray, k: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, cosine to 12 decimals) of the best k items of each query, and those equal to the k-th.

    same[q] is the query's own item or -1. Both are of unit length in double precision; the items
    should differ, since copies take each other's place among the candidates. Queries of one cell
    probe the same lists; a distance to a code is the product with the vector that the code stands
    for, so their lists are scanned by one matrix product.
    """
    cell, codes = index.encode(items.astype(np.float32))
    order = np.argsort(cell, kind="stable")
    counts = np.bincount(cell, minlength=len(index.centroids))
    starts = np.cumsum(counts) - counts
    coded = index.decode(cell[order], codes[order])
    place = np.empty(len(items), dtype=np.int64)
    place[order] = np.arange(len(items))
    out_q, out_x, out_c = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]

    def scan(asking: np.ndarray, listed: np.ndarray) -> None:
        """Compare queries with the items at these places, which ascend."""
        most = min(max(s.rerank, 4 * k, int(np.sqrt(len(listed)))), len(listed))
        seen = np.ascontiguousarray(coded[listed].T)
        size = int(np.clip(8_000_000 // len(listed), 64, 512))
        for at in range(0, len(asking), size):
            part = asking[at : at + size]
            block = queries[part]
            near = block.astype(np.float32) @ seen
            rows = np.nonzero(same[part] >= 0)[0]
            own = place[same[part][rows]]
            here = np.searchsorted(listed, own)
            there = (here < len(listed)) & (listed[np.minimum(here, len(listed) - 1)] == own)
            near[rows[there], here[there]] = -np.inf
            top = np.argpartition(near, len(listed) - most, axis=1)[:, len(listed) - most :] if most < len(listed) else np.broadcast_to(np.arange(len(listed)), near.shape)
            other = np.isfinite(np.take_along_axis(near, top, axis=1))
            xs = order[listed[top]]
            exact = np.round(np.clip(np.matmul(items[xs], block[:, :, None])[:, :, 0], -1.0, 1.0), 12)
            exact[~other] = -np.inf
            least = np.partition(exact, most - min(k, most), axis=1)[:, most - min(k, most)]
            qs, column = np.nonzero(other & (exact >= least[:, None]))
            out_q.append(part[qs])
            out_x.append(xs[qs, column])
            out_c.append(exact[qs, column])

    if len(items) <= s.scan:
        scan(np.arange(len(queries)), np.arange(len(items)))
    else:
        mine = assign(queries.astype(np.float32), index.centroids)
        by = np.argsort(mine, kind="stable")
        for c in np.unique(mine).tolist():
            asking = by[np.searchsorted(mine[by], c) : np.searchsorted(mine[by], c, side="right")]
            met = np.cumsum(counts[index.near[c]])
            probed = np.sort(index.near[c][: max(s.probes, int(np.searchsorted(met, s.scan)) + 1)])
            if listed := [np.arange(starts[j], starts[j] + counts[j]) for j in probed.tolist() if counts[j]]:
                scan(asking, np.concatenate(listed))
    return np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_c)


def ranked(index: Index, vectors: np.ndarray, names: np.ndarray, asking: np.ndarray, offered: np.ndarray, k: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of asking, its class; and by class the best k + 1 rows of offered with their cosines, -1 where there are fewer.

    A class is the rows of one vector; its own rows are among the best, as each of them has the
    others for neighbours. Classes are searched, not rows, so copies can't crowd out anything; then
    each gives its k + 1 smallest rows by names, as more can't be among the best.
    """
    kinds, kind = np.unique(vectors + 0.0, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    members = offered[np.lexsort((names[offered], kind[offered]))]
    there, first = np.unique(kind[members], return_index=True)
    counts = np.minimum(np.diff(np.append(first, len(members))), k + 1)
    wanted, of = np.unique(kind[asking], return_inverse=True)
    same = np.searchsorted(there, wanted)
    same = np.where((same < len(there)) & (there[np.minimum(same, len(there) - 1)] == wanted), same, -1)
    qs, xs, cosine = search(index, kinds[wanted], kinds[there], same, k, s)
    own = np.nonzero(same >= 0)[0]
    qs, xs, cosine = np.append(qs, own), np.append(xs, same[own]), np.append(cosine, np.ones(len(own)))
    n = counts[xs]
    rows = members[np.repeat(first[xs], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    qs, cosine = np.repeat(qs, n), np.repeat(cosine, n)
    by = np.lexsort((names[rows], -cosine, qs))
    qs, rows, cosine = qs[by], rows[by], cosine[by]
    rank = np.arange(len(qs)) - np.searchsorted(qs, np.arange(len(wanted)))[qs]
    best, value = np.full((len(wanted), k + 1), -1), np.zeros((len(wanted), k + 1))
    kept = rank <= k
    best[qs[kept], rank[kept]], value[qs[kept], rank[kept]] = rows[kept], cosine[kept]
    return of.reshape(-1), best, value


def nearest(rows: DataFrame, group: str, key: str, vector: str, k: int = 5, dim: int = DIM, settings: Settings | None = None) -> DataFrame:
    """(group, key, neighbour, cosine, rank): the k most similar vectors of its group for each vector.

    Vectors that are null, of another length, not finite or all zero take no part, nor do rows with
    a null key or group. key must be unique (of repeated rows one is enough). Equal cosines: the
    smaller key first. A vector alone in its group has no row; an empty table gives none. Other
    columns are ignored, whatever their names.
    """
    s = settings or Settings()
    slim = rows.select(F.col(group).alias("_g"), F.col(key).alias("_id"), F.col(vector).cast("array<float>").alias("_v"))
    slim = slim.where(F.col("_g").isNotNull() & F.col("_id").isNotNull() & usable(F.col("_v"), dim))
    slim = cut(slim)  # read three times: for its size, the sample and the search
    n = slim.select("_id").count()
    share = min(1.0, s.sample / max(1, n))
    picked = slim.select(F.xxhash64("_id").alias("_h"), "_v").where(F.expr(f"pmod(_h, 1000000) < {int(np.ceil(share * 1_000_000))}")).limit(2 * s.sample).toArrow()
    if not picked.num_rows:
        return slim.select(F.col("_g").alias(group), F.col("_id").alias(key), F.col("_id").alias("neighbour"), F.lit(0.0).alias("cosine"), F.lit(1).alias("rank")).where("false")
    sample = picked.sort_by("_h")
    points = unit_length(sample["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
    index = fit(points, s.cells, s)

    units = ["_g", "_pack", "_salt", "_block"]
    # Fewer than n / block groups exceed a block, so their sizes may be sent to all tasks while that is a small number.
    sizes = slim.groupBy("_g").agg(F.count("*").alias("_n")).where(F.col("_n") > min(s.block, s.unit))
    sized = slim.join(F.broadcast(sizes) if n <= 10_000 * min(s.block, s.unit) else sizes, "_g", "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    # A group within the unit is one list; if more than a block of its vectors ask, each block gets the list.
    blocks_of = F.ceil(F.col("_n") / s.block).cast("int")
    small = sized.where(F.col("_n") <= s.unit).withColumn("_blocks", blocks_of).withColumn("_mine", F.expr("cast(pmod(xxhash64(_v), _blocks) as int)"))
    small = small.select("_g", F.lit(0).alias("_pack"), F.lit(0).alias("_salt"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), "_id", "_v", "_mine")
    small = small.select(*units, "_id", "_v", F.when(F.col("_block") == F.col("_mine"), 3).otherwise(2).alias("_role"))
    line = index.line()

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        """The places in that order of the vector's own cell, then of the cells whose lists it is compared with."""
        if not len(vectors):
            return pd.Series([], dtype=object)
        own = assign(unit_length(np.stack(vectors.to_numpy())).astype(np.float32), index.centroids)
        reach = [[int(line[c]), *map(int, line[near[: s.probes]])] for c, near in enumerate(index.near)]
        return pd.Series([reach[c] for c in own])

    # Of equal vectors the first asks for all, and k + 1 are enough to be found.
    copies = Window.partitionBy("_g", "_v").orderBy("_id")
    large = sized.where(F.col("_n") > s.unit).select("_g", "_id", "_v")
    offered = large.withColumn("_r", F.row_number().over(copies)).where(F.col("_r") <= k + 1).withColumn("_p", cells("_v")).withColumn("_cell", F.col("_p")[0])
    # Cells make packs of about a unit, cut by salt; their queries are cut by block. A query goes to every pack that has a cell it probes.
    counted = offered.groupBy("_g", "_cell").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_g").orderBy("_cell")) - F.col("_n")
    packs = counted.withColumn("_pack", F.floor(before / s.unit).cast("int"))
    items = offered.join(packs.drop("_n"), ["_g", "_cell"]).select("_g", "_pack", "_id", "_v")
    held = packs.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_cell", "_pack"))).alias("_packs"))
    reached = F.array_distinct(F.filter(F.transform("_p", lambda c: F.try_element_at("_packs", c)), lambda x: x.isNotNull()))
    asked = offered.where(F.col("_r") == 1).join(held, "_g").select("_g", F.explode(reached).alias("_pack"), "_id", "_v")
    salts = packs.groupBy("_g", "_pack").agg(F.ceil(F.sum("_n") / s.unit).cast("int").alias("_salts"))
    blocks = asked.groupBy("_g", "_pack").agg(F.ceil(F.count("*") / s.block).cast("int").alias("_blocks"))
    cuts = salts.join(blocks, ["_g", "_pack"])
    items = items.join(cuts, ["_g", "_pack"]).select("_g", "_pack", F.expr("cast(pmod(xxhash64(_v), _salts) as int)").alias("_salt"), F.explode(F.expr("sequence(0, _blocks - 1)")).alias("_block"), "_id", "_v", F.lit(2).alias("_role"))
    asked = asked.join(cuts, ["_g", "_pack"]).select("_g", "_pack", F.explode(F.expr("sequence(0, _salts - 1)")).alias("_salt"), F.expr("cast(pmod(xxhash64(_id, 1), _blocks) as int)").alias("_block"), "_id", "_v", F.lit(1).alias("_role"))
    id_type = slim.schema["_id"].dataType.simpleString()
    group_type = slim.schema["_g"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        """Of a whole group each row's k nearest; else the k + 1 best of each vector that asks, itself among them."""
        ids = table["_id"].combine_chunks()
        role = table["_role"].to_numpy()
        vectors = unit_length(table["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        q, x = np.nonzero(role & 1)[0], np.nonzero(role & 2)[0]
        qs = xs = np.empty(0, dtype=np.int64)
        cosine, rank = np.empty(0), np.empty(0, dtype=np.int32)
        if len(q) and len(x):
            words = np.array(ids.to_pylist())
            names = np.unique(words, return_inverse=True)[1].reshape(-1)
            of, best, value = ranked(index, vectors, names, q, x, k, s)
            some = best[of]
            kept = (some >= 0) & ((role[q] == 1)[:, None] | (names[some] != names[q][:, None]))
            at = np.cumsum(kept, axis=1)
            kept &= at <= np.where(role[q] == 1, k + 1, k)[:, None]
            rows, columns = np.nonzero(kept)
            qs, xs, cosine, rank = q[rows], some[rows, columns], value[of[rows], columns], at[rows, columns].astype(np.int32)
        return pa.table({"_g": table["_g"].combine_chunks().take(pa.array(qs)), "_id": ids.take(pa.array(qs)), "_x": ids.take(pa.array(xs)), "_c": pa.array(cosine), "rank": pa.array(rank)})

    schema = f"_g {group_type}, _id {id_type}, _x {id_type}, _c double, rank int"
    within = small.groupBy(*units).applyInArrow(run, schema)
    best = Window.partitionBy("_g", "_id").orderBy(F.desc("_c"), F.asc("_x"))
    parts = items.unionByName(asked).groupBy(*units).applyInArrow(run, schema).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    firsts = large.groupBy("_g", "_v").agg(F.min("_id").alias("_first"))
    members = large.join(firsts, ["_g", "_v"]).select("_g", "_id", "_first")
    across = members.join(parts.select("_g", F.col("_id").alias("_first"), "_x", "_c"), ["_g", "_first"]).where(F.col("_id") != F.col("_x"))
    across = across.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return within.unionByName(across.select("_g", "_id", "_x", "_c", "rank")).select(F.col("_g").alias(group), F.col("_id").alias(key), F.col("_x").alias("neighbour"), F.col("_c").alias("cosine"), "rank")


def similar_pairs(neighbours: DataFrame, key: str, least: float) -> DataFrame:
    """(chunk_a, chunk_b), the smaller first: pairs of a cosine of at least ``least`` where one is among the other's nearest."""
    return neighbours.where(F.col("cosine") >= least).select(F.least(key, "neighbour").alias("chunk_a"), F.greatest(key, "neighbour").alias("chunk_b")).distinct()

"""Exact matching inside scopes by blocks: cosine of many with many, and many words in many texts.

Both would be a product of all queries with all rows of a scope. Here a scope is cut into blocks of
bounded size on either side, and each pair of blocks is one task's work on whole arrays: a matrix
product, or one automaton over all words. What leaves a task is its best rows or its matches only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # slower, but the same matches
    ahocorasick = None

DIGITS = 6
#: Most rows of a block: items or texts, queries or words.
ITEMS, QUERIES = 8192, 16_384
#: Queries multiplied at once.
STRIP = 1024


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of equal width, and their own lengths; null vectors have length 0, null numbers count as 0."""
    rows = vectors.to_pylist() if vectors.null_count or vectors.values.null_count else None
    sizes = np.diff(vectors.offsets.to_numpy()) if rows is None else np.array([len(r) if r else 0 for r in rows])
    if rows is None and len(sizes) and (sizes == sizes[0]).all():
        return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1), sizes
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    for i, row in enumerate(vectors.to_pylist() if rows is None else rows):
        if row:
            out[i, : len(row)] = [0.0 if x is None else x for x in row]
    return out, sizes


def _cosines(a: np.ndarray, sa: np.ndarray, b: np.ndarray, sb: np.ndarray) -> np.ndarray:
    """Clamped cosines; 0 for unlike lengths and zero vectors."""
    wide = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (a, b))
    with np.errstate(all="ignore"):
        size = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)
        value = np.clip(np.nan_to_num((a @ b.T) / size, nan=1.0), 0.0, 1.0)
    return np.where((sa[:, None] == sb) & (size != 0), value, 0.0)


def in_blocks(queries: DataFrame, rows: DataFrame, key: str, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What work makes of each block of queries (scope, query_id, …) with each block of rows (scope, key, …) of the same scope."""
    parts = lambda df, most, name: df.groupBy("scope").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    cuts = parts(rows, ITEMS, "_nr").join(parts(queries, QUERIES, "_nq"), "scope")
    own = lambda c, n: F.expr(f"cast(pmod(xxhash64({c}), {n}) as int)")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = rows.join(cuts, "scope").withColumns({"_r": own(key, "_nr"), "_asks": F.lit(False)}).withColumn("_q", every("_nq")).drop("_nr", "_nq")
    asked = queries.join(cuts, "scope").withColumns({"_q": own("query_id", "_nq"), "_asks": F.lit(True)}).withColumn("_r", every("_nr")).drop("_nr", "_nq")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        return work(table.filter(table["_asks"]).combine_chunks(), table.filter(pc.invert(table["_asks"])).sort_by(key).combine_chunks())

    return held.unionByName(asked, allowMissingColumns=True).groupBy("scope", "_r", "_q").applyInArrow(run, schema)


def firsts(seen: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Which of each row's values are its k greatest, of equal ones the first; k is a column. -inf is never among them."""
    most = min(int(k.max(initial=1)), seen.shape[1])
    top = -np.sort(-np.partition(seen, seen.shape[1] - most, axis=1)[:, seen.shape[1] - most :], axis=1)
    floor = np.take_along_axis(top, np.minimum(k, most) - 1, axis=1)
    above, level = seen > floor, seen == floor
    return (above | level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True))) & (seen > -np.inf)


def _array(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def cosine_top(queries: DataFrame, corpus: DataFrame, query_vector: str, vector: str, others: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, top_k): of each query and block of its scope, the top_k chunks of the highest clamped cosine.

    The best of the whole scope are among them, ties by the smaller chunk_id on rounded scores
    included. With others, a query doesn't meet the row of its own id.
    """
    id_of, key = corpus.schema["chunk_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    wide = lambda v: F.col(v).cast("array<double>").alias("_v")

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        ks = q["top_k"].to_numpy()
        rows, columns, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if q.num_rows and c.num_rows:
            (a, sa), (b, sb) = _matrix(_array(q["_v"])), _matrix(_array(c["_v"]))
            same = np.array(q["query_id"].to_pylist(), dtype=object)[:, None] == np.array(c["chunk_id"].to_pylist(), dtype=object) if others else None
            for at in range(0, q.num_rows, STRIP):
                raw = _cosines(a[at : at + STRIP], sa[at : at + STRIP], b, sb)
                seen = np.round(raw, DIGITS)
                if same is not None:
                    seen[same[at : at + STRIP]] = -np.inf
                r, x = np.nonzero(firsts(seen, ks[at : at + STRIP, None]))
                rows.append(at + r)
                columns.append(x)
                scores.append(raw[r, x])
        r, x = pa.array(np.concatenate(rows)), pa.array(np.concatenate(columns))
        return pa.table({"query_id": q["query_id"].take(r), "chunk_id": c["chunk_id"].take(x), "score": pa.array(np.concatenate(scores)), "top_k": q["top_k"].take(r)})

    asked = queries.select("scope", "query_id", F.col("top_k").cast("int").alias("top_k"), wide(query_vector))
    return in_blocks(asked, corpus.select("scope", "chunk_id", wide(vector)), "chunk_id", best, f"query_id {key}, chunk_id {id_of}, score double, top_k int")


def found_in(words: list[str], texts: list[str]) -> Iterator[tuple[int, str]]:
    """(place of a text, word) for the different words that each text holds anywhere."""
    automaton = None
    if ahocorasick is not None and words:
        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        automaton.make_automaton()
    for i, text in enumerate(texts):
        for w in {w for _, w in automaton.iter(text)} if automaton is not None else {w for w in words if w in text}:
            yield i, w


class Tokens:
    """The tokens of a block's queries, and how often each query has each: what texts and contents are counted with."""

    def __init__(self, tokens: list[list[str] | None]) -> None:
        self.place: dict[str, int] = {}
        rows, columns = [], []
        for i, words in enumerate(tokens):
            for w in words or ():
                rows.append(i)
                columns.append(self.place.setdefault(w, len(self.place)))
        self.times = np.zeros((len(tokens), max(1, len(self.place))), np.float32)
        np.add.at(self.times, (rows, columns), 1)

    def in_texts(self, texts: list[str]) -> np.ndarray:
        """Per query and text, how many of the query's tokens stand anywhere in the text; a last column of zeros for no text."""
        there = np.zeros((self.times.shape[1], len(texts) + 1), np.float32)
        for i, w in found_in(list(self.place), texts):
            there[self.place[w], i] = 1
        return self.times @ there

    def among(self, words: list[list[str] | None]) -> np.ndarray:
        """Per query and list of words, how many of the query's tokens are in the list."""
        there = np.zeros((self.times.shape[1], len(words)), np.float32)
        for i, some in enumerate(words):
            for w in some or ():
                if (at := self.place.get(w)) is not None:
                    there[at, i] = 1
        return self.times @ there


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(scope, id, needle): which needles (scope, needle) stand anywhere in which texts (scope, id, text).

    Repeated needles and repeated rows count once; null and empty needles and null texts have no match.
    """
    words = needles.where(F.coalesce("needle", F.lit("")) != "").select("scope", "needle").distinct()
    rows = texts.where(F.col("text").isNotNull()).select("scope", "id", "text")
    cuts = rows.groupBy("scope").agg(F.ceil(F.count("*") / ITEMS).cast("int").alias("_n")).join(words.select("scope").distinct(), "scope")
    kind = texts.schema["id"].dataType.simpleString()
    scope = texts.schema["scope"].dataType.simpleString()
    held = rows.join(cuts, "scope").select("scope", F.expr("cast(pmod(xxhash64(id), _n) as int)").alias("_b"), "id", F.col("text").alias("_s"), F.lit(False).alias("_needle"))
    sought = words.join(cuts, "scope").select("scope", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_b"), F.lit(None).cast(kind).alias("id"), F.col("needle").alias("_s"), F.lit(True).alias("_needle"))

    def find(table: pa.Table) -> pa.Table:
        read = table.filter(pc.invert(table["_needle"]))
        got = sorted(found_in(table.filter(table["_needle"])["_s"].to_pylist(), read["_s"].to_pylist()))
        at, found = [i for i, _ in got], [w for _, w in got]
        where = pa.array(at, pa.int64())
        return pa.table({"scope": read["scope"].take(where), "id": read["id"].take(where), "needle": pa.array(found, pa.string())})

    return held.unionByName(sought).groupBy("scope", "_b").applyInArrow(find, f"scope {scope}, id {kind}, needle string").distinct()

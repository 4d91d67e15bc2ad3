"""Top-N, fusion, packing and nearest vectors, against brute force and with dirt in every column."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import fusion, knn, packing, topn
from weft.llm.tables import current_chunks, usable_hits

HITS = "hit_id long, query_id long, namespace string, leg string, chunk_id string, score double, rank string, _bucket string"


def hits(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        q = 1 if rng.random() < 0.4 else rng.randint(2, 40)
        leg = rng.choice(["dense", "lexical", "structure", "graph"])
        score = rng.choice([None, math.nan, -3.5, 0.0, -0.0, 1e300, math.inf, -math.inf]) if rng.random() < 0.03 else round(rng.random() * {"dense": 1, "lexical": 20, "structure": 5, "graph": 1}[leg], 2)
        rows.append((i, q if rng.random() > 0.02 else None, rng.choice("ab") if rng.random() > 0.02 else None, leg if rng.random() > 0.02 else None, f"c{rng.randint(0, 90)}" if rng.random() > 0.02 else None, score, "x", "y"))
    return spark.createDataFrame(rows + rows[:100], HITS), rows


def usable(rows):
    best = {}
    for _, q, ns, leg, c, s, *_ in rows:
        if None in (q, ns, leg, c, s) or math.isnan(s):
            continue
        best[q, ns, leg, c] = max(s, best.get((q, ns, leg, c), -math.inf))
    return best


@pytest.mark.parametrize("n", [1, 5, 40])
def test_top_n_equals_sorting(spark, n):
    df, rows = hits(spark)
    groups = defaultdict(list)
    for (q, ns, leg, c), s in usable(rows).items():
        groups[ns, q, leg].append((-s, c))
    want = {(*k, c, i) for k, v in groups.items() for i, (_, c) in enumerate(sorted(v)[:n], 1)}
    got = topn.top_n(df, ["namespace", "query_id", "leg"], "chunk_id", "score", n)
    assert {(r.namespace, r.query_id, r.leg, r.chunk_id, r["rank"]) for r in got.collect()} == want
    assert topn.top_n(df.where("false"), ["leg"], "chunk_id", "score", n).isEmpty()


def test_floor_is_used_and_safe(spark):
    df = spark.createDataFrame([("g", f"i{i % 50}", float(i % 50)) for i in range(2000)] + [("tie", f"t{i:04}", 1.0) for i in range(500)], "g string, item string, score double")
    slim = df.selectExpr("g as _k0", "item as _item", "score as _score").withColumn("_bucket", topn.score_bucket(F.col("_score")))
    floors = {r._k0: r._floor for r in topn.thresholds(slim, ["_k0"], 5).collect()}
    assert set(floors) == {"g", "tie"} and floors["g"] > topn.DOUBLINGS // 2 * topn.RESOLUTION
    got = topn.top_n(df, ["g"], "item", "score", 5).collect()
    assert sorted(r.item for r in got if r.g == "tie") == [f"t{i:04}" for i in range(5)]
    with pytest.raises(ValueError):
        topn.top_n(df, ["g"], "item", "score", 0)


@pytest.mark.parametrize(("low", "high"), [(0.016, 0.033), (0.9, 1.0), (-1e-9, -5e-10), (1e12, 1.5e12)])
def test_floor_cuts_narrow_scales(spark, low, high):
    """Whatever the scale, nine tenths of a large group go before anything is sorted."""
    df = spark.range(20000).select(F.lit("g").alias("_k0"), F.col("id").cast("string").alias("_item"), (low + (high - low) * F.rand(3)).alias("_score")).withColumn("_bucket", topn.score_bucket(F.col("_score")))
    floor = topn.thresholds(df, ["_k0"], 5).first()._floor
    assert 5 <= df.where(F.col("_bucket") >= floor).count() < 2000


def test_buckets_keep_the_order(spark):
    values = sorted([0.0, 1e-308, 5e-324, 1e-9, 0.1, 0.2, 0.99, 0.991, 1.0, 3.0, 1e9, 1e308, math.inf])
    values = sorted([-v for v in values] + values)
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", topn.score_bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert got == sorted(got) and len(set(got)) > len(values) - 5


def test_places_and_borda(spark):
    df, rows = hits(spark, 1500)
    legs = {"dense": 1.0, "lexical": 2.0, "structure": 1.0, "graph": 1.0}
    best = defaultdict(dict)
    for (q, _, leg, c), s in usable(rows).items():
        best[q, leg][c] = max(s, best[q, leg].get(c, -math.inf))
    want, places = {}, defaultdict(dict)
    for q in {k[0] for k in best}:
        items = {c for leg in legs for c in best.get((q, leg), {})}
        points = dict.fromkeys(items, 0.0)
        for leg, w in legs.items():
            scores = best.get((q, leg), {})
            for c in items:
                if c in scores:
                    above, same = sum(s > scores[c] for s in scores.values()), sum(s == scores[c] for s in scores.values())
                    mean = above + (same + 1) / 2
                    places[q, c][leg] = above + 1
                else:
                    mean = (len(scores) + 1 + len(items)) / 2
                points[c] += w * (len(items) - mean)
        for i, c in enumerate(sorted(items, key=lambda c: (-round(points[c], 6), c)), 1):
            want[q, c] = (i, points[c])
    got = {(r.query_id, r.chunk_id): (r["rank"], r.points) for r in fusion.borda(usable_hits(df), legs).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][1] - want[k][1]) < 1e-6 for k in got)
    assert sum(got[k][0] != want[k][0] for k in got) == 0
    good = defaultdict(list)
    for (q, c), p in places.items():
        if len(p) == 4 and max(p.values()) <= 3:
            good[q].append(c)
    assert {(r.query_id, r.chunk_id) for r in fusion.unanimous_first(usable_hits(df), legs).collect()} == {(q, c[0]) for q, c in good.items() if len(c) == 1}
    assert fusion.borda(usable_hits(df).where("false"), legs).isEmpty()
    with pytest.raises(ValueError):
        fusion.borda(df, {})


def test_no_leg_dominates(spark):
    df = spark.createDataFrame([(1, "a", "small", 0.9), (1, "b", "small", 0.1), (1, "a", "huge", 1.0), (1, "b", "huge", 1e9), (1, "a", "third", 2.0), (1, "b", "third", 1.0)], "query_id long, chunk_id string, leg string, score double")
    assert fusion.borda(df, {"small": 1.0, "huge": 1.0, "third": 1.0}).where("rank = 1").first().chunk_id == "a"


def test_best_fit_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.randint(1, 40)
        sizes = [rng.randint(0, capacity) for _ in range(rng.randint(0, 80))]
        rooms: list[int] = []
        for s in sorted(sizes, reverse=True):
            fit = [r for r in rooms if r >= s]
            if s and fit:
                rooms[rooms.index(min(fit))] -= s
            elif s:
                rooms.append(capacity - s)
        boxes = packing.best_fit_decreasing(sizes, capacity)
        left = [capacity] * (max(boxes, default=-1) + 1)
        for s, b in zip(sizes, boxes):
            assert (b < 0) == (s == 0)
            if s:
                left[b] -= s
        assert sorted(left) == sorted(rooms)
    with pytest.raises(ValueError):
        packing.best_fit_decreasing([5], 4)


def test_pack_table(spark):
    df = spark.createDataFrame([(1, 10, "s"), (2, 0, "s"), (3, None, "s"), (4, 2500, "s"), (None, 7, "s"), (1, 10, "s")], "id long, n int, shard string")
    got = packing.pack(df, "id", "n", 1024, 2).collect()
    assert sorted((r.id or 0, r.part, r.first, r.n_tokens) for r in got) == [(0, 0, 0, 7), (1, 0, 0, 10), (1, 0, 0, 10), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 1024), (4, 1, 1024, 1024), (4, 2, 2048, 452)]
    assert all((r.container is None) == (r.n_tokens == 0) for r in got)
    fill = defaultdict(int)
    for r in got:
        if r.n_tokens:
            fill[r.shard, r.container] += r.n_tokens
    assert max(fill.values()) <= 1024
    assert packing.pack(df.where("false"), "id", "n", 8, 1).isEmpty()


def vectors(n=600, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 64))
    base[n // 2 :] = base[: n - n // 2] + 0.25 * rng.standard_normal((n - n // 2, 64))
    return base * rng.uniform(0.1, 5, (n, 1))


@pytest.mark.parametrize("settings", [knn.Settings(), knn.Settings(unit=150, probes=12, scan=64), knn.Settings(unit=40, probes=16, scan=32, cells=16)])
def test_recall(spark, settings):
    v = vectors()
    rows = [("big" if i % 5 else "small", f"v{i}", [float(x) for x in v[i]], "junk") for i in range(len(v))]
    dirt = [("big", "n1", None, ""), ("big", "n2", [], ""), ("big", "n3", [0.0] * 64, ""), ("big", "n4", [float("nan")] + [1.0] * 63, ""), ("big", "n5", [1.0] * 63, ""), (None, "n6", [1.0] * 64, ""), ("alone", "n7", [1.0] * 64, ""), ("big", "n8", [float("inf")] * 64, "")]
    df = spark.createDataFrame(rows + dirt, "ns string, id string, vec array<float>, cosine string")
    got = knn.nearest(df, "ns", "id", "vec", settings=settings).collect()
    assert not {r.id for r in got} & {f"n{i}" for i in range(1, 9)}
    mine = defaultdict(set)
    for r in got:
        mine[r.id].add(r.neighbour)
    unit = knn.unit_length(np.array([r[2] for r in rows], dtype=np.float32))
    hit = total = close = found = 0
    for i, (ns, key, _, _) in enumerate(rows):
        others = [j for j in range(len(rows)) if rows[j][0] == ns and j != i]
        top = sorted(others, key=lambda j: (-round(float(unit[i] @ unit[j]), 12), rows[j][1]))[:5]
        total += len(top)
        hit += len({rows[j][1] for j in top} & mine[key])
        near = {rows[j][1] for j in top if unit[i] @ unit[j] >= 0.9}
        close += len(near)
        found += len(near & mine[key])
    assert found == close and hit / total >= (0.97 if settings == knn.Settings() else 0.6)


def test_equal_vectors_and_empty(spark):
    df = spark.createDataFrame([("n", f"v{i}", [1.0] * 64) for i in range(8)], "ns string, id string, vec array<float>")
    got = knn.nearest(df, "ns", "id", "vec").where("id = 'v0'").orderBy("rank").collect()
    assert [r.neighbour for r in got] == ["v1", "v2", "v3", "v4", "v5"] and got[0].cosine == pytest.approx(1)
    assert knn.nearest(df.where("false"), "ns", "id", "vec").isEmpty()
    assert knn.similar_pairs(knn.nearest(df, "ns", "id", "vec"), "id", 0.9).where("chunk_a >= chunk_b").isEmpty()


def brute_force(rows, k=5):
    unit = knn.unit_length(np.array([r[2] for r in rows], dtype=np.float32))
    cosine = np.round(unit @ unit.T, 12)
    return {r[1]: [rows[j][1] for j in sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-cosine[i, j], rows[j][1]))[:k]] for i, r in enumerate(rows)}


@pytest.mark.parametrize("settings", [knn.Settings(), knn.Settings(unit=1500, probes=256), knn.Settings(block=700)])
def test_recall_in_a_large_group(spark, settings):
    v = np.random.default_rng(7).standard_normal((4000, 64)).astype(np.float32)
    rows = [("n", f"v{i:04}", [float(x) for x in v[i]]) for i in range(len(v))]
    got = defaultdict(set)
    for r in knn.nearest(spark.createDataFrame(rows, "ns string, id string, vec array<float>"), "ns", "id", "vec", settings=settings).collect():
        got[r.id].add(r.neighbour)
    unit = knn.unit_length(v)
    asked = range(0, 4000, 8)
    top = {i: [j for j in np.argsort(-(unit @ unit[i])) if j != i][:5] for i in asked}
    assert sum(len(got[rows[i][1]] & {rows[j][1] for j in top[i]}) for i in asked) >= 0.9 * 5 * len(asked)


@pytest.mark.parametrize("settings", [knn.Settings(), knn.Settings(unit=60, probes=64)])
def test_many_equal_vectors(spark, settings):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(64)
    kinds = [base, base + 0.1 * rng.standard_normal(64), *rng.standard_normal((40, 64))]
    copies = [100, 70, *[1] * 40]
    names = [f"v{i:03}" for i in rng.permutation(sum(copies))]
    rows = [("n", names.pop(), [float(np.float32(x)) for x in kind]) for kind, n in zip(kinds, copies) for _ in range(n)]
    got = knn.nearest(spark.createDataFrame(rows, "ns string, id string, vec array<float>"), "ns", "id", "vec", settings=settings).orderBy("id", "rank").collect()
    found = defaultdict(list)
    for r in got:
        found[r.id].append(r.neighbour)
    assert found == brute_force(rows)


def test_current_version(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("a", 2, "new"), ("b", None, "x"), (None, 3, "y"), ("c", 1, None)], "chunk_id string, ingested_at int, content string")
    assert {(r.chunk_id, r.content) for r in current_chunks(df, "content").collect()} == {("a", "new"), ("b", "x"), ("c", None)}

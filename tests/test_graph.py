import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weft.functions.vectors import DIMENSION, _counts, token_bucket
from weft.operators import community as C
from weft.operators import graph as G
from weft.queries import graphs

NODES = "entity_id string, name string, type string, description string, source_chunk_ids array<string>"
EDGES = "relation_id string, source string, target string, relation string, description string, weight double, source_chunk_ids array<string>"


def chain(spark):
    nodes = spark.createDataFrame([(f"t:{x}", x, "t", "", [f"c{x}"]) for x in "abcd"], NODES)
    edges = spark.createDataFrame([(f"{a}{b}", f"t:{a}", f"t:{b}", "r", "", 1.0, ["c"]) for a, b in ("ab", "bc", "cd")], EDGES)
    return nodes, edges


def test_neighbourhood(spark):
    nodes, edges = chain(spark)
    seeds = spark.createDataFrame([(1, "t:a"), (1, "t:zz")], "query_id long, entity_id string")
    assert {(r.entity_id, r.depth) for r in G.neighbourhood(seeds, edges, nodes, 1).collect()} == {("t:a", 0), ("t:b", 1)}
    assert {r.entity_id for r in G.neighbourhood(seeds, edges, nodes, 5).collect()} == {"t:a", "t:b", "t:c"}
    assert G.induced_edges(G.neighbourhood(seeds, edges, nodes, 2), edges).count() == 2


def test_merge_and_removal(spark):
    a = spark.createDataFrame([("t:a", "A", "t", "one", ["c1"])], NODES)
    b = spark.createDataFrame([("t:a", "A2", "t", "two", ["c2"]), ("t:b", "B", "t", "", ["c1", "c2"])], NODES)
    got = {r.entity_id: r for r in G.merge_entities(a, b).collect()}
    assert got["t:a"].source_chunk_ids == ["c1", "c2"] and got["t:a"].description == "one; two" and got["t:a"].name == "A"
    gone = spark.createDataFrame([("c1",)], "chunk_id string")
    assert {r.entity_id: r.source_chunk_ids for r in G.remove_sources(a.unionByName(b.where("entity_id = 't:b'")), gone).collect()} == {"t:b": ["c2"]}


def test_paths(spark):
    edges = spark.createDataFrame([("ad", "a", "d", "r", "", 5.0, ["x"]), ("ab", "a", "b", "r", "", 1.0, ["y"]), ("bd", "b", "d", "r", "", 1.0, ["z"])], EDGES)
    pairs = spark.createDataFrame([(1, "a", "d")], "query_id long, a string, b string")
    got = G.rank_paths(pairs, edges).orderBy("rank").collect()
    assert [(r.entities, r.score) for r in got] == [(["a", "d"], 5.0), (["a", "b", "d"], 0.5)]


def test_canonical(spark):
    e = spark.createDataFrame([(2, "ada ", "p", "later", ["c2"]), (1, "Ada", "p", "first", ["c1"]), (3, None, "p", None, None), (4, "Ada", "q", None, ["c3"])], "entity_id long, name string, type string, description string, source_chunk_ids array<string>")
    nodes = G.canonical_entities(e)
    got = {r.entity_id: r for r in nodes.collect()}
    assert got["p:ada"].name == "Ada" and got["p:ada"].description == "first; later" and got["p:ada"].source_chunk_ids == ["c1", "c2"] and len(got) == 2
    r = spark.createDataFrame([(1, "ADA", "ada", "knows", None, None, ["c"]), (2, "Ada", "nobody", "knows", "", 1.0, ["c"])], "relation_id long, source string, target string, relation string, description string, weight double, source_chunk_ids array<string>")
    assert [x.relation_id for x in G.canonical_relations(r, nodes).collect()] == ["q:ada::knows::q:ada"]


def test_gazetteer(spark):
    chunks = spark.createDataFrame([("1", "Ada Lovelace met Babbage"), ("2", None)], "chunk_id string, content string")
    terms = spark.createDataFrame([("ada lovelace", "p"), ("Babbage", "p"), ("", "p")], "name string, type string")
    found = G.gazetteer_entities(chunks, terms)
    assert found.count() == 2 and [(r.source, r.target) for r in G.co_occurrences(found).collect()] == [("Babbage", "ada lovelace")]


def test_components_and_resolution(spark):
    n = 40
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(n)] + [("x", "y"), ("z", "z")], "a string, b string")
    got = {r.node: r.component for r in G.components(edges).collect()}
    assert all(got[f"{i:03}"] == "000" for i in range(n + 1)) and got["y"] == "x" and got["z"] == "z"
    e = spark.createDataFrame([("org", "Acme Data"), ("org", "acme data"), ("org", "acme data data acme"), ("person", "Acme Data"), ("org", "Other")], "type string, name string")
    res = {(r.type, r.name): r.canonical for r in G.resolve(e).collect()}
    assert res["org", "Acme Data"] == "acme data data acme" and res["person", "Acme Data"] == "Acme Data" and res["org", "Other"] == "Other"


def test_resolution_compares_every_pair_of_a_type(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    names = sorted({*words, *(" ".join(rng.choices(words, k=rng.randint(2, 12))) for _ in range(140)), "\u4e2d", "\u6587"})
    rows = [(t, n) for i, n in enumerate(names) for t in ("x", "y") if t == "x" or i % 3]
    for threshold in (0.92, 0.7):
        got = {(r.type, r.name): r.canonical for r in G.resolve(spark.createDataFrame(rows, "type string, name string"), threshold).collect()}
        want = {}
        for t in ("x", "y"):
            own = [n for k, n in rows if k == t]
            v = _counts(pd.Series(own), DIMENSION)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            label = np.arange(len(own))
            for i, j in zip(*np.nonzero(np.round(v @ v.T, 6) >= threshold)):
                label[label == label[i]] = label[j]
            for i, n in enumerate(own):
                want[t, n] = min((own[j] for j in np.nonzero(label == label[i])[0]), key=lambda m: (-len(m.encode()), m))
        assert got == want


def test_estimated_sizes_stay_small_over_rounds(spark):
    edges = spark.createDataFrame([(f"{i:04}", f"{i + 1:04}") for i in range(300)], "a string, b string")
    linked = G.components(edges)
    assert linked._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 64
    assert {r.component for r in linked.collect()} == {"0000"}


def test_resolution_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "KINDS", 16)
    test_resolution_compares_every_pair_of_a_type(spark)


def test_rewritten_relations_have_small_estimates(spark, tmp_path):
    words = list({token_bucket(f"w{i}"): f"w{i}" for i in range(99)}.values())[:10]
    names = [" ".join([a] * m + [b] * n) for a, b in zip(words, words[1:]) for m, n in ((5, 1), (5, 3), (5, 5), (3, 5), (1, 5))]
    rows = [(i, f" {n}", "t", "", ["c"]) for i, n in enumerate([*names, *names, "other"])]
    spark.createDataFrame(rows, "entity_id long, name string, type string, description string, source_chunk_ids array<string>").write.parquet(f"{tmp_path}/entities.parquet")
    ends = [(1, f"{names[0]} ", "other"), (1, f"{names[0]} ", "other"), (2, None, names[-1]), (3, "gone ", " ")]
    spark.createDataFrame([(i, "n", s, t, None) for i, s, t in ends], "relation_id long, namespace string, source string, target string, description string").write.parquet(f"{tmp_path}/relations.parquet")
    got = graphs.resolve_rewrite(spark, str(tmp_path))
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 2000
    head = min(names, key=lambda n: (-len(n), n))
    assert sorted((r.relation_id, r.source, r.target) for r in got.collect()) == [(1, head, "other"), (2, None, head), (3, "gone ", " ")]


def graph_of(pairs):
    g = {}
    for a, b, w in pairs:
        for x, y in ((a, b), (b, a)):
            g.setdefault(x, {})
            g[x][y] = g[x].get(y, 0) + w
    return g


TRIANGLES = [("a1", "a2", 1.0), ("a2", "a3", 1.0), ("a1", "a3", 1.0), ("b1", "b2", 1.0), ("b2", "b3", 1.0), ("b1", "b3", 1.0), ("a1", "b1", 1.0)]


def test_two_clusters(spark):
    labels = C.propagate_labels(graph_of(TRIANGLES))
    assert len({labels[x] for x in ("a1", "a2", "a3")}) == 1 and labels["a1"] != labels["b1"]
    nodes = spark.createDataFrame([("n", x) for x in labels], "namespace string, entity_id string")
    rows = [(a, b, w) for a, b, w in TRIANGLES]
    adj = spark.createDataFrame([("n", *r) for r in rows] + [("n", b, a, w) for a, b, w in rows], "namespace string, entity_id string, neighbour string, weight double")
    edges = spark.createDataFrame([("n", f"{a}{b}", a, b) for a, b, _ in rows], "namespace string, relation_id string, source string, target string")
    got = {r.community_id: r for r in C.communities(C.detect(nodes, adj, "labels"), edges).collect()}
    assert set(got) == {"L0-a1", "L0-b1"} and all(len(r.relation_ids) == 3 for r in got.values())


def test_hierarchy(spark):
    pairs = [(f"{c}{i}", f"{c}{j}", 5.0) for c in "abcd" for i, j in ((1, 2), (2, 3), (1, 3))] + [("a1", "b1", 2.0), ("c1", "d1", 2.0), ("b3", "c3", 1.0)]
    levels = C.louvain(graph_of(pairs))
    assert len(levels) >= 2 and len(set(levels[0].values())) == 4
    for low, high in zip(levels, levels[1:]):
        assert all(len({high[n] for n in low if low[n] == c}) == 1 for c in set(low.values()))
    assert C.louvain({}) == [] and C.louvain({"x": {}}) == [{"x": "x"}]
    assert C.louvain(graph_of(pairs[::-1])) == levels


def test_hash_and_stale(spark):
    import hashlib

    t = spark.createDataFrame([("n", "L0-a", ["b", "a"], ["r"])], "namespace string, community_id string, entity_ids array<string>, relation_ids array<string>")
    want = hashlib.sha256(b"a\x1fb\x1f\x1er\x1f").hexdigest()
    assert C.content_hash(t).first().content_hash == want
    reports = spark.createDataFrame([("n", "L0-a", want)], "namespace string, community_id string, content_hash string")
    assert C.stale(t, reports).isEmpty() and C.stale(t, reports.where("false")).count() == 1


def test_adjacency(spark):
    nodes, edges = chain(spark)
    more = spark.createDataFrame([("x", "t:a", "t:b", "s", "", -1.0, []), ("y", "t:a", "t:a", "s", "", 1.0, []), ("z", "t:a", "gone", "s", "", 1.0, [])], EDGES)
    got = {(r.entity_id, r.neighbour): r.weight for r in G.adjacency(edges.unionByName(more), nodes).collect()}
    assert got["t:a", "t:b"] == got["t:b", "t:a"] == 2.0 and ("t:a", "t:a") not in got and len(got) == 6
    with pytest.raises(ValueError):
        C.detect(nodes, edges, "other")
    assert nodes.select(F.count("*")).first()[0] == 4

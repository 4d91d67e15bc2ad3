import pytest
from pyspark.sql import functions as F

from weft.functions.vectors import cosine, hash_embedding, token_bucket
from weft.operators import retrieve as R

CORPUS = "chunk_id string, scope string, doc_id string, title string, section_path array<string>, heading string, content string"
QUERIES = "query_id long, scope string, query_text string, top_k int"


def corpus(spark, *contents, scope="a"):
    return spark.createDataFrame([(f"c{i}", scope, f"d{i}", None, None, None, c) for i, c in enumerate(contents)], CORPUS)


def ask(spark, *texts, scope="a", k=5):
    return spark.createDataFrame([(i, scope, t, k) for i, t in enumerate(texts)], QUERIES)


def order(df):
    return [r.chunk_id for r in df.orderBy("query_id", "rank").collect()]


def test_term_frequency_first(spark):
    c = corpus(spark, "kafka introduction overview guide notes", "kafka kafka kafka streaming pipeline")
    assert order(R.lexical_top(ask(spark, "kafka"), c)) == ["c1", "c0"]


def test_rare_term_outranks_common(spark):
    c = corpus(spark, "common words here", "common quasar here", "common words there", "common things there")
    assert order(R.lexical_top(ask(spark, "common quasar"), c))[0] == "c1"


def test_short_text_first(spark):
    c = corpus(spark, "vector search index and a lot of padding that goes on and on", "vector search index")
    assert order(R.lexical_top(ask(spark, "vector index"), c)) == ["c1", "c0"]


def test_scopes_are_apart_and_empty_is_empty(spark):
    c = corpus(spark, "same text").unionByName(spark.createDataFrame([("z", "b", "d", None, None, None, "same text"), ("n", "b", "d", None, None, None, None)], CORPUS))
    assert order(R.lexical_top(ask(spark, "text", scope="b"), c)) == ["z"]
    assert R.lexical_top(ask(spark, "absent"), c).isEmpty()
    assert R.lexical_top(ask(spark, "text").where("false"), c).isEmpty()


def test_hash_embedding_and_cosine(spark):
    assert token_bucket("kafka") == token_bucket("kafka") and 0 <= token_bucket("kafka") < 32
    row = spark.createDataFrame([("Kafka kafka, Zürich", "")], "a string, b string").select(hash_embedding(F.col("a")).alias("x"), hash_embedding(F.col("b")).alias("y")).first()
    assert abs(sum(v * v for v in row.x) - 1) < 1e-9 and not any(row.y)
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_fusion_and_attribution(spark):
    rows = lambda *ids: spark.createDataFrame([(0, c, 1.0, i + 1) for i, c in enumerate(ids)], "query_id long, chunk_id string, score double, rank int")
    got = {r.chunk_id: r for r in R.fuse({"dense": rows("x", "y"), "lexical": rows("y")}, ask(spark, "q")).collect()}
    assert got["y"].rank == 1 and (got["y"].dense_rank, got["y"].lexical_rank, got["x"].lexical_rank) == (2, 1, 0)
    assert got["y"].score == round(1 / 62 + 1 / 61, 6)


def test_auto_route(spark):
    rows = [("doc1:0", "a", "doc1", "Cities", ["Cities", "Travel"], "Travel", "museums and trains"), ("doc1:1", "a", "doc1", "Cities", ["Cities", "History"], "History", "old walls")]
    c = spark.createDataFrame(rows, CORPUS)
    q = ask(spark, "travel museums")
    found = R.route_candidates(q, c).collect()
    assert found[0].path == ["Cities", "Travel"] and found[0].confidence == 1.0
    plan = R.plan_routes(R.route_candidates(q, c))
    assert order(R.route_fanout(q, c, plan)) == ["doc1:0"]


@pytest.mark.parametrize(("gap", "fanout", "mode", "n"), [(0.2, 3, "converged", 1), (0.5, 3, "fanout", 2), (0.0, 1, "fanout", 1)])
def test_gap_plan(spark, gap, fanout, mode, n):
    c = spark.createDataFrame([(1, "a", ["x"], 1.0, 1), (1, "a", ["y"], 0.7, 2), (1, "a", ["z"], 0.1, 3)], "query_id long, scope string, path array<string>, confidence double, place int")
    got = R.plan_routes(c, gap=gap, fanout=fanout).collect()
    assert {r["mode"] for r in got} == {mode} and len(got) == n


def test_multi_hop_splits(spark):
    got = R.sub_questions(ask(spark, "who wrote it AND when was it", "a and bc", "plain")).orderBy("query_id", "order").collect()
    assert [r.query_text for r in got] == ["who wrote it", "when was it", "a and bc", "plain"]


def test_structure_and_fallback(spark):
    rows = [("a:0", "a", "a", "Guide", ["Setup", "Disk"], "Disk", "use raid"), ("a:1", "a", "a", "Guide", ["Use"], "Use", "the disk"), ("a:2", "a", "a", "Guide", ["Use"], "Use", " ")]
    c = spark.createDataFrame(rows, CORPUS)
    got = {(r.query_id, r.chunk_id): r.score for r in R.structure(ask(spark, "disk", "raid"), c).collect()}
    assert got[0, "a:0"] == pytest.approx(2 * 2 + 0.4 + 1.5 + 0.7 + 0.5)
    assert (0, "a:1") not in got and got[1, "a:0"] == 0.5


def test_permuted_input_gives_the_same(spark):
    texts = [f"word{i % 3} word{i % 5} tail" for i in range(20)]
    c = corpus(spark, *texts)
    a = R.lexical_top(ask(spark, "word1 tail"), c).collect()
    b = R.lexical_top(ask(spark, "word1 tail"), c.orderBy(F.desc("chunk_id"))).collect()
    assert sorted(a) == sorted(b)


def test_prepare_queries(spark):
    raw = spark.createDataFrame([(1, "a", " hi ", None), (1, "a", " hi ", None), (2, "a", None, 3.0), (3, None, "x", 1.0), (4, "a", "  ", 1.0), (5, "a", "y", -1.0)], "query_id long, namespace string, query_text string, top_k double")
    assert sorted((r.query_id, r.query_text, r.top_k) for r in R.prepare_queries(raw).collect()) == [(1, "hi", 5), (5, "y", 5)]

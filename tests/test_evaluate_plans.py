import pytest
from pyspark.sql import functions as F

from weft.operators import evaluate as E
from weft.plans import graph_answer
from weft.plans.answer import Asker, Options, expand, retrieve_variants
from weft.plans.seams import BudgetExceeded, Usage, cached, echo, generate, retrying
from weft.sources import documents as S
from weft.streaming import ingest

CORPUS = "chunk_id string, scope string, doc_id string, title string, section_path array<string>, heading string, content string"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("cities:0", "a", "cities", "Cities", ["Cities"], "Cities", "Paris has museums and a long river. It is old. Trains go there."), ("food:0", "a", "food", "Food", [], None, "Bread and cheese are eaten in Paris."), ("noise:0", "b", "noise", "Noise", None, None, "Paris Paris Paris")]
    return spark.createDataFrame(rows, CORPUS)


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "a", "museums trains river Paris", 3), (2, "a", "zzz", 3)], "query_id long, scope string, query_text string, top_k int")


def test_f1_and_match(spark):
    df = spark.createDataFrame([("the the cat", ["the cat"]), ("The  Cat", ["the cat"]), ("", ["x"]), ("x", []), ("x", None)], "answer string, golds array<string>")
    rows = df.select(E.token_f1(F.col("answer"), F.col("golds")).alias("f"), E.exact_match(F.col("answer"), F.col("golds")).alias("m")).collect()
    assert [round(r.f, 6) for r in rows] == [0.8, 1.0, 0.0, 0.0, 0.0] and [r.m for r in rows] == [False, True, False, False, False]


def test_retrieval_scores(spark):
    hits = spark.createDataFrame([(1, "c1", "d1", 1), (1, "c2", "d2", 2), (1, "c3", "d2", 3)], "query_id long, chunk_id string, doc_id string, rank int")
    gold = spark.createDataFrame([(1, ["d2", "d9"], ["c9"]), (2, [], ["c1"])], "query_id long, gold_doc_ids array<string>, gold_chunk_ids array<string>")
    per = {r.query_id: r for r in E.retrieval_scores(hits, gold, 3).collect()}
    assert per[1].precision == pytest.approx(1 / 3) and per[1].recall == 0.5 and per[1].reciprocal_rank == 0.5 and not per[1].grounded
    assert per[2].recall is None and per[2].precision == 0
    empty = E.retrieval_metrics(E.retrieval_scores(hits, gold.where("false"), 3)).first()
    assert empty.queries == 0 and empty.precision is None


def test_directions(spark):
    a = spark.createDataFrame([("ExactMatch", 0.5), ("FollowupQueriesUsedMean", 1.0), ("Examples", 3.0), ("F1Token", None)], "metric string, value double")
    b = spark.createDataFrame([("ExactMatch", 0.5), ("FollowupQueriesUsedMean", 2.0), ("Examples", 4.0), ("F1Token", 1.0)], "metric string, value double")
    assert {r.metric: r.direction for r in E.compare_metrics(a, b).collect()} == {"ExactMatch": "unchanged", "FollowupQueriesUsedMean": "regressed", "Examples": "undefined", "F1Token": "undefined"}


def test_ask_single_round(spark, corpus, questions):
    got = {r.query_id: r for r in Asker(corpus, echo).ask(questions).collect()}
    assert got[1].answer == "Question: museums trains river Paris" and got[1].chunk_ids[0] == "cities:0" and got[1].stop_reason == "single"
    assert "noise:0" not in got[1].chunk_ids and got[2]["round"] == 1


def test_rule_stops_and_runs_out(spark, corpus, questions):
    got = {r.query_id: r for r in Asker(corpus, echo).ask(questions, Options(mode="rule", max_rounds=2, min_hits=1, min_score=0.03)).collect()}
    assert got[1].stop_reason == "satisfied" and got[1].rounds == 1 and got[2].stop_reason == "max_rounds" and got[2].rounds == 2


def test_model_rewrites_then_stops(spark, corpus, questions):
    def model(prompts):
        out = []
        for p in prompts:
            if "decision=<" not in p:
                out.append("an answer")
            else:
                out.append("decision=rewrite_and_continue\nrewrite=bread cheese")
        return out

    got = {r.query_id: r for r in Asker(corpus, model).ask(questions, Options(mode="model", max_rounds=3, allow_rewrite=True)).collect()}
    assert got[2].rounds == 2 and got[2].stop_reason == "evidence_unchanged" and got[2].chunk_ids[0] == "food:0"
    with pytest.raises(Exception, match="no valid decision"):
        Asker(corpus, echo).ask(questions, Options(mode="model", max_rounds=2)).collect()
    open_ = Asker(corpus, echo).ask(questions, Options(mode="model", max_rounds=2, fail_open=True)).collect()
    assert {r.stop_reason for r in open_} == {"decision_error"}


def test_grading_follow_up_and_best_round(spark, corpus, questions):
    grader = lambda ps: ["score=0.1" if "zzz" in p else "score=0.9" for p in ps]
    planner = lambda ps: ["1. bread\n2. cheese" for _ in ps]
    got = {r.query_id: r for r in Asker(corpus, echo, grader, planner).ask(questions, Options(mode="rule", max_rounds=2, min_hits=1, grade=True, selection="best", relevance_floor=0.4)).collect()}
    assert "food:0" in got[2].chunk_ids


def test_conversation_and_correction(spark, corpus, questions):
    turns = spark.createDataFrame([(1, 2, "assistant", "hello"), (1, 1, "user", "hi")], "query_id long, turn int, role string, content string")
    seen = []
    asker = Asker(corpus, echo)
    got = {r.query_id: r.question for r in asker.ask_conversation(turns, questions).collect()}
    assert got == {1: "Latest question: museums trains river Paris", 2: "zzz"} and not seen
    judge = lambda ps: ['{"groundedness": %s}' % (0.9 if "Question: museums" in p else 0.1) for p in ps]
    fixed = {r.query_id: r for r in Asker(corpus, echo, judge=judge).ask_corrected(questions).collect()}
    assert fixed[1].attempts == 1 and fixed[2].attempts == 3


def test_budget_cache_retry(spark, questions):
    with pytest.raises(BudgetExceeded):
        generate(questions, "query_text", echo, "r", usage=Usage(budget=1))
    usage = Usage()
    generate(questions.unionByName(questions), "query_text", echo, "r", usage=usage)
    assert usage.calls == 2 and usage.stages[0][0] == "generate"
    cache = spark.createDataFrame([(1, "old")], "query_id long, v string")
    rows, grown = cached(questions, "query_id", cache, "v", lambda df: df.select("query_id", F.lit("new").alias("v")))
    assert {(r.query_id, r.v) for r in rows.collect()} == {(1, "old"), (2, "new")} and grown.count() == 2
    waits, tries = [], iter([OSError(), OSError(), None])

    def call():
        if error := next(tries):
            raise error
        return 7

    assert retrying(call, 3, sleep=waits.append) == 7 and waits == [0.1, 0.2]


def test_expansion(spark, corpus, questions):
    q = questions.where("query_id = 1")
    model = lambda ps: ["1. Museums trains river paris\n2. art halls" for _ in ps]
    got = expand(q, model, variants=2).orderBy("order")
    assert [r.query_text for r in got.collect()] == ["museums trains river Paris", "art halls"]
    assert retrieve_variants(q, corpus, got).orderBy("rank").first().chunk_id == "cities:0"
    with pytest.raises(ValueError):
        expand(q, None, step_back=True)


def test_graph_answers(spark, questions):
    nodes = spark.createDataFrame([("t:paris", "Paris", "t", "a city", ["c1"]), ("t:bread", "Bread", "t", "", ["c2"])], "entity_id string, name string, type string, description string, source_chunk_ids array<string>")
    edges = spark.createDataFrame([("e", "t:paris", "t:bread", "eats")], "relation_id string, source string, target string, relation string")
    table = spark.createDataFrame([("a", "L0-t:bread", 0, ["t:bread", "t:paris"], ["e"])], "namespace string, community_id string, level int, entity_ids array<string>, relation_ids array<string>")
    none = spark.createDataFrame([], "namespace string, community_id string, content_hash string, title string, summary string")
    calls = []
    usage = Usage(observe=lambda s, c, t: calls.append((s, c)))
    model = lambda ps: ["Title: Paris\nfood" if "community; first" in p else "Score: 50\nbread" if "Community report" in p and "museums" in p else "Score: 0" if "Community report" in p else "local\nFollow-up: Bread" if "Answer in part" in p else "FINAL" for p in ps]
    reports = graph_answer.write_reports(table, nodes, edges, none, model, usage)
    assert reports.first().title == "Paris" and graph_answer.write_reports(table, nodes, edges, reports, model).count() == 1
    got = {r.query_id: r.answer for r in graph_answer.ask_global(questions, table, nodes, reports, model).collect()}
    assert got == {1: "FINAL", 2: graph_answer.NO_ANSWER}
    chunks = spark.createDataFrame([("c1", "P", "Paris text"), ("c2", "B", "Bread text")], "chunk_id string, title string, content string")
    drift = {r.query_id: r.answer for r in graph_answer.ask_drift(questions, table, nodes, edges, chunks, reports, model).collect()}
    assert drift[1] == "FINAL" and calls == [("report", 1)]


def test_sources(spark, tmp_path):
    path = tmp_path / "bench.jsonl"
    path.write_text('# note\n\n// more\n{"query": "a", "gold_answers": ["x"]}\n{"query": "b", "top_k": 3}\n')
    rows = {r["query"]: r.top_k for r in S.labelled_examples(spark, str(path)).collect()}
    assert rows == {"a": 3, "b": 3} and S.dataset_name(str(path)) == "bench"
    log = tmp_path / "log"
    S.append_feedback(str(log), "q", "a", ["c"])
    S.append_feedback(str(log), "q2", "a", [])
    assert len(log.read_text().splitlines()) == 2 and (log.stat().st_mode & 0o777) == 0o600
    text = S.encode_benchmark({"name": "n", "f1": float("nan")}, [{"query": "q"}])
    assert S.decode_benchmark(text, {"name", "f1"}, {"query"}) == ({"name": "n", "f1": None}, [{"query": "q"}])
    for bad in (text.replace("\n", "\n\n", 1), "{}", text.replace("query", "other")):
        with pytest.raises(ValueError):
            S.decode_benchmark(bad, {"name", "f1"}, {"query"})
    docs = S.from_function(spark, lambda: [{"id": "1", "content": "x"}])
    S.write_lines(docs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().id == "1"


def test_stream_equals_batch(spark, tmp_path):
    docs = [{"id": f"d{i}", "title": "T", "content": f"text {i} a@b.com", "source_id": f"s{i % 2}", "metadata": {"k": "v", "chunk_index": "9"}} for i in range(4)]
    table = S.static(spark, docs)
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    ingest.import_stream(stream, str(tmp_path / "t"), str(tmp_path / "cp"), "ns", redact=True).awaitTermination()
    got = ingest.current(spark, str(tmp_path / "t"))
    want = ingest.import_chunks(table, "ns", redact=True)
    key = lambda df: sorted((r.chunk_id, r.content, r.doc_id, tuple(sorted(r.metadata.items()))) for r in df.collect())
    assert key(got) == key(want) and got.first().content.endswith("[REDACTED:EMAIL]") and got.first().metadata["chunk_index"] == "0"
    S.static(spark, [{"id": "new", "content": "fresh", "source_id": "s0"}]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.import_stream(stream, str(tmp_path / "t"), str(tmp_path / "cp"), "ns", redact=True).awaitTermination()
    assert {r.doc_id for r in ingest.current(spark, str(tmp_path / "t")).collect()} == {"d1", "d3", "new"}

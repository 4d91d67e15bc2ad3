"""Block matching, routes around searches, imports with a graph, evaluators, reports, codecs and the tool."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import graph, match, report, retrieve
from weft.operators import evaluate as E
from weft.plans import evaluators, tools
from weft.plans.answer import Asker, Options, abstractive_compress, decompose, extract_graph
from weft.plans.seams import cached
from weft.sources import documents as S
from weft.streaming import ingest

CORPUS = "chunk_id string, scope string, doc_id string, title string, section_path array<string>, heading string, content string"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("doc1:0", "a", "doc1", "Cities", ["Cities", "Travel"], "Travel", "Museums and trains in the city."), ("doc1:1", "a", "doc1", "Cities", ["Cities", "History"], "History", "Museums are old and travel was slow."), ("doc2:0", "b", "doc2", "Food", None, None, None)]
    return spark.createDataFrame(rows, CORPUS)


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "a", "travel museums", 3), (2, "a", "qqq", 3)], "query_id long, scope string, query_text string, top_k int")


@pytest.mark.parametrize(("items", "queries"), [(8192, 16384), (7, 3)])
def test_cosine_top_equals_brute_force(spark, monkeypatch, items, queries):
    monkeypatch.setattr(match, "ITEMS", items)
    monkeypatch.setattr(match, "QUERIES", queries)
    rng = random.Random(3)
    vector = lambda: rng.choice([None, [], [0.0, 0.0], [1.0], [round(rng.uniform(-1, 1), 1), round(rng.uniform(-1, 1), 1)], [round(rng.uniform(0, 1), 1), None]])
    q = [(i, rng.choice("ab"), rng.randint(1, 6), vector()) for i in range(20)]
    c = [(f"c{i:03}", rng.choice("abc"), vector()) for i in range(60)]
    got = {}
    top = match.cosine_top(spark.createDataFrame(q, "query_id long, scope string, top_k int, qv array<double>"), spark.createDataFrame(c, "chunk_id string, scope string, cv array<double>"), "qv", "cv")
    for r in retrieve.cut_top(top).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.score))

    def cosine(a, b):
        if not a or not b or len(a) != len(b):
            return 0.0
        x, y = (np.array([0.0 if t is None else t for t in v]) for v in (a, b))
        size = np.linalg.norm(x) * np.linalg.norm(y)
        return float(np.clip(x @ y / size, 0, 1)) if size else 0.0

    for i, scope, k, v in q:
        want = sorted(((-round(cosine(v, w), 6), key) for key, s, w in c if s == scope))[:k]
        assert [(key, pytest.approx(s)) for _, key, s in sorted(got.get(i, []))] == [(key, -s) for s, key in want]


@pytest.mark.parametrize("library", [True, False])
def test_containing(spark, monkeypatch, library):
    if not library:
        monkeypatch.setattr(match, "ahocorasick", None)
    monkeypatch.setattr(match, "ITEMS", 2)
    needles = spark.createDataFrame([("a", "an"), ("a", "ana"), ("a", ""), ("a", None), ("b", "x"), ("a", "an")], "scope string, needle string")
    texts = spark.createDataFrame([("a", "1", "banana"), ("a", "1", "banana"), ("a", "2", "an"), ("a", "3", None), ("a", "4", ""), ("b", "5", "banana"), ("a", "6", "zzz")], "scope string, id string, text string")
    assert sorted((r.scope, r.id, r.needle) for r in match.containing(needles, texts).collect()) == [("a", "1", "an"), ("a", "1", "ana"), ("a", "2", "an")]
    assert match.containing(needles, texts.where("false")).isEmpty() and match.containing(needles.where("false"), texts).isEmpty()


def test_auto_route_and_policy(spark, corpus, questions):
    got = {(r.query_id, r.chunk_id) for r in retrieve.auto_routed(questions, corpus, retrieve.lexical_top).collect()}
    assert got == {(1, "doc1:0")}
    wide = retrieve.search_by_policy(questions, corpus, retrieve.dense_text_top, fanout=2)
    assert {r.chunk_id for r in wide.where("query_id = 1").collect()} == {"doc1:0"} and wide.where("query_id = 2").count() == 2
    assert retrieve.search_by_policy(questions, corpus, retrieve.lexical_top, fanout=1).count() == 2
    step = retrieve.trajectory(questions, retrieve.lexical_top(questions, corpus), retrieve.route_candidates(questions, corpus)).where("query_id = 1").first()
    assert step.route == ["Cities", "Travel"] and step["mode"] == "single" and step.hit_count == 2


def test_search_rejects_blank(spark, corpus, questions):
    got = retrieve.search(questions, corpus, retrieve.lexical_top, lambda q: q.withColumn("query_text", F.concat("query_text", F.lit(" trains"))))
    assert {r.effective_query for r in got.collect()} == {"travel museums trains", "qqq trains"}
    with pytest.raises(Exception, match="blank"):
        retrieve.search(spark.createDataFrame([(1, "a", " \t", 3)], questions.schema), corpus, retrieve.lexical_top).collect()


def test_trail_and_communities(spark):
    hits = spark.createDataFrame([(1, 2, "s", ["A", "B"]), (1, 1, "t", None), (1, 3, "s", ["C"]), (1, 4, None, [])], "query_id long, rank int, section_id string, section_path array<string>")
    row = retrieve.section_trail(hits).first()
    assert row.section_ids == ["t", "s"] and row.trail == ["A", "B", "C"]
    groups = spark.createDataFrame([("L1", ["x", "y"]), ("L0", ["y"]), ("L2", ["z"])], "community_id string, entity_ids array<string>")
    reached = spark.createDataFrame([(1, "y"), (1, "x"), (2, "q")], "query_id long, entity_id string")
    assert [tuple(r) for r in retrieve.communities_of(reached, groups).collect()] == [(1, ["L0", "L1"])]


def test_rewrite_and_snapshot(spark):
    entities = spark.createDataFrame([(1, " Ada ", "person"), (2, "Bob", "person")], "entity_id long, name string, type string")
    relations = spark.createDataFrame([(1, "Ada", "Bob"), (2, None, "ada")], "relation_id long, source string, target string")
    names = spark.createDataFrame([("Ada", "Ada Lovelace"), ("Ada", "Ada L")], "name string, canonical string")
    a, b = graph.rewrite(entities, relations, names)
    assert {r.name for r in a.collect()} == {"Ada Lovelace", "Bob"} and {(r.source, r.target) for r in b.collect()} == {("Ada Lovelace", "Bob"), (None, "ada")}
    ids = graph.snapshot(spark.createDataFrame([("t:b",), ("t:a",)], "entity_id string"), spark.createDataFrame([("r",)], "relation_id string"))
    assert sorted((r.kind, r.place, r.id) for r in ids.collect()) == [("entity", 1, "t:a"), ("entity", 2, "t:b"), ("relation", 1, "r")]


def test_commit_touches_only_its_parts(spark, tmp_path):
    folder = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "chunk_id string, source_id string, content string")
    ingest.commit(spark, folder, make([(f"c{i}", f"s{i}", "old") for i in range(40)]))
    before = {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "t").iterdir() if p.is_dir()}
    changed = ingest.commit(spark, folder, make([("c1", "s1", "new"), ("c2", "s7", "moved"), ("d1", "s1", "more")]))
    after = {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "t").iterdir() if p.is_dir()}
    assert 0 < len(changed) <= 3 and all(after.get(p) == files for p, files in before.items() if int(p.removeprefix("_part=")) not in changed)
    got = {r.chunk_id: (r.source_id, r.content) for r in ingest.current(spark, folder).collect()}
    assert len(got) == 40 and got["c1"] == ("s1", "new") and got["c2"] == ("s7", "moved") and got["d1"] == ("s1", "more") and "c7" not in got
    ingest.commit(spark, folder, make([("c1", "s1", "new"), ("c2", "s7", "moved"), ("d1", "s1", "more")]))
    assert {r.chunk_id: (r.source_id, r.content) for r in ingest.current(spark, folder).collect()} == got
    ingest.remove_chunks(spark, folder, make([(f"c{i}", "", "") for i in range(40)]))
    assert [r.chunk_id for r in ingest.current(spark, folder).collect()] == ["d1"]


def test_import_counts_and_model_extraction(spark):
    docs = S.static(spark, [{"id": "d", "title": "t", "content": "x" * 1200, "source_id": "s", "metadata": {}}])
    row = ingest.import_counts(ingest.import_chunks(docs, "n")).first()
    assert row.chunks == len(row.chunk_ids) > 1 and row.chunk_ids[0] == "d:0"
    reply = "ENTITY | Ada | person | first\nnoise\nENTITY | | x\nrelation|Ada|Bob|knows|"
    found, links = extract_graph(spark.createDataFrame([("c", "text")], "chunk_id string, content string"), lambda p: [reply] * len(p))
    assert [(r.name, r.type, r.source_chunk_ids) for r in found.collect()] == [("Ada", "person", ["c"])] and [(r.source, r.target, r.relation) for r in links.collect()] == [("Ada", "Bob", "knows")]


def test_model_steps(spark, questions):
    hits = spark.createDataFrame([(1, "c", "q", "long text"), (1, "d", "q", "other")], "query_id long, chunk_id string, query_text string, content string")
    got = {r.chunk_id: r.content for r in abstractive_compress(hits, lambda ps: [" short " if "long" in p else " " for p in ps]).collect()}
    assert got == {"c": "short", "d": "other"}
    parts = decompose(questions, lambda ps: ["1. one\n- two\n" if "travel" in p else "" for p in ps])
    assert [(r.query_id, r.order, r.query_text) for r in parts.orderBy("query_id", "order").collect()] == [(1, 0, "one"), (1, 1, "two"), (2, 0, "qqq")]


def test_failing_grader_counts_half(spark, corpus, questions):
    def grader(prompts):
        if any("doc1:1" in p for p in prompts):
            raise RuntimeError("down")
        return ["score=1"] * len(prompts)

    asker = Asker(corpus, lambda ps: ["a"] * len(ps), grader)
    rows = asker._graded(spark.createDataFrame([(1, "q", "doc1:0", "x"), (1, "q", "doc1:1", "y")], "query_id long, query_text string, chunk_id string, content string"))
    assert {r.chunk_id: r.relevance for r in rows.collect()} == {"doc1:0": 1.0, "doc1:1": 0.5}


def test_cache_is_bounded_and_keeps_successes(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("bad",)], "k string")
    cache = spark.createDataFrame([("old", "v", 1), ("a", "kept", 1)], "k string, v string, used long")
    seen, grown = cached(rows, "k", cache, "v", lambda df: df.select("k", F.when(F.col("k") != "bad", "new").alias("v")), most=2)
    assert {r.k: r.v for r in seen.collect()} == {"a": "kept", "b": "new", "bad": None} and {r.k for r in grown.collect()} == {"a", "b"}


def test_triad_benchmark_and_comparison(spark, corpus, questions):
    judge = lambda ps: ['{"groundedness": 0.5, "answer_relevance": 2}'] * len(ps)
    gold = spark.createDataFrame([(1, ["doc1"], ["doc1:0"]), (2, ["doc2"], [])], "query_id long, gold_doc_ids array<string>, gold_chunk_ids array<string>")
    asker = Asker(corpus, lambda ps: ["museums"] * len(ps))
    found, means, answers = evaluators.triad(asker, questions, gold, judge, 3)
    assert found.first().grounding == 0.5 and found.first().recall == 0.5 and tuple(means.first()) == (2, 0.5, 1.0) and answers.count() == 2
    examples = questions.withColumns({"gold_answers": F.array(F.lit("museums")), "required_phrases": F.array(F.lit("mus"), F.lit("zzz"))})
    heard = []
    metrics, scored = evaluators.benchmark(asker, examples, Options(), judge, lambda stage, n: heard.append((stage, n)))
    row = metrics.first()
    assert row.Examples == 2 and row.ExactMatch == 1.0 and row.RequiredPhraseRecall == 0.5 and row.MeanGroundedness == 0.5 and row.ReflectionRoundsMean is None and heard == [("answered", 2), ("judged", 2)] and scored.count() == 2
    both = evaluators.graph_comparison(questions, gold, lambda q, c: retrieve.lexical_top(q, c), lambda q, c: retrieve.dense_text_top(q, c.where("chunk_id = 'none'")), corpus, 3).first()
    assert both.recall_off == 0.5 and both.recall_on == 0.0 and both.recall_delta == -0.5 and both.mrr_delta == -0.5
    with pytest.raises(ValueError):
        evaluators.triad(asker, questions, gold, judge, 0)


def test_report_judging_and_usage(spark, questions):
    answers = spark.createDataFrame([(1, "x", ["L2", "L1"]), (2, "y", [])], "query_id long, answer string, communities array<string>")
    reports = spark.createDataFrame([("L1", "One", "first"), ("L2", "", "second")], "community_id string, title string, summary string")
    means, rows = evaluators.evaluate_reports(answers, questions, reports, lambda ps: ['{"groundedness": 1, "answer_relevance": 0}' if "One: first" in p else "junk" for p in ps])
    assert {r.query_id: (r.contexts, r.groundedness) for r in rows.collect()} == {1: (["second", "One: first"], 1.0), 2: ([], None)} and means.first().groundedness == 1.0
    rounds = spark.createDataFrame([(1, 2, 1, 2, 3, False, [("b", 1.0)]), (1, 1, 1, 2, 3, True, [("a", 1.0)])], "query_id long, round int, prompt_tokens long, completion_tokens long, total_tokens long, estimated boolean, stages array<struct<stage:string,seconds:double>>")
    row = evaluators.total_usage(rounds).first()
    assert row.total_tokens == 6 and row.estimated and [s.stage for s in row.stages] == ["a", "b"]


def test_reports():
    text = report.benchmark_markdown("set", {"Examples": 3, "ExactMatch": 0.5, "F1Token": math.nan}, [0, 2])
    assert "| Examples | 3 |" in text and "| ExactMatch | 0.500 |" in text and "| F1Token | n/a |" in text and "| 1 | 2 |" in text
    deltas = [{"metric": "ExactMatch", "prev": 0.5, "curr": 0.75, "delta": 0.25, "direction": "improved"}, {"metric": "F1Token", "prev": None, "curr": 1.0, "delta": None, "direction": "undefined"}]
    plain = report.drift_summary("set", deltas, ["q"], [])
    assert 'dataset "set"' in plain and "delta=+0.250  improved" in plain and "NaN" in plain and "New examples: 1" in plain
    table = report.drift_markdown(deltas, ["q"], ["r"], {"AdoptedRound": [(1, 3), (2, 0)], "none": []})
    assert "| ExactMatch | 0.500 | 0.750 | +0.250 | improved |" in table and "* r" in table and "| 1 | 2 | 0 | -2 |" in table and "L1=4.000" in table and "none" not in table
    assert "precision@k=0.250" in report.triad_summary("set", {"queries": 2, "precision": 0.25}, {}, 3)


def test_record_codec(tmp_path, spark):
    shape = {"name": None, "metrics": {"f1": None}, "rounds": [{"n": None}]}
    record = {"name": "x", "metrics": {"f1": math.nan}, "rounds": [{"n": 1}]}
    assert S.decode_record(S.encode_record(record), shape) == {"name": "x", "metrics": {"f1": None}, "rounds": [{"n": 1}]}
    for bad in ('{"other": 1}', '{"metrics": {"f2": 1}}', '{"rounds": [{"m": 1}]}', "[1]", '{"metrics": 3}'):
        with pytest.raises(ValueError, match="unknown|object"):
            S.decode_record(bad, shape)
    S.write_triad(str(tmp_path / "out"), spark.createDataFrame([(1, "a")], "n int, t string"), {"k": 1})
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == ['{"n":1,"t":"a"}', '{"summary": {"k": 1}}']


def test_http_model_asks_once_per_query():
    asked = []

    def ask(url, query, passages, *rest):
        asked.append((query, passages))
        return [float(len(p)) for p in passages]

    assert S.http_model("u", ask=ask)([("q", "a"), ("r", "bb"), ("q", None)]) == [1.0, 2.0, 0.0] and len(asked) == 2


def test_tool(spark, tmp_path):
    tool = tools.Tool(spark, str(tmp_path / "t"), "n", lambda ps: ["answer"] * len(ps))
    assert tool.call("add_text", {"text": "Kafka moves events.", "doc_id": "d", "title": "T"}) == [{"chunks": 1}]
    assert tool.call("search", {"query": "kafka"})[0]["chunk_id"] == "d:0" and tool.call("ask", {"query": "kafka"})[0]["answer"] == "answer"
    assert tool.call("stats", {})[0]["chunks"] == 1
    for action, arguments in (("drop", {}), ("search", {}), ("search", {"query": " "})):
        with pytest.raises(ValueError, match="unknown|missing|blank"):
            tool.call(action, arguments)
    assert tool.call("remove", {"chunk_id": "d:0"}) == [{"removed": "d:0"}] and tool.call("stats", {}) == []


def test_f1_counts_repeats(spark):
    df = spark.createDataFrame([("the the cat", ["the cat"]), (None, ["x"]), ("x", [None, "x"])], "a string, g array<string>")
    assert [round(r[0], 6) for r in df.select(E.token_f1(F.col("a"), F.col("g"))).collect()] == [0.8, 0.0, 1.0]

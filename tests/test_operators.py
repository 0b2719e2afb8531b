import math
import os
import shutil

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import bm25, graph, hierarchy, providers, retrieval, stats

K = ["sample_id"]


def docs(spark, *texts, sample="s"):
    return spark.createDataFrame([(sample, i, t) for i, t in enumerate(texts)], "sample_id string, doc long, text string")


def okapi(query, corpus):
    """The usual formula, written out."""
    toks = [d.split() for d in corpus]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    df = {t: sum(t in d for d in toks) for d in toks for t in d}
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: low if v < 0 else v for t, v in raw.items()}
    return [sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query.split()) for d in toks]


@pytest.mark.parametrize("query", ["a", "a a b", "c zz", "every"])
def test_bm25_against_the_formula(spark, query):
    corpus = ["a b every", "a a c every d", "every b", "every"]
    q = spark.createDataFrame([("s", 1, query)], "sample_id string, q int, ask string")
    got = {r["doc"]: r["bm25"] for r in bm25.scores(q, docs(spark, *corpus), K, "q", "ask", "doc", "text").collect()}
    assert [got[i] for i in range(4)] == pytest.approx(okapi(query, corpus))


def test_bm25_of_one_document_and_min_max_of_a_constant(spark):
    q = spark.createDataFrame([("s", 1, "a")], "sample_id string, q int, ask string")
    s = bm25.min_max(bm25.scores(q, docs(spark, "a b"), K, "q", "ask", "doc", "text"), "bm25", ["q"], "x").first()
    assert s["x"] == 0.0


def test_prefix_scores_are_those_of_an_index_of_the_time(spark):
    corpus = ["a b", "b c a", "a a", "c d"]
    d = docs(spark, *corpus).withColumn("seq", F.col("doc"))
    got = {(r["query"], r["other"]): r["bm25"] for r in bm25.prefix_scores(d, K, "doc", "seq", "text").collect()}
    for i in range(4):
        assert [got[i, j] for j in range(i + 1)] == pytest.approx(okapi(corpus[i], corpus[: i + 1]))
    assert len(got) == 10


def test_top_k(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([1.0, 3.0, 3.0, 2.0])], "g string, i int, s double")
    ids = lambda k: [r["i"] for r in retrieval.top_k(df, ["g"], "s", "i", k).orderBy("rank").collect()]
    assert ids(2) == [2, 1] and ids(9) == [2, 1, 3, 0] and ids(0) == ids(4)  # ties: the later first; none means all
    assert ids(3)[:2] == ids(2)


def test_level_k():
    assert retrieval.level_k(None) == (2, 3, 5) and retrieval.level_k((1, 2)) == (2, 3, 5) and retrieval.level_k((1, 2, 3)) == (1, 2, 3)


def test_traversal_expands_scenes_and_facts_but_not_personas(spark):
    names = [f"f{i}" for i in range(7)]
    rows = [("s", n, i, "fact", [1.0, 0.0], "w") for i, n in enumerate(names)] + [("s", "scene", 10, "scene", [0.0, 1.0], "hit"), ("s", "p", 20, "persona", [0.0, 0.5], "w")]
    nodes = spark.createDataFrame(rows, "sample_id string, node_id string, node_seq long, level string, vec array<double>, doc string")
    edges = spark.createDataFrame([("s", "scene", n, i, "contains") for i, n in enumerate(names)] + [("s", "p", "scene", 0, "contains"), ("s", "f0", "f1", 0, "persona_related")], "sample_id string, src string, dst string, edge_seq long, type string")
    ask = lambda vec, text, k: [(r["node_id"], r["seed"]) for r in retrieval.graph_traversal(spark.createDataFrame([("s", 1, text, vec)], "sample_id string, query_id long, text string, vec array<double>"), nodes, nodes, edges, K, k).orderBy("rank").collect()]
    assert ask([0.0, 1.0], "hit", 1) == [("scene", True)] + [(n, False) for n in names[:5]]
    assert ask([1.0, 0.0], "w", 1) == [("f6", True), ("scene", False)]
    top2 = ask([0.0, 1.0], "hit", 2)
    assert top2[:2] == [("scene", True), ("p", True)] and len(top2) == 7


def test_latest_wins_and_edges_both_ways(spark):
    v = spark.createDataFrame([("s", "a", "old", 0), ("s", "a", "new", 1), ("s", "b", "x", 0)], "sample_id string, node_id string, content string, version long")
    assert {r["node_id"]: r["content"] for r in graph.latest(v, ["sample_id", "node_id"]).collect()} == {"a": "new", "b": "x"}
    e = spark.createDataFrame([("s", "a", "b"), ("s", "c", "c")], "sample_id string, src string, dst string")
    assert {(r["src"], r["dst"]) for r in graph.both_ways(e).collect()} == {("a", "b"), ("b", "a")}


def test_suggestions(spark):
    index = spark.createDataFrame([("s", "a", 0), ("s", "b", 1), ("t", "c", 0)], "sample_id string, node_id string, node_seq long")
    d = spark.createDataFrame([("s", "a", ["1", "7", "a", "c", "0"])], "sample_id string, node_id string, suggested array<string>")
    assert {(r["src"], r["dst"]) for r in graph.suggested_edges(d, index, K).collect()} == {("a", "b"), ("b", "a")}


def test_neighbour_updates_stop_with_the_shortest_list(spark):
    d = spark.createDataFrame([(1, ["a", "b", "c"], ["x", "y"], [["t"]]), (2, ["a"], [], [["t"]])], "id int, neighbours array<string>, contexts array<string>, tags array<array<string>>")
    assert [(r["id"], r["node_id"], r["context"], r["tags"]) for r in graph.neighbour_updates(d).collect()] == [(1, "a", "x", ["t"])]


def test_label_propagation(spark):
    ids = "abcdefg"
    nodes = spark.createDataFrame([("s", x, i) for i, x in enumerate(ids)], "sample_id string, node_id string, node_seq long")
    edges = spark.createDataFrame([("s", *e) for e in ("ab", "bc", "ca", "de", "ef", "fd")], "sample_id string, src string, dst string")
    got = {r["node_id"]: r["label"] for r in graph.label_propagation(nodes, edges, K, 4).collect()}
    assert len({got[x] for x in "abc"}) == 1 and len({got[x] for x in "def"}) == 1 and got["g"] == "g" and got["a"] != got["d"]


def test_levels_go_with_their_edges(spark):
    n = spark.createDataFrame([("s", "f", "fact"), ("s", "c", "scene"), ("s", "o", None)], "sample_id string, node_id string, level string")
    e = spark.createDataFrame([("s", "c", "f"), ("s", "f", "o")], "sample_id string, src string, dst string")
    left, links = graph.without_levels(n, e, K)
    assert {r["node_id"] for r in left.collect()} == {"f", "o"} and [(r["src"], r["dst"]) for r in links.collect()] == [("f", "o")]


def test_refinement(spark):
    s = spark.createDataFrame([("s", "a", "x", None), ("s", "b", "y", True), ("s", "c", "z", False)], "sample_id string, node_id string, content string, refined boolean")
    add = spark.createDataFrame([("s", "a", " much more "), ("s", "c", " few ")], "sample_id string, node_id string, addition string")
    got = {r["node_id"]: (r["content"], r["refined"]) for r in hierarchy.refine(s, add, K).collect()}
    assert got == {"a": ("x\n[Insight]: much more", True), "c": ("z", True)}


def test_persona_links(spark):
    p = spark.createDataFrame([("s", "p", [1.0, 0.0])], "sample_id string, node_id string, vec array<double>")
    s = spark.createDataFrame([("s", f"s{i}", i, [math.cos(i / 20), math.sin(i / 20)]) for i in range(40)], "sample_id string, node_id string, node_seq long, vec array<double>")
    assert {r["dst"] for r in hierarchy.link_personas(p, s, K).collect()} == {f"s{i}" for i in range(8)}


def test_statistics(spark):
    v = spark.createDataFrame([(1, "f1", 0.5), (1, "f1", 1.0), (2, "f1", 0.0), (2, "em", 1.0)], "category int, metric string, value double")
    got = {(r["scope"], r["metric"]): r for r in stats.aggregate_metrics(v).collect()}
    assert got["overall", "f1"]["mean"] == 0.5 and got["2", "f1"]["std"] == 0 and got["overall", "em"]["n"] == 1
    assert stats.aggregate_metrics(v.limit(0)).count() == 0


@pytest.mark.parametrize("n, ratio, left", [(100, 0.29, 28), (3, 0.1, 1), (5, 1.0, 5)])
def test_head_sample(spark, n, ratio, left):
    assert stats.head_sample(spark.range(n), "id", ratio).count() == left
    with pytest.raises(ValueError):
        stats.head_sample(spark.range(n), "id", 0)


def test_unanswered(spark):
    q = spark.createDataFrame([("s", 0, "a"), ("s", 1, " a"), ("s", 2, "b")], "sample_id string, qa_idx int, question string")
    done = q.where("qa_idx = 0")
    assert [r["qa_idx"] for r in stats.unanswered(q, done, K).collect()] == [2]
    assert {r["qa_idx"] for r in stats.unanswered(q, done, K, by_text=False).collect()} == {1, 2}


def test_providers(spark):
    df = spark.createDataFrame([("one two",), (None,)], "p string")
    assert [r["out"] for r in providers.complete(df, "p", "out", "echo", words=1).collect()] == ['{"answer": "one"}', '{"answer": ""}']
    with pytest.raises(ValueError):
        providers.completion("nobody")
    calls = []

    def fails(*a):
        calls.append(a)
        raise OSError

    assert providers.HttpCompletion("u", "m", pause=0, send=fails).get_completion("x") == "{}" and len(calls) == 3
    assert providers.HttpCompletion("u", "m", send=lambda *a: b'{"choices": [{"message": {"content": "hi"}}]}').get_completion("x") == "hi"
    assert len(providers.embed(df, "p", "v").first()["v"]) == 16

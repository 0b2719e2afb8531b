"""Scores by blocks: whole whatever the blocks, and no pair of a query and a document is shuffled."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from sparkloom.operators import bm25, retrieval

K = ["s"]
DOC, ASK = "s string, doc long, seq long, doc_text string, vec array<double>", "s string, q long, text string, vec array<double>, k int"


def brute(docs: list[str], ask: str) -> list[float]:
    toks = [d.split() for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    df = Counter(t for d in toks for t in set(d))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = bm25.EPSILON * sum(raw.values()) / len(raw)
    share = lambda d, t: d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg))
    return [sum((raw[t] if raw[t] >= 0 else floor) * share(d, t) for t in ask.split() if t in raw) for d in toks]


@pytest.fixture(scope="module")
def corpora():
    r = random.Random(3)
    text = lambda: " ".join(r.choice("abcdefghijkl") for _ in range(r.randint(1, 12)))
    vec = lambda: [r.choice([0.0, 1.0, 2.0]) for _ in range(3)]
    docs = [(s, i, i, text(), vec()) for s, n in (("x", 23), ("y", 2), ("no queries", 9)) for i in range(n)]
    asks = [(s, i, r.choice([text(), "unknown a a", "", None]), vec(), r.choice([0, 1, 4, 99])) for s, n in (("x", 11), ("y", 1), ("no documents", 3)) for i in range(n)]
    return docs, asks


@pytest.mark.parametrize("rows", [(512, 1024), (2, 3)])
def test_blocks_give_every_score(spark, corpora, monkeypatch, rows):
    monkeypatch.setattr(bm25, "ASKS", rows[0])
    monkeypatch.setattr(bm25, "HAS", rows[1])
    docs, asks = corpora
    d, q = spark.createDataFrame(docs, DOC).withColumnRenamed("doc_text", "body"), spark.createDataFrame(asks, ASK)
    got = {(r["s"], r["q"], r["doc"]): (r["bm25"], r["sparse"]) for r in bm25.scores(q, d, K, "q", "text", "doc", "body").collect()}
    want = {}
    for s, i, text, *_ in asks:
        own = [x for x in docs if x[0] == s]
        if own:
            b = brute([x[3] for x in own], text or "")
            lo, hi = min(b), max(b)
            want |= {(s, i, x[1]): (v, (v - lo) / (hi - lo) if hi > lo else 0.0) for x, v in zip(own, b)}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    both = d.selectExpr("s", "doc AS node", "seq", "body AS doc", "vec")
    every = retrieval.hybrid_scores(q, both, K, "q", "node", "seq")
    best = retrieval.top_k(every.join(q.select("s", "q", "k"), ["s", "q"]), ["s", "q"], "score", "seq", F.col("k")).select("s", "q", "node", "rank", "score")
    flat = retrieval.flat(q, both, K, F.col("k"), "q", "node", "seq").select("s", "q", "node", "rank", "score")
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, best.collect())) and flat.count()


def test_no_pair_is_shuffled_before_the_best_are_chosen(spark, corpora):
    docs, asks = corpora
    d, q = spark.createDataFrame(docs, DOC).selectExpr("s", "doc AS node", "seq", "doc_text AS doc", "vec"), spark.createDataFrame(asks, ASK)
    plan = retrieval.flat(q, d, K, 3, "q", "node", "seq")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "node#" in x.split("ENSURE")[0]]


@pytest.mark.parametrize("rows", [(512, 1024), (2, 3)])
def test_prefix_scores_are_those_of_an_index_of_that_time(spark, corpora, monkeypatch, rows):
    monkeypatch.setattr(bm25, "ASKS", rows[0])
    monkeypatch.setattr(bm25, "HAS", rows[1])
    docs = [x for x in corpora[0] if x[0] == "x"]
    df = spark.createDataFrame(docs, DOC)
    whole = bm25.prefix_scores(df, K, "doc", "seq", "doc_text", vec=("vec", "vec"), alpha=0.5)
    got = {(r["query"], r["other"]): r for r in whole.collect()}
    assert len(got) == len(docs) * (len(docs) + 1) // 2
    for i in range(len(docs)):
        want = brute([x[3] for x in docs[: i + 1]], docs[i][3])
        lo, hi = min(want), max(want)
        for j, v in enumerate(want):
            assert got[i, j]["bm25"] == pytest.approx(v, abs=1e-9) and got[i, j]["sparse"] == pytest.approx((v - lo) / (hi - lo) if hi > lo else 0.0, abs=1e-9)
    few = bm25.prefix_scores(df, K, "doc", "seq", "doc_text", vec=("vec", "vec"), alpha=0.5, k=2)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "query#" in x and "other#" in x]
    total = lambda r: round(0.5 * r["dense"] + 0.5 * r["sparse"], 9)
    best = {q: sorted(((total(r), r["other"]) for (a, _), r in got.items() if a == q), reverse=True)[:2] for q in range(len(docs))}
    rows_ = [(r["query"], total(r), r["other"]) for r in few.collect()]
    assert best == {q: sorted((x[1:] for x in rows_ if x[0] == q), reverse=True)[:2] for q in range(len(docs))}


def test_index_build_makes_documents_once(spark, sf):
    from sparkloom.plans import registry, retrieval_queries  # noqa: F401

    files = registry.QUERIES["index_build"](spark, sf).inputFiles()
    assert files and all("index-documents" in f for f in files)

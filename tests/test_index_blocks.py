"""The index and its prefixes: texts are shuffled once and postings never, whatever the size of a corpus."""

import math
import random
from collections import Counter

import pytest
from sparkloom.operators import bm25

K = ["s"]


def index(docs: list[tuple[int, str | None]]) -> dict[tuple[str, int], float]:
    """Rows that repeat a document with as many tokens are one, as in GROUP BY document, length, term."""
    toks = [(i, None if t is None else t.split()) for i, t in docs]
    n, avg = len(toks), sum(len(t) for _, t in toks if t is not None) / max(sum(t is not None for _, t in toks), 1)
    tf = Counter((i, len(t), w) for i, t in toks if t for w in t)
    df = Counter(w for _, _, w in tf)
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = bm25.EPSILON * sum(raw.values()) / max(len(raw), 1)
    return {(w, i): (raw[w] if raw[w] >= 0 else floor) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avg)) for (i, dl, w), f in tf.items()}


@pytest.fixture(scope="module")
def corpora():
    r = random.Random(5)
    text = lambda: None if r.random() < 0.1 else " ".join(r.choice("abcdefghijkl") for _ in range(r.randint(0, 12)))
    docs = [(s, i, text()) for s, n in (("x", 23), ("y", 2), ("z", 9), ("one", 1)) for i in range(n)]
    return [*docs, docs[2], docs[7], ("none", 1, None), ("none", 2, ""), (None, 1, "a b")]


@pytest.mark.parametrize("rows", [1024, 3, 9])
def test_weights_are_those_of_an_index(spark, corpora, monkeypatch, rows):
    monkeypatch.setattr(bm25, "HAS", rows)
    got = bm25.weights(spark.createDataFrame(corpora, "s string, node long, body string"), K, "node", "body")
    assert got.columns == ["s", "term", "node", "w"]
    found = [tuple(r) for r in got.collect()]
    want = {(s, *k): w for s in {x[0] for x in corpora if x[0]} for k, w in index([x[1:] for x in corpora if x[0] == s]).items()}
    assert {x[:3]: pytest.approx(x[3], abs=1e-12) for x in found} == want and len(found) == len(want)


def test_postings_of_the_index_are_not_shuffled(spark, corpora):
    plan = bm25.weights(spark.createDataFrame(corpora, "s string, node long, body string"), K, "node", "body")._jdf.queryExecution().executedPlan().toString()
    shuffles = [x for x in plan.splitlines() if "Exchange" in x]
    assert len(shuffles) == 1 and "term" not in shuffles[0]


def texts(n: int, r: random.Random) -> list[tuple[int, str, str | None]]:
    """(document, text, what of it is asked)."""
    out = []
    for i in range(n):
        words = [r.choice("abcdefghijkl") for _ in range(r.randint(0, 12))]
        out.append((i, " ".join(words), None if r.random() < 0.1 else " ".join(words[: r.randint(0, 12)])))
    return out


@pytest.mark.parametrize("rows", [(512, 1024), (4, 1024), (2, 3), (5, 7)])
def test_prefixes_answer_what_is_asked(spark, monkeypatch, rows):
    monkeypatch.setattr(bm25, "ASKS", rows[0])
    monkeypatch.setattr(bm25, "HAS", rows[1])
    r = random.Random(8)
    docs = [(s, *x) for s, n in (("x", 17), ("y", 2), ("z", 5)) for x in texts(n, r)]
    df = spark.createDataFrame(docs, "s string, doc long, body string, ask string").selectExpr("*", "-doc AS seq", "array(doc % 3 + 1, 1) AS v")
    asking = {(s, i) for s, i, *_ in docs if i % 3 != 1}
    only = spark.createDataFrame([*asking, ("nowhere", 1)], "s string, doc long")
    some = bm25.prefix_scores(df, K, "doc", "seq", "body", "ask", only, ("v", "v"), 0.5).collect()
    every = bm25.prefix_scores(df, K, "doc", "seq", "body", "ask").collect()
    want = {}
    for s, i, _, ask in docs:
        upto = [x for x in docs if x[0] == s and x[1] >= i]  # in order of seq, which falls
        w = index([x[1:3] for x in upto])
        want |= {(s, i, x[1]): sum(w.get((t, x[1]), 0.0) for t in (ask or "").split()) for x in upto}
    assert {(x["s"], x["query"], x["other"]): pytest.approx(x["bm25"], abs=1e-9) for x in every} == want and len(every) == len(want)
    assert {(x["s"], x["query"], x["other"]): pytest.approx(x["bm25"], abs=1e-9) for x in some} == {k: v for k, v in want.items() if k[:2] in asking}
    assert all(x["other_seq"] == -x["other"] for x in every)
    cos = lambda a, b: (a * b + 1) / math.hypot(a, 1) / math.hypot(b, 1)
    assert all(x["dense"] == pytest.approx((cos(x["query"] % 3 + 1, x["other"] % 3 + 1) + 1) / 2) for x in some)


def test_prefixes_shuffle_texts_once_and_no_posting(spark, sf):
    from sparkloom.operators import job
    from sparkloom.plans import model

    plan = job.prefix_neighbours(model.facts(spark, sf))._jdf.queryExecution().executedPlan().toString()
    shuffles = [x for x in plan.splitlines() if "Exchange" in x]
    assert len(shuffles) == 2 and not any(x in plan for x in ("prefix-terms", "prefix-postings", "Join"))


def test_links_find_neighbours_once(spark, sf):
    from sparkloom.operators import job
    from sparkloom.plans import model

    links = job.offline_links(job.prefix_neighbours(model.facts(spark, sf)))
    assert links.columns == ["sample_id", "src", "dst"]
    assert links._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInArrow") == 1

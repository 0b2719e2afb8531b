"""Trained token vectors, and BERTScore by them."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import answering, embedder

PAIR = "id int, prediction string, reference string"


@pytest.fixture(scope="module")
def model(spark):
    """Animals and days stand in company of their own."""
    rng, rows = random.Random(1), []
    for _ in range(300):
        rows.append((f"the {rng.choice(['cat', 'dog', 'horse'])} {rng.choice(['eats', 'sleeps', 'runs'])} in {rng.choice(['grass', 'hay'])}",))
        rows.append((f"we meet on {rng.choice(['monday', 'tuesday', 'friday'])} {rng.choice(['morning', 'evening'])} at {rng.choice(['noon', 'nine'])}",))
    return embedder.fit(spark.createDataFrame([*rows, (None,), ("",), ("alone",)], "text string"), "text").cache()


def test_words_in_alike_company_are_near(model):
    v = {r["term"]: np.array(r["vec"]) for r in model.collect()}
    assert all(abs(np.linalg.norm(x) - 1) < 1e-9 and len(x) == embedder.DIMS for x in v.values()) and "alone" not in v
    near = [v["cat"] @ v["dog"], v["dog"] @ v["horse"], v["monday"] @ v["friday"]]
    far = [v["cat"] @ v["monday"], v["dog"] @ v["noon"], v["horse"] @ v["friday"]]
    assert min(near) > 0.6 > 0.4 > max(far)


def test_counts_by_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abCd") for _ in range(rng.randint(0, 9))) for _ in range(50)] + [None, ""]
    want = Counter()
    for t in texts:
        w = (t or "").lower().split()
        for i, a in enumerate(w):
            want.update((a, w[j]) for j in range(max(0, i - 2), min(len(w), i + 3)) if j != i)
    got = embedder.cooccurrences(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()
    assert {(r["term"], r["other"]): r["n"] for r in got} == dict(want)


def test_bert_score_by_brute_force(spark, model):
    v = {r["term"]: np.array(r["vec"]) for r in model.collect()}
    rows = [(1, "the cat eats hay", "a dog sleeps in grass"), (2, "unseen words", "unseen things"), (3, None, "cat"), (4, "", ""), (5, "cat cat cat", "cat"), (6, "monday morning", "the dog runs"), (7, "dog " * 3000, "cat " * 3000 + "hay")]

    def best(a, bs):
        return 1.0 if a in bs else max(float(v[a] @ v[b]) if a in v and b in v else 0.0 for b in bs)

    def brute(p, r):
        p, r = (p or "").split(), (r or "").split()
        if not p or not r:
            return 0.0, 0.0, 0.0
        sp, sr = set(p), set(r)
        one = {a: best(a, sr) for a in sp}
        two = {a: best(a, sp) for a in sr}
        x, y = sum(one[a] for a in p) / len(p), sum(two[a] for a in r) / len(r)
        return x, y, 2 * x * y / (x + y) if x + y > 0 else 0.0

    got = {r["id"]: tuple(r)[1:] for r in embedder.bert_scores(spark.createDataFrame(rows, PAIR), ["id"], model).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, p, r in rows:
        assert got[i] == pytest.approx(brute(p, r), abs=1e-9)
    assert got[5] == (1.0, 1.0, 1.0) and 0.3 < got[1][2] < 1


def test_encode_and_the_record(spark, model):
    rows = spark.createDataFrame([(1, "the cat eats", "a dog sleeps"), (2, "the cat eats", "on friday at noon"), (3, None, "x")], PAIR)
    vec = {r["id"]: r["vec"] for r in embedder.encode(rows, ["id"], "prediction", model).collect()}
    assert len(vec[1]) == embedder.DIMS and not any(vec[3])
    record = {r["id"]: r for r in answering.evaluated(rows, ["id"], model).collect()}
    assert record[1]["sbert_similarity"] > record[2]["sbert_similarity"] and record[1]["bert_f1"] > record[2]["bert_f1"] and record[3]["bert_f1"] == 0
    assert len(record[1]) == 13
    plain = answering.evaluated(rows, ["id"]).columns
    assert plain == answering.evaluated(rows, ["id"], model).columns
    assert embedder.fit(rows.limit(0).select(F.col("prediction").alias("text")), "text").count() == 0


def test_a_vector_is_shuffled_once_a_batch_not_once_a_text(spark, model, monkeypatch):
    n = 3000
    rows = spark.range(n).selectExpr("id", "concat('the cat ', id % 7) AS prediction", "'a dog the' AS reference")
    once = {tuple(r)[1:] for r in embedder.bert_scores(rows.where("id = 8"), ["id"], model).collect()}
    got = embedder.bert_scores(rows, ["id"], model)
    assert {tuple(r)[1:] for r in got.where("id % 7 = 1").collect()} == once and got.count() == n
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning(id#" in x]
    whole = sorted(map(tuple, embedder.encode(rows.limit(50), ["id"], "prediction", model).collect()))
    monkeypatch.setattr(embedder, "BATCH", 100)
    assert len(whole) == 50 and [x[0] for x in whole] == sorted(r["id"] for r in embedder.encode(rows.limit(50), ["id"], "prediction", model).collect())
    assert sorted(tuple(r)[1:] for r in embedder.bert_scores(rows.limit(50), ["id"], model).collect()) == sorted(tuple(r)[1:] for r in got.where("id < 50").collect())

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import metrics, text as T
from sparkloom.functions.vector import cosine


def one(spark, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if not isinstance(v, list) else 'array<string>'}" for k, v in cols.items()))


def value(df, expr):
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "reply, body",
    [
        ('x ```json\n{"a": {"b": 1}}\n``` y', '{"a": {"b": 1}}'),
        ('``` {"a": 1} ```', '{"a": 1}'),
        ('so {"a": 1} and {"b": 2} end', '{"a": 1} and {"b": 2}'),
        ("nothing", "nothing"),
        ("", ""),
    ],
)
def test_json_text(spark, reply, body):
    assert value(one(spark, r=reply), T.json_text("r")) == body


@pytest.mark.parametrize(
    "reply, answer",
    [
        ('{"answer": "Paris"}', "Paris"),
        ('{"short_answer": "x", "z": 1}', "x"),
        ('{"foo": "bar"}', "bar"),
        ("{}", "{}"),
        ('```json {"result": "r"} ```', "r"),
        (" plain \n", "plain"),
        ("{broken", "{broken"),
    ],
)
def test_answer_pick(spark, reply, answer):
    assert value(one(spark, r=reply), T.answer_pick("r")) == answer


@pytest.mark.parametrize("raw, clean", [("Answer: x", "x"), ("the answer is  7", "7"), ('"quoted"', "quoted"), ('Short answer: "a"', "a"), ("Answer: Answer: x", "Answer: x"), ("Answer:", "Answer:"), ('"', '"')])
def test_answer_clean(spark, raw, clean):
    assert value(one(spark, r=raw), T.answer_clean("r")) == clean


@pytest.mark.parametrize(
    "question, category, kind",
    [("Is it A or B?", 3, "choice"), ("Is it A?", 3, "yes_no"), ("Is it A or B?", 1, "yes_no"), ("How many?", 1, "count"), ("How many?", 3, "open"), ("Is it?", 2, "open"), ("Isle?", 1, "open")],
)
def test_question_class(spark, question, category, kind):
    assert value(one(spark, q=question), T.question_class("q", F.lit(category))) == kind


def test_rendering(spark):
    df = spark.createDataFrame([("c", None, ["a", "b"], None)], "content string, context string, keywords array<string>, tags array<string>")
    assert value(df, T.index_document("content", "context", "keywords", "tags")) == "content: c context:  keywords: a, b tags: "
    assert value(df, T.preview(F.lit("x" * 61))) == "x" * 60 + "..." and value(df, T.preview(F.lit("x" * 60))) == "x" * 60
    assert value(df, T.dimension_label(F.lit("basic_info"))) == "Basic Info"
    assert value(df, T.model_slug(F.lit("a/b:c"))) == "a_b_c"
    assert [value(df, T.category_k(F.lit(c))) for c in (1, 2, 3, 4, 5)] == [35, 25, 30, 25, 35]
    assert value(df, T.literal_repair(F.lit('{"a": True, "b": None}'))) == '{"a": true, "b": null}'


def test_exact_match_strips_all_white_space(spark):
    assert value(one(spark, a="\n Yes\t", b="yes"), metrics.exact_match("a", "b")) == 1


def test_token_f1(spark):
    f1 = lambda a, b: value(one(spark, a=a, b=b), metrics.token_f1("a", "b"))
    assert f1("a a b", "a c") == pytest.approx(0.5)
    assert f1("", "a") == 0 and f1("x", "y") == 0 and f1("A, b!", "b a") == 1


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    assert value(df, cosine("a", "b")) == pytest.approx(1 / math.sqrt(2)) and value(df, cosine("a", "z")) == 0


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_longest_common_subsequence(spark):
    rnd = random.Random(1)
    rows = [([rnd.choice("abc") for _ in range(rnd.randrange(9))], [rnd.choice("abc") for _ in range(rnd.randrange(9))]) for _ in range(40)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", metrics.lcs_length(F.col("a"), F.col("b")).alias("n"))
    assert all(r["n"] == lcs(r["a"], r["b"]) for r in df.collect())


def test_metrics_of_a_pair_shuffle_nothing(spark):
    df = spark.createDataFrame([(1, "a b a b", "b a b"), (2, None, ""), (3, "x", "x")], "id long, prediction string, reference string")
    for made in (metrics.bleu(df, ["id"]), metrics.rouge_n(df, ["id"], stem=True), metrics.metric_record(df, ["id"])):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Aggregate" not in plan
    got = sorted(tuple(r) for r in metrics.ngram_overlap(df, ["id"], 2).collect())
    assert got == [(1, 1, 3, 4, 3), (1, 2, 2, 3, 2), (2, 1, 0, 0, 0), (2, 2, 0, 0, 0), (3, 1, 1, 1, 1), (3, 2, 0, 0, 0)]


def test_bleu_and_rouge_by_hand(spark):
    df = spark.createDataFrame([(1, "the cat sat", "the cat sat"), (2, "x", "y"), (3, "the cat", "the cat sat on")], "id int, prediction string, reference string")
    b = {r["id"]: r for r in metrics.bleu(df, ["id"]).collect()}
    assert b[1]["bleu1"] == pytest.approx(1) and b[1]["bleu3"] == pytest.approx(1) and b[2]["bleu1"] == 0
    assert b[1]["bleu4"] == pytest.approx(0.1**0.25)
    assert b[3]["bleu1"] == pytest.approx(math.exp(1 - 4 / 2))
    r = {(x["id"], x["n"]): x["f"] for x in metrics.rouge_n(df, ["id"]).collect()}
    assert r[1, 2] == pytest.approx(1) and r[3, 1] == pytest.approx(2 * 1 * 0.5 / 1.5) and r[2, 1] == 0


def test_meteor_exact():
    assert metrics.meteor_exact("a b c".split(), "a b c".split()) == pytest.approx(1 - 0.5 / 27)
    assert metrics.meteor_exact(["x"], ["y"]) == 0
    assert metrics.meteor_exact([], ["y"]) == 0


def test_metric_record_of_empty_texts_is_zero(spark):
    df = spark.createDataFrame([(1, "", "x"), (2, None, None), (3, "x", "x")], "id int, prediction string, reference string")
    rows = {r["id"]: r.asDict() for r in metrics.metric_record(df, ["id"]).collect()}
    assert all(v == 0 for i in (1, 2) for k, v in rows[i].items() if k != "id") and rows[3]["f1"] == 1


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(a=st.text("ab c", max_size=12), b=st.text("ab c", max_size=12))
def test_f1_is_symmetric(spark, a, b):
    df = one(spark, a=a, b=b)
    assert value(df, metrics.token_f1("a", "b")) == pytest.approx(value(df, metrics.token_f1("b", "a")))


def test_bert_scores_of_tokens_make_tokens_once(spark):
    from pyspark.sql import functions as F

    from sparkloom.functions import metrics

    df = spark.createDataFrame([("A cat sat", "a cat a dog"), ("", "x"), (None, "x"), ("...", "...")], "prediction string, reference string")
    got = df.select(F.round(metrics.bert_scores("prediction", "reference")[2], 6).alias("f"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2
    assert [r["f"] for r in got.collect()] == [0.705882, 0.0, 0.0, 0.0]

import json

import pytest

from sparkloom import __main__ as cli
from sparkloom.operators import answering
from sparkloom.sources import graph_store, results
from sparkloom.streaming import ingest




def test_prompts_follow_category_and_kind(spark):
    df = spark.createDataFrame([("Is it A or B?", 3), ("When was it?", 2), ("How many?", 1)], "q string, c int")
    got = [r["x"] for r in df.select(answering.instruction("q", "c").alias("x")).collect()]
    assert got[0].startswith("Choose") and "reference" in got[1] and "number" in got[2]


@pytest.mark.parametrize("reply, keys", [('x {"keywords": "a, b"} y', "a, b"), (" plain ", "plain"), ('{"other": 1}', '{"other": 1}'), ("{broken}", "{broken}")])
def test_keywords(spark, reply, keys):
    assert spark.createDataFrame([(reply,)], "r string").select(answering.keywords_of("r").alias("k")).first()["k"] == keys


def test_answers_and_metrics(spark):
    q = spark.createDataFrame([(1, "ctx", "who?", 4, "Bob")], "id int, context string, question string, category int, reference string")
    out = answering.answers(q, "echo", words=2).withColumn("prediction", answering.F.lit("bob")).select("id", "prediction", "reference")
    row = answering.evaluated(out, ["id"]).first()
    assert row["exact_match"] == 1 and row["f1"] == 1 and len(row) == 13 and row["rougeL_f"] == row["bert_f1"] == 1 and 0 <= row["sbert_similarity"] <= 1 + 1e-9
    assert answering.answers(q, "echo", words=1).first()["prediction"] == "Memories:"


def test_command_line(spark, tmp_path):
    log = str(tmp_path / "log")
    lines = [json.dumps({"type": "qa_result", "sample_id": str(i), "question_id": i + 1, "category": i, "metrics": {"f1": 0.5}}) for i in (1, 2)]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(log)
    cli.main(["extract", log, str(tmp_path / "csv"), "--category", "1"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1
    cli.main(["delete", log, "--samples", "1"])
    assert results.results(results.read_log(spark, log)).count() == 1
    with pytest.raises(SystemExit):
        cli.main(["delete", log])
    turns = spark.createDataFrame([("s", 0, "t", "A", "x")], "sample_id string, turn_seq long, date_time string, speaker string, text string")
    graph_store.append(ingest.facts(turns), str(tmp_path / "g"), "nodes")
    graph_store.append(spark.createDataFrame([], graph_store.TABLES["edges"]), str(tmp_path / "g"), "edges")
    cli.main(["clean", str(tmp_path / "g"), str(tmp_path / "h"), "--levels", "fact"])
    assert graph_store.load(spark, str(tmp_path / "h"), "nodes").count() == 0
    cli.main(["inspect", str(tmp_path / "g")])

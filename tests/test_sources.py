import json

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import graph
from sparkloom.sources import dataset, graph_store, results
from sparkloom.streaming import ingest

SAMPLE = {
    "qa": [{"question": "q0", "answer": "a", "evidence": ["D1:3", "nomark"], "category": 1}, {"question": "q1", "adversarial_answer": "b", "category": 5}, {"question": "q2", "answer": "c", "evidence": ["D2:1"]}],
    "conversation": {
        "speaker_a": "A", "speaker_b": "B",
        "session_10": [{"speaker": "A", "dia_id": "D10:1", "text": "late"}], "session_10_date_time": "day 10",
        "session_2": [
            {"speaker": "A", "dia_id": "D5:3", "text": "t", "img_url": ["u"], "blip_caption": "cap"}, {"speaker": "B", "dia_id": "D2:2", "img_url": "u", "blip_caption": "cap"},
            {"speaker": "A", "dia_id": "D2:4", "text": "only url", "img_url": "u"}, {"speaker": "A", "dia_id": "D2:5", "text": "", "blip_caption": "c"}, {"speaker": "B", "dia_id": "D2:6", "text": "plain"},
        ], "session_2_date_time": "day 2",
        "session_3": [{"speaker": "A", "dia_id": "D3:1", "text": "no time"}], "session_4": [], "session_4_date_time": "day 4", "session_5_date_time": "no list",
    },
    "event_summary": {}, "observation": {},
}


@pytest.fixture()
def samples(spark, tmp_path):
    path = tmp_path / "data.json"
    path.write_text(json.dumps([SAMPLE, {**SAMPLE, "session_summary": {"s": "x"}}], indent=1))
    return dataset.read_dataset(spark, str(path))


def test_turns(samples):
    rows = dataset.numbered(dataset.turns(samples)).where("sample_id = '0'").orderBy("turn_seq").collect()
    assert [r["text"] for r in rows] == ["[Image: cap] t", "[Image: cap]", "only url", "", "plain", "late"]
    assert [r["session_id"] for r in rows] == [2] * 5 + [10] and rows[0]["date_time"] == "day 2"
    assert [r["has_image"] for r in rows] == [True, True, True, True, False, False]


def test_questions(samples):
    rows = dataset.qa(samples).where("sample_id = '1'").orderBy("qa_idx").collect()
    assert [r["final_answer"] for r in rows] == ["a", "b", "c"] and rows[1]["evidence"] == []
    s = {r["sample_id"]: r for r in dataset.speakers(samples).collect()}
    assert s["0"]["session_summary"] == {} and s["1"]["session_summary"] == {"s": "x"} and s["0"]["speaker_b"] == "B"


def test_image_evidence_matches_by_suffix(samples):
    q, t = dataset.qa(samples), dataset.turns(samples)
    found = lambda strict: {(r["sample_id"], r["qa_idx"]) for r in dataset.image_evidence(q, t, strict).collect()}
    assert found(False) == {("0", 0), ("1", 0)} and found(True) == set()


def test_statistics(samples):
    assert dataset.dataset_statistics(samples).first().asDict() == {"samples": 2, "sessions": 4, "turns": 12, "questions": 6, "adversarial": 2}
    assert dataset.load_statistics(samples).first()["avg_images"] == 1
    assert dataset.load_statistics(samples.limit(0)).first()["avg_questions"] is None


def test_missing_file_and_question(spark, tmp_path):
    with pytest.raises(Exception):
        dataset.read_dataset(spark, str(tmp_path / "none.json")).count()
    path = tmp_path / "d.json"
    path.write_text(json.dumps([{**SAMPLE, "qa": [{"answer": "x"}]}]))
    with pytest.raises(Exception, match="no text"):
        dataset.qa(dataset.read_dataset(spark, str(path))).collect()


LINES = ["", "not json", '{"type": "metadata", "model": "m"}'] + [json.dumps({"type": "qa_result", "sample_id": s, "question_id": q, "question_id_in_sample": 9, "question": "q", "prediction": "p", "reference": "r", "category": c, "metrics": {"f1": 0.5}, "retrieved_nodes": ["n"]}) for s, q, c in (("0", 0, 1), ("0", 3, 2), ("1", 4, 1), ("1", 5, None))]


def test_results(spark, tmp_path):
    log = tmp_path / "log"
    spark.createDataFrame([(x,) for x in LINES], "value string").coalesce(1).write.text(str(log))
    lines = results.read_log(spark, str(log))
    flat = results.flattened(results.results(lines)).orderBy("question_id").collect()
    assert [r["question_id"] for r in flat] == [3, 4, 5, 9] and flat[2]["category_name"] == "Unknown" and flat[0]["category_name"] == "Temporal"
    assert flat[0]["f1"] == 0.5 and flat[0]["meteor"] is None
    left = lambda *a: sorted(r["line"][:12] for r in results.without(lines, *a).collect())
    assert len(left(["0"], [1])) == 5 and len(left(None, [1])) == 4 and len(left(["1"], None)) == 4 and "not json" in left(["1"], None)
    with pytest.raises(ValueError):
        results.without(lines)
    old = results.rewrite(spark, str(log), ["0"], None)
    assert results.read_log(spark, str(log)).count() == 4 and spark.read.text(old).count() == 7
    lines = results.read_log(spark, str(log))
    results.export(results.results(lines), str(tmp_path / "out"), "csv", 1)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1
    rec = results.results(lines).select("sample_id")
    for _ in range(2):
        results.append(rec, str(tmp_path / "sink"), "metadata")
        results.append(rec, str(tmp_path / "sink"), "qa_result")
    assert spark.read.json(str(tmp_path / "sink")).groupBy("type").count().orderBy("type").collect()[0]["count"] == rec.count()


def turns(spark, n):
    return spark.createDataFrame([(str(i % 2), i // 2, "t", "A", f"text {i}. more") for i in range(n)], "sample_id string, turn_seq long, date_time string, speaker string, text string")


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "graph")
    every = turns(spark, 10)
    every.where("turn_seq < 2").write.parquet(src)
    ingest.ingest(spark, src, every.schema.simpleString()[7:-1].replace(":", " "), root, 1).awaitTermination()
    every.where("turn_seq >= 2").write.mode("append").parquet(src)
    ingest.ingest(spark, src, every.schema.simpleString()[7:-1].replace(":", " "), root, 1).awaitTermination()
    got = graph_store.load(spark, root, "nodes").select("sample_id", "node_id", "content").collect()
    assert sorted(got) == sorted(ingest.facts(every).select("sample_id", "node_id", "content").collect())
    ingest.write_batch(every, root, 99)  # delivered again
    assert graph_store.load(spark, root, "nodes").count() == 10 and graph_store.load(spark, root, "docs").count() == 10
    graph_store.compact(spark, root, "nodes", str(tmp_path / "small"))
    assert spark.read.parquet(str(tmp_path / "small" / "nodes")).count() == 10


def test_event_windows_as_a_stream(spark, sf, tmp_path):
    src = str(tmp_path / "events")
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = ingest.event_counts(stream).writeStream.outputMode("append").format("memory").queryName("ev").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {(r["start"], r["event_type"]): r["n"] for r in ingest.event_counts(spark.read.parquet(src)).collect()}
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.sql("SELECT * FROM ev").collect()}
    assert got and all(batch[k] == v for k, v in got.items()) and len(batch) - len(got) <= 10  # the last day is open still

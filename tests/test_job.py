import json

import pytest
from pyspark.sql import functions as F

from sparkloom import __main__ as cli
from sparkloom.operators import job, providers, retrieval
from sparkloom.sources import graph_store


@pytest.fixture(scope="module")
def turns(spark):
    said = ["I adopted a cat named Tom.", "A cat named Tom is great.", "I work as a nurse.", "Nurses work hard.", "I adopted a cat named Tom."]
    rows = [(s, i, f"2024-01-0{i + 1} 09:00:00", "AB"[i % 2], t) for s in ("x", "y") for i, t in enumerate(said)]
    return spark.createDataFrame(rows, "sample_id string, turn_seq long, date_time string, speaker string, text string")


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(s, i, q, 4, r) for s in ("x", "y") for i, (q, r) in enumerate([("Who adopted a cat?", "A"), ("What is the work?", "nurse")])]
    return spark.createDataFrame(rows, "sample_id string, qa_idx int, question string, category int, reference string")


def test_whole_run_and_resume(spark, turns, questions, tmp_path):
    root, out, seen = str(tmp_path / "graph"), str(tmp_path / "log"), []
    first = job.run(spark, turns, questions.where("qa_idx = 0"), root, out, report=lambda *x: seen.append(x)).first()
    assert first["questions_processed_in_this_run"] == 2 and set(first["aggregate_metrics_for_this_run"]) == {"4", "overall"}
    assert first["category_distribution_in_this_run"] == {"4": 2} and len(first["aggregate_metrics_for_this_run"]["overall"]) == 12
    assert [n for n, _ in seen][:2] == ["facts", "evolution"] and dict(seen)["facts"] == 10 and dict(seen)["evolution"] > 0 and dict(seen)["personas"] == 2
    nodes = graph_store.load(spark, root, "nodes")
    counts = {r["level"]: r["n"] for r in nodes.groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert counts["fact"] == 10 and counts["persona"] == 2 and counts["scene"] >= 2 and nodes.where("level = 'scene' AND NOT refined").count() == 0
    seen.clear()
    second = job.run(spark, turns, questions, root, out, report=lambda *x: seen.append(x)).first()
    assert second["questions_processed_in_this_run"] == 2 and dict(seen)["facts"] == dict(seen)["evolution"] == dict(seen)["scenes"] == dict(seen)["refined scenes"] == 0
    assert graph_store.load(spark, root, "nodes").count() == nodes.count() and job.answered(spark, out).count() == 4
    report = job.graph_report(spark, root)
    assert "== persona" in report and "  to: " in report
    cli.main(["inspect", root, "--out", str(tmp_path / "report.txt")])
    assert (tmp_path / "report.txt").read_text() == report
    flat = spark.read.json(f"{out}/type=metadata")
    assert flat.count() == 1 and {"dataset", "ratio", "evaluation_start_time"} <= set(flat.columns)


@pytest.mark.parametrize("strategy", job.STRATEGIES)
def test_strategies_and_their_text(spark, turns, questions, tmp_path, strategy):
    root = str(tmp_path / "g")
    job.ingest_turns(spark, turns, root)
    nodes, edges = graph_store.load(spark, root, "nodes"), graph_store.load(spark, root, "edges")
    asked = questions.select("sample_id", F.col("qa_idx").alias("query_id"), F.col("question").alias("text"))
    got = job.related(asked, nodes, edges, strategy).collect()  # nothing is built: top_down falls back
    assert {(r["sample_id"], r["query_id"]) for r in got} == {(s, i) for s in "xy" for i in (0, 1)}
    assert job.related_text(asked, nodes, edges, strategy).where("context LIKE '[Index: 0]%'").count() == 4
    with pytest.raises(ValueError):
        job.related(asked, nodes, edges, "sideways")


def test_provider_decides_every_phase(spark, turns, questions, tmp_path):
    class Scripted:
        """Decides by what the prompt asks for."""

        def get_completion(self, prompt):
            if "new memory" in prompt:
                return json.dumps({"should_evolve": True, "actions": ["strengthen", "update_neighbor"], "suggested_connections": [0, 99], "new_context_neighborhood": ["changed"], "new_tags_neighborhood": [["t"]]})
            if "Sum up" in prompt:
                return json.dumps({"scene_summary": "a scene"})
            if "Describe the person" in prompt:
                return json.dumps({"interests": "cats", "values": "N/A"})
            if "profile add" in prompt:
                return json.dumps({"needs_enhancement": True, "addition": "likes cats a lot"})
            if "search keywords" in prompt:
                return '{"keywords": "cat"}'
            return '{"answer": "A"}'

    providers.register("scripted", lambda **_: Scripted())
    root, out = str(tmp_path / "graph"), str(tmp_path / "log")
    row = job.run(spark, turns, questions, root, out, backend="scripted", rewrite=True).first()
    nodes = graph_store.load(spark, root, "nodes")
    assert nodes.where("level = 'fact' AND context = 'changed'").count() > 0
    assert nodes.where("level = 'scene'").select("content").distinct().collect()[0][0] == "a scene\n[Insight]: likes cats a lot"
    assert [r["content"] for r in nodes.where("level = 'persona'").collect()] == ["cats", "cats"]
    assert {r["prediction"] for r in job.answered(spark, out).collect()} == {"A"} and row["aggregate_metrics_for_this_run"]["overall"]["exact_match"] == 0.5


def test_walk_falls_back_where_the_first_level_is_missing(spark):
    v = lambda *x: [float(a) for a in x]
    nodes = spark.createDataFrame([("a", "f1", 0, "fact", v(1, 0)), ("a", "f2", 1, "fact", v(0, 1)), ("b", "p", 0, "persona", v(1, 1)), ("b", "f3", 1, "fact", v(1, 0))], "sample_id string, node_id string, node_seq long, level string, vec array<double>")
    edges = spark.createDataFrame([], "sample_id string, src string, dst string, type string")
    queries = spark.createDataFrame([("a", 1, v(0, 2)), ("b", 2, v(1, 0))], "sample_id string, query_id int, vec array<double>")
    got = {(r["query_id"], r["stage"], r["rank"]): r["node_id"] for r in retrieval.top_down(queries, nodes, edges, ["sample_id"]).collect()}
    assert got == {(1, 0, 1): "f2", (1, 0, 2): "f1", (2, 1, 1): "p"}


def test_providers_speak_their_protocols(monkeypatch):
    sent = []

    def send(url, body, headers):
        sent.append((url, json.loads(body), headers))
        return json.dumps({"choices": [{"message": {"content": "{}"}}], "message": {"content": "ok"}}).encode()

    with pytest.raises(ValueError):
        monkeypatch.delenv("OPENAI_API_KEY", raising=False)
        providers.completion("openai", model="m")
    schema = {"properties": {"a": {"type": "array"}, "b": {"type": "string"}, "c": {"type": "number"}, "d": {"type": "boolean"}, "e": {"type": "object"}, "f": {"type": "null"}}}
    assert providers.completion("openai", model="m", api_key="k", send=send, schema=schema).get_completion("hi") == "{}"
    url, body, headers = sent[-1]
    assert url.endswith("/chat/completions") and headers["Authorization"] == "Bearer k" and body["temperature"] == 0.7 and body["max_tokens"] == 1000
    assert [m["role"] for m in body["messages"]] == ["system", "user"] and "json_schema" in body["response_format"]
    assert providers.completion("ollama", send=send).get_completion("hi") == "ok" and "temperature" not in sent[-1][1]

    def broken(url, body, headers):
        raise OSError("down")

    assert json.loads(providers.Ollama(send=broken, schema=schema).get_completion("x")) == {"a": [], "b": "", "c": 0, "d": False, "e": {}, "f": None}
    assert providers.Ollama(send=lambda *_: b"not json").get_completion("x") == "{}"
    local = providers.completion("local", model_path="p", make=lambda path: lambda prompt, **_: [{"generated_text": f"{path}:{prompt[-2:]}"}])
    assert local.get_completion("hi") == "p:hi"
    assert providers.fetch_models(["m"], load=lambda n: n) == {"m": "ready"}
    assert "ImportError" in providers.fetch_models(["m"], load=lambda n: (_ for _ in ()).throw(ImportError("none")))["m"]


def test_time_formats(spark):
    at = F.lit("2024-03-04 05:06:07").cast("timestamp")
    row = spark.range(1).select(*[job.timestamp(at, s).alias(s) for s in ("seconds", "minutes", "iso")]).first()
    assert tuple(row) == ("2024-03-04 05:06:07", "2024-03-04-05-06", "2024-03-04T05:06:07.000000")


def test_command_line_runs_the_job(spark, tmp_path):
    talk = {"speaker_a": "A", "speaker_b": "B", "session_1": [{"speaker": "A", "dia_id": "D1:1", "text": "I have a cat."}, {"speaker": "B", "dia_id": "D1:2", "text": "I have a dog."}], "session_1_date_time": "1 May"}
    sample = {"qa": [{"question": "Who has a cat?", "answer": "A", "evidence": ["D1:1"], "category": 4}], "conversation": talk, "event_summary": {}, "observation": {}}
    path = tmp_path / "data.json"
    path.write_text(json.dumps([sample, sample]))
    cli.main(["evaluate", str(path), str(tmp_path / "g"), str(tmp_path / "log"), "--ratio", "0.5"])
    assert job.answered(spark, str(tmp_path / "log")).count() == 1
    cli.main(["ingest", str(path), str(tmp_path / "g")])
    cli.main(["build", str(tmp_path / "g")])
    assert graph_store.load(spark, str(tmp_path / "g"), "nodes").where("level = 'fact'").count() == 4

"""The stream evolves facts as the whole job does."""

import pytest

from sparkloom.operators import job
from sparkloom.sources import graph_store
from sparkloom.streaming import evolution

TURN = "sample_id string, turn_seq long, date_time string, speaker string, text string"
SAID = ["I adopted a cat named Tom.", "A cat named Tom is great.", "I work as a nurse.", "Nurses work hard.", "I adopted a cat named Tom.", "", "cat cat cat", "What a day. What a night."]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(s, i, f"2024-01-0{i + 1} 09:00:00", "AB"[i % 2], t) for s in "xy" for i, t in enumerate(SAID)], TURN).coalesce(1)


def graph(spark, root):
    load = lambda name, *cols: sorted(map(str, graph_store.load(spark, root, name).select(*cols).collect()))
    return load("nodes", "sample_id", "node_id", "content", "keywords"), load("edges", "sample_id", "src", "dst", "type"), load("evolved", "sample_id", "node_id"), load("docs", "node_id", "text"), load("embeddings", "node_id", "vec")


def test_stream_equals_batch_with_its_links(spark, turns, tmp_path):
    src, root, whole = str(tmp_path / "in"), str(tmp_path / "graph"), str(tmp_path / "whole")
    turns.where("turn_seq < 3").write.parquet(src)
    evolution.ingest_evolving(spark, src, TURN, root, 1).awaitTermination()
    part = graph(spark, root)
    # the stream is started again: new turns meet those of the first run, one comes a second time
    turns.where("turn_seq >= 2").write.mode("append").parquet(src)
    evolution.ingest_evolving(spark, src, TURN, root, 1).awaitTermination()
    job.ingest_turns(spark, turns, whole)
    got = graph(spark, root)
    assert got == graph(spark, whole)
    assert len(part[0]) == 6 and len(got[0]) == 16 and len(got[1]) > len(part[1])
    assert graph_store.manifest(spark, root).where("phase = 'facts'").count() == 2
    # nothing is left for the job to do
    seen = []
    job.ingest_turns(spark, turns, root, report=lambda *x: seen.append(x))
    assert seen == [("facts", 0), ("evolution", 0)]



def test_a_key_s_batch_is_one_read_and_one_append():
    """However many words its turns have: every call to the state is a round trip to the executor."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    from sparkloom.streaming import ingest

    calls, stored = [], []
    state = SimpleNamespace(get=lambda: calls.append("get") or iter(list(stored)), appendList=lambda rows: calls.append("append") or stored.extend(rows))
    index = evolution.Index(2)
    index.init(SimpleNamespace(getListState=lambda name, schema: state))
    facts = [Row(**dict.fromkeys(ingest.NODE_FIELDS) | {"node_id": str(i), "node_seq": i}, doc_words=t, words=t, vec=[1.0, i], doc_vec=[1.0, i]) for i, t in enumerate(["a b c d", "", "a a b"])]
    first, again = list(index.handleInputRows(("x",), iter(facts[:2]), None)), list(index.handleInputRows(("x",), iter(facts), None))
    assert calls == ["get", "append"] * 2 and [len(r.near) for r in first + again] == [1, 2, 2]
    assert len(stored) == 3

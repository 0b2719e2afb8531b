"""The commit log: what is cut off leaves nothing behind, and what is missing is done again."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import job
from sparkloom.sources import graph_store
from sparkloom.streaming import ingest

TURN = "sample_id string, turn_seq long, date_time string, speaker string, text string"


@pytest.fixture(scope="module")
def turns(spark):
    said = ["I adopted a cat named Tom.", "A cat named Tom is great.", "I work as a nurse.", "Nurses work hard.", "I adopted a cat named Tom."]
    return spark.createDataFrame([(s, i, f"2024-01-0{i + 1} 09:00:00", "AB"[i % 2], t) for s in "xy" for i, t in enumerate(said)], TURN).coalesce(1)


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """These runs are many small jobs."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def whole(spark, root):
    """All rows of all tables."""
    return {name: sorted(map(str, graph_store.load(spark, root, name).collect())) for name in graph_store.TABLES}


def all_phases(spark, turns, root):
    job.ingest_turns(spark, turns, root)
    job.build(spark, root)
    job.refine(spark, root)


@pytest.fixture(scope="module")
def uncut(spark, turns, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("uncut"))
    all_phases(spark, turns, root)
    return whole(spark, root)


def test_cut_at_every_write(spark, turns, uncut, tmp_path, monkeypatch):
    """Each write fails once: after some rows are written, and before a manifest is. The next attempt goes on from there."""
    cut, add, finish = set(), graph_store.Commit.add, graph_store.Commit.finish

    def fail_once(site):
        if site not in cut:
            cut.add(site)
            raise ConnectionError(site)

    def failing_add(self, df, name):
        n = add(self, df, name)
        fail_once((self.phase, name))
        return n

    def failing_finish(self):
        fail_once((self.phase, "manifest"))
        finish(self)

    monkeypatch.setattr(graph_store.Commit, "add", failing_add)
    monkeypatch.setattr(graph_store.Commit, "finish", failing_finish)
    root, attempts = str(tmp_path / "g"), 0
    while True:
        try:
            all_phases(spark, turns, root)
            break
        except ConnectionError:
            attempts += 1
    assert attempts == len(cut) == 15 and {p for p, _ in cut} == {"facts", "evolution", "scenes", "personas", "refined scenes"}
    assert whole(spark, root) == uncut
    assert uncut["edges"] and graph_store.manifest(spark, root).count() == 5


def test_new_turns_meet_the_old_ones(spark, turns, tmp_path):
    """In two parts or one: the same facts, the same links."""
    parts, one = str(tmp_path / "parts"), str(tmp_path / "one")
    for some in (turns.where("turn_seq < 2"), turns):
        job.ingest_turns(spark, some, parts)
    job.ingest_turns(spark, turns, one)
    assert whole(spark, parts) == whole(spark, one)


def test_damage_is_found_and_mended(spark, turns, uncut, tmp_path):
    root = str(tmp_path / "g")
    all_phases(spark, turns, root)
    assert graph_store.damaged(spark, root).count() == 0 and graph_store.repair(spark, root) == []
    # the index alone: made again from the nodes
    shutil.rmtree(glob.glob(f"{root}/docs/commit=*")[0])
    assert graph_store.load(spark, root, "docs").count() == 0
    assert graph_store.repair(spark, root) == [] and ingest.rebuild_index(spark, root) == 10 and ingest.rebuild_index(spark, root) == 0
    assert whole(spark, root) == uncut
    # files of a commit that can't be made from others: it is taken back and its work is done again
    for f in glob.glob(f"{root}/edges/commit=evolution-*/*.parquet"):
        os.truncate(f, 7)
    (gone,) = graph_store.repair(spark, root)
    assert gone.startswith("evolution-")
    job.ingest_turns(spark, turns, root)
    assert whole(spark, root) == uncut


def test_a_committed_batch_is_left_out(spark, turns, tmp_path):
    root = str(tmp_path / "g")
    assert ingest.write_batch(turns, root, 0, "s:0") == 10 and ingest.write_batch(turns, root, 0, "s:0") == 0
    assert ingest.write_batch(turns, root, 0, "t:0") == 10  # another stream's batch of the same number
    assert graph_store.load(spark, root, "nodes").count() == 10


def test_clustering_that_fails(spark, turns, monkeypatch):
    from pyspark.errors import PySparkValueError

    facts = ingest.facts(turns)

    def broken(*_, **__):
        raise PySparkValueError("CANNOT_BE_NONE", {"arg_name": "x"})

    monkeypatch.setattr(job, "semi_synchronous", broken)
    got = job.communities(facts, facts.select("sample_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst")))
    assert {r["community"] for r in got.collect()} == {0} and got.count() == 10


def test_answers_by_category(spark, tmp_path):
    """Memories by category, the fifth category left out, numbers from 1 among those that are allowed."""
    rows = [("x", i, f"2024-01-01 09:{i:02d}:00", "A", f"thing number {i} is here.") for i in range(40)]
    root, out = str(tmp_path / "g"), str(tmp_path / "log")
    job.ingest_turns(spark, spark.createDataFrame(rows, TURN), root)
    asked = spark.createDataFrame([("x", i, f"what thing {c}?", c, "r") for i, c in enumerate([1, 5, 2, 3, 4])], "sample_id string, qa_idx int, question string, category int, reference string")
    assert job.answer(spark, root, asked, out, "flat") == 4
    got = {r["category"]: (r["question_id_in_sample"], len(r["retrieved_nodes"])) for r in job.answered(spark, out).collect()}
    assert got == {"1": (1, 35), "2": (2, 25), "3": (3, 30), "4": (4, 25)}
    assert job.answer(spark, root, asked, str(tmp_path / "other"), "graph_traversal", k=2, categories=(2,)) == 1
    (row,) = job.answered(spark, str(tmp_path / "other")).collect()
    assert len(row["retrieved_nodes"]) == 2


def test_stored_tables_follow_their_input(spark, tmp_path):
    from sparkloom.plans import model

    def put(texts, mode):
        spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.mode(mode).parquet(f"{tmp_path}/conversations.parquet")
        return model.stored(spark, str(tmp_path), "turns", lambda: model.turns(spark, str(tmp_path))).count()

    assert put(["a"], "overwrite") == 1 and put(["b", "c"], "append") == 3

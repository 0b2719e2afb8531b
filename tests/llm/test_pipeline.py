from pyspark.sql import functions as F

import corpus_pipeline
from corpus_pipeline import STAGES


def test_pipeline_stage_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), name)
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and left and left <= ids
        assert name not in ("language",) or len(left) >= 0.98 * len(ids)
        assert docs.where("n_chars <> length(text)").count() == 0
        ids = left
    pieces = STAGES[-1][1](spark, docs, sf)
    whole = corpus_pipeline.run(spark, sf)
    assert {tuple(r) for r in pieces.collect()} == {tuple(r) for r in whole.collect()}
    assert {r["doc_id"] for r in whole.select("doc_id").collect()} == ids
    assert [n for n, _ in STAGES] == ["language", "line_dedup", "near_dedup", "suffix_dedup", "pack"]


def test_stages_take_empty_and_null_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in STAGES:
        assert stage(spark, docs, sf).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "y"), (3, "words of a text", "en", "s", 15, "z")], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    for name, stage in STAGES[1:4]:
        assert {r["doc_id"] for r in stage(spark, odd, sf).collect()} == {1, 2, 3}, name


def test_language_and_packing_take_empty_and_null_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "12 345 --", None, "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(STAGES)["language"](spark, docs.unionByName(odd.select([F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])), sf)
    assert kept.columns == docs.columns and not {-1, -2, -3} & {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert kept.where("text IS NULL OR text = ''").count() == 0
    got = {}
    for r in dict(STAGES)["pack"](spark, odd, sf).orderBy("doc_id", "start").collect():  # a document may be cut
        assert r["start"] == got.setdefault(r["doc_id"], [0, r["doc_tokens"]])[0]
        got[r["doc_id"]][0] += r["length"]
    assert set(got) == {-1, -2, -3} and got[-1] == got[-2] == [1, 1] and got[-3][0] == got[-3][1] > 1

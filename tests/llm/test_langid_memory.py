"""The workers that find languages are handed a text once."""

from sparkloom.llm import langid
from sparkloom.llm.queries import tokenizer


def test_texts_are_handed_over_once(spark):
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("the dog", "en"), (None, "en"), ("123", "fr")] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = langid.accepted(docs, tokenizer("piece_bpe_32k.model"))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    fed = plan[plan.index("MapInArrow") :].splitlines()[1:]
    assert fed and not any("cast(text" in x or "AS _sl_text" in x or x.count("text#") > 1 for x in fed)
    assert kept.columns == docs.columns and [(r["doc_id"], r["text"], r["lang"]) for r in kept.orderBy("doc_id").collect()] == [(i, t, lang) for i, t, lang, _ in rows if t and t != "123"]

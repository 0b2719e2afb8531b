"""Answering questions from retrieved memories: prompt, completion, clean-up, metrics.

Prompts are column expressions; a provider (see providers.py) turns them into replies. Replies are parsed by the
expressions of functions.text, so only the provider itself runs in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import metrics, text as T
from sparkloom.functions.vector import cosine
from sparkloom.operators import embedder, providers

_ASK = {
    "choice": "Choose one of the options the question names and reply with it alone.",
    "yes_no": "Reply Yes, No, Likely or Unlikely.",
    "count": "Reply with the number alone, in digits.",
    "open": "Reply with a short phrase, in the memories' own words where they have them.",
}
_TIME = "Take the time of the memory that tells of the event as the date of reference, and give dates as day month, year."


def instruction(question: Column | str, category: Column | str) -> Column:
    """What a question of its category and kind is to be answered with."""
    kind = T.question_class(question, category)
    out = F.lit(_ASK["open"])
    for name in ("choice", "yes_no", "count"):
        out = F.when(kind == name, _ASK[name]).otherwise(out)
    return F.when(T._c(category) == 2, F.concat(out, F.lit(" " + _TIME))).otherwise(out)


def answer_prompt(context: Column | str, question: Column | str, category: Column | str) -> Column:
    return F.concat(F.lit("Memories:\n"), T._c(context), F.lit("\nQuestion: "), T._c(question), F.lit("\n"), instruction(question, category), F.lit('\nReply as JSON: {"answer": ...}'))


def keyword_prompt(question: Column | str) -> Column:
    return F.concat(F.lit('Give the search keywords of this question as JSON {"keywords": "a, b"}.\nQuestion: '), T._c(question))


def keywords_of(reply: Column | str) -> Column:
    """The keywords field of the first to last brace of a reply, else the reply itself."""
    body = F.regexp_extract(T._c(reply), T.BRACES, 0)
    return F.coalesce(F.when(F.try_parse_json(body).isNotNull(), F.get_json_object(body, "$.keywords")), T.strip(reply))


def scene_prompt(rendered: Column | str) -> Column:
    return F.concat(F.lit('Sum up what these facts tell in common, as JSON {"scene_summary": ..., "keywords": [...], "tags": [...]}.\n'), T._c(rendered))


def persona_prompt(scenes: Column | str) -> Column:
    return F.concat(F.lit("Describe the person these scenes are about, as JSON with basic_info, interests, personality, values and relationships (N/A where nothing is known).\n"), T._c(scenes))


def refinement_prompt(scene: Column | str, profile: Column | str) -> Column:
    return F.concat(F.lit('Does the profile add something to the scene? JSON {"needs_enhancement": ..., "addition": ..., "reason": ...}.\nProfile:\n'), T._c(profile), F.lit("\nScene:\n"), T._c(scene))


def filter_prompt(memories: Column | str, question: Column | str) -> Column:
    return F.concat(F.lit('Which of these memories matter to the question? JSON {"relevant_parts": ...}.\nQuestion: '), T._c(question), F.lit("\n"), T._c(memories))


def answers(questions: DataFrame, backend: str, **settings) -> DataFrame:
    """questions(context, question, category, ..) with prompt, reply and the cleaned prediction."""
    asked = questions.withColumn("prompt", answer_prompt("context", "question", "category"))
    replied = providers.complete(asked, "prompt", "reply", backend, **settings)
    return replied.withColumn("prediction", T.unwrap_answer(T.answer_clean(T.answer_pick("reply"))))


def evaluated(predictions: DataFrame, key: list[str], model: DataFrame | None = None) -> DataFrame:
    """key and the twelve metrics of predictions(prediction, reference). With a model of token vectors (embedder.fit), those
    two that compare meanings are by its vectors."""
    record = metrics.metric_record(predictions, key)
    if model is None:
        return record
    bert = embedder.bert_scores(predictions, key, model).select(*key, F.col("bert_f1").alias("bert_"))
    alike = embedder.encode_all(predictions, key, ["prediction", "reference"], model).select(*key, cosine("prediction", "reference").alias("alike_"))
    both = record.join(bert, key).join(alike, key)
    return both.withColumns({"bert_f1": F.col("bert_"), "sbert_similarity": F.col("alike_")}).select(record.columns)

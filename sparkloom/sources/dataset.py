"""Multi-session conversation datasets: a JSON array of samples, opened into flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import schemas


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """One row a sample: sample_id (its place in the file, as text) and the sample. A missing file raises.

    Where a folder holds several files, the file's name goes before the place, so that samples don't clash."""
    files = spark.read.text(path, wholetext=True)
    several = len(files.inputFiles()) > 1  # names alone
    rows = explode_samples(files.select(F.col("value").alias("json"), F.input_file_name().alias("file")), extra=["file"])
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    return rows.select((F.concat_ws(":", name, "sample_id") if several else F.col("sample_id")).alias("sample_id"), "sample")


def explode_samples(files: DataFrame, json: str = "json", extra: list[str] = []) -> DataFrame:
    """The same from a column that holds whole files."""
    return files.select(*extra, F.posexplode(F.from_json(json, schemas.DATASET)).alias("i", "sample")).select(*extra, F.col("i").cast("string").alias("sample_id"), "sample")


def speakers(samples: DataFrame) -> DataFrame:
    talk = F.col("sample.conversation")
    return samples.select("sample_id", talk["speaker_a"].alias("speaker_a"), talk["speaker_b"].alias("speaker_b"), F.coalesce("sample.session_summary", F.create_map().cast("map<string,string>")).alias("session_summary"))


def fused_text(text: Column, img_url: Column, caption: Column) -> Column:
    """A picture's caption goes before the text if both its url and its caption are there."""
    note = F.concat(F.lit("[Image: "), caption, F.lit("]"))
    return F.when(img_url.isNotNull() & caption.isNotNull(), F.when(F.coalesce(text, F.lit("")) == "", note).otherwise(F.concat(note, F.lit(" "), text))).otherwise(F.coalesce(text, F.lit("")))


def turns(samples: DataFrame) -> DataFrame:
    """sample_id, session_id, turn_pos, date_time, speaker, dia_id, text, has_image of sessions with a time and turns.

    A session is a key session_<n> that holds a list; its time is the key session_<n>_date_time."""
    entries = samples.select("sample_id", F.col("sample.conversation").alias("talk"), F.explode("sample.conversation").alias("key", "value")).where(F.col("key").startswith("session_") & F.ltrim("value").startswith("["))
    rows = entries.select("sample_id", F.expr("try_cast(split(key, '_')[1] AS int)").alias("session_id"), F.expr("talk[concat(key, '_date_time')]").alias("date_time"), F.from_json("value", f"array<{schemas.TURN}>").alias("turns"))
    rows = rows.where(F.coalesce("date_time", F.lit("")) != "")
    return rows.select("sample_id", "session_id", "date_time", F.posexplode("turns").alias("turn_pos", "t")).select(
        "sample_id", "session_id", "turn_pos", "date_time", "t.speaker", "t.dia_id", fused_text(F.col("t.text"), F.col("t.img_url"), F.col("t.blip_caption")).alias("text"), (F.col("t.img_url").isNotNull() | F.col("t.blip_caption").isNotNull()).alias("has_image"),
    )


def numbered(turn_rows: DataFrame, keys: list[str] = ["sample_id"]) -> DataFrame:
    """Turns in session order (by number, not by name), then turn order, counted from 0 as turn_seq."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("session_id", "turn_pos")
    return turn_rows.withColumn("turn_seq", (F.row_number().over(w) - 1).cast("long"))


def qa(samples: DataFrame) -> DataFrame:
    """Questions with their defaults; a question without text raises, as it would be answered with nothing to ask."""
    q = samples.select("sample_id", F.posexplode("sample.qa").alias("qa_idx", "q"))
    text = F.when(F.col("q.question").isNull(), F.raise_error(F.lit("a question has no text")).cast("string")).otherwise(F.col("q.question"))
    return q.select("sample_id", "qa_idx", text.alias("question"), "q.answer", "q.adversarial_answer", "q.category", F.coalesce("q.evidence", F.array().cast("array<string>")).alias("evidence")).withColumn("final_answer", final_answer("category", "answer", "adversarial_answer"))


def final_answer(category: str, answer: str, adversarial: str) -> Column:
    return F.when(F.col(category) == 5, F.col(adversarial)).otherwise(F.col(answer))


def image_evidence(questions: DataFrame, turn_rows: DataFrame, strict: bool = False) -> DataFrame:
    """sample_id, qa_idx of questions whose evidence X:n names a turn with a picture: one whose dia_id ends with n, or,
    if strict, is X:n."""
    marks = questions.select("sample_id", "qa_idx", F.explode("evidence").alias("e")).where(F.col("e").contains(":"))
    seen = turn_rows.where("has_image").select(F.col("sample_id").alias("s"), "dia_id")
    hit = F.col("dia_id") == F.col("e") if strict else F.col("dia_id").endswith(F.split("e", ":")[1])
    return marks.join(seen, (F.col("sample_id") == F.col("s")) & hit, "left_semi").select("sample_id", "qa_idx").distinct()


def dataset_statistics(samples: DataFrame) -> DataFrame:
    """One row: samples, questions, sessions, turns, questions with an adversarial answer."""
    t, q = turns(samples), qa(samples)
    a = samples.agg(F.count("*").alias("samples"))
    b = t.agg(F.countDistinct("sample_id", "session_id").alias("sessions"), F.count("*").alias("turns"))
    c = q.agg(F.count("*").alias("questions"), F.count("adversarial_answer").alias("adversarial"))
    return a.crossJoin(b).crossJoin(c)  # three one-row frames


def load_statistics(samples: DataFrame) -> DataFrame:
    """One row: questions and image questions in all, and their average, least and most by sample (null: no sample)."""
    q = qa(samples)
    images = image_evidence(q, turns(samples)).groupBy("sample_id").agg(F.count("*").alias("images"))
    per = samples.select("sample_id").join(q.groupBy("sample_id").agg(F.count("*").alias("n")), "sample_id", "left").join(images, "sample_id", "left").fillna(0, ["n", "images"])
    return per.agg(F.sum("n").alias("questions"), F.sum("images").alias("image_questions"), F.avg("n").alias("avg_questions"), F.min("n").alias("min_questions"), F.max("n").alias("max_questions"), F.avg("images").alias("avg_images"))

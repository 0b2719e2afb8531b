"""Result logs: JSON lines of several record types. Unreadable lines survive every rewrite."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.operators.stats import with_category_names

# The metrics of a record, in the order they are exported.
METRICS = ("exact_match", "f1", "rouge1_f", "rouge2_f", "rougeL_f", "bleu1", "bleu2", "bleu3", "bleu4", "bert_precision", "bert_recall", "bert_f1", "meteor", "sbert_similarity")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def results(lines: DataFrame, line: str = "line") -> DataFrame:
    """The question results of a log; blank and unreadable lines and other records are skipped."""
    r = F.from_json(line, schemas.RESULT, {"mode": "PERMISSIVE"})
    return lines.select(r.alias("r")).where("r.type = 'qa_result'").select("r.*").withColumn("category", F.expr("try_cast(category AS int)"))


def flattened(rows: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One column a metric, the question's number (0 and null fall back to its place in the sample), the category's name."""
    number = F.coalesce(F.nullif("question_id", F.lit(0)), F.col("question_id_in_sample"))
    named = with_category_names(rows)
    return named.select("sample_id", number.alias("question_id"), "category", "category_name", "question", "reference", "prediction", *[F.col("metrics")[m].alias(m) for m in metrics])


def extract(rows: DataFrame, category: int | None = None) -> DataFrame:
    return rows if category is None else rows.where(F.col("category") == category)


def matching(line: Column, samples: list[str] | None, categories: list[int] | None) -> Column:
    """Whether a line is a result of one of the samples and of one of the categories (omitted: of any). Never null."""
    if samples is None and categories is None:
        raise ValueError("samples or categories must be given")
    hit = F.get_json_object(line, "$.type") == "qa_result"
    if samples is not None:
        hit = hit & F.get_json_object(line, "$.sample_id").isin(*samples)
    if categories is not None:
        hit = hit & F.get_json_object(line, "$.category").try_cast("int").isin(*categories)
    return F.coalesce(hit, F.lit(False))


def without(lines: DataFrame, samples: list[str] | None = None, categories: list[int] | None = None, line: str = "line") -> DataFrame:
    """The log without matching results and blank lines; other records and unreadable lines stay."""
    return lines.where((F.trim(line) != "") & ~matching(F.col(line), samples, categories))


def rewrite(spark: SparkSession, path: str, samples: list[str] | None = None, categories: list[int] | None = None) -> str:
    """Delete from a log: written anew beside it, the old one kept as a backup whose path is returned. A run that stopped
    between the two renames is mended first: its new lines are complete then, and take the log's place."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    new, old = f"{path}.new", f"{path}.bak-{uuid.uuid4().hex}"
    if fs.exists(at(f"{new}/_SUCCESS")) and not fs.exists(at(path)):
        fs.rename(at(new), at(path))
    fs.delete(at(new), True)
    without(read_log(spark, path), samples, categories).select("line").write.text(new)
    if not (fs.rename(at(path), at(old)) and fs.rename(at(new), at(path))):
        raise OSError(f"could not replace {path}; its lines are in {old} and {new}")
    return old


def append(rows: DataFrame, path: str, record_type: str) -> None:
    """Add records to a log directory, one folder a record type; metadata only if there is none yet."""
    target = f"{path}/type={record_type}"
    if record_type == "metadata":
        spark = rows.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return
    rows.write.mode("append").json(target)


def export(rows: DataFrame, path: str, fmt: str = "csv", category: int | None = None) -> None:
    """Flattened CSV with a header, or JSON lines, of one category or all."""
    if fmt == "csv":
        flattened(extract(rows, category)).write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "jsonl":
        extract(rows, category).write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")

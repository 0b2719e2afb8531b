"""Grouped statistics, samples of the head, anti-joins for resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import strip

# The categories of questions.
CATEGORIES = {1: "Multi-Hop", 2: "Temporal", 3: "Open-Domain", 4: "Single-Hop", 5: "Adversarial"}


def long_form(df: DataFrame, key: list[str], metrics: list[str]) -> DataFrame:
    """key, metric, value; a null metric is an absent row."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*key, F.explode(pairs).alias("x")).select(*key, "x.metric", "x.value").where("value is not null")


#: Cells that a group's values are first counted by.
CELLS = 1024
_NONE = "\0"  # stands for a null category where groups are joined


def medians(values: DataFrame, by: list[str]) -> DataFrame:
    """by, median of (by.., value): by selection in two passes, so no task sorts or holds a whole group. Values are counted by
    cell between a group's least and greatest, which tells the cells that hold the middle ones; the different values of these
    cells alone are then counted in order. The columns of `by` aren't null."""
    span = values.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * CELLS), F.lit(CELLS - 1))).otherwise(F.lit(0))
    placed = values.join(F.broadcast(span), by).withColumn("cell", place)  # a row a metric and category
    upto = Window.partitionBy(*by).orderBy("cell")
    cells = placed.groupBy(*by, "n", "cell").agg(F.count("*").alias("c")).withColumn("to", F.sum("c").over(upto))  # CELLS rows a group at most
    # the middle places, the same one twice if there is an odd number
    first, second = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    middle = cells.withColumn("before", F.col("to") - F.col("c")).where((first <= F.col("to")) & (second > F.col("before")))
    inside = placed.join(F.broadcast(middle.select(*by, "cell", "before")), [*by, "cell"]).groupBy(*by, "n", "cell", "before", "value").agg(F.count("*").alias("c"))
    run = F.col("before") + F.sum("c").over(Window.partitionBy(*by, "cell").orderBy("value"))
    ranked = inside.withColumn("to", run)
    has = lambda at: (at <= F.col("to")) & (at > F.col("to") - F.col("c"))
    return ranked.groupBy(*by).agg(((F.max(F.when(has(first), F.col("value"))) + F.max(F.when(has(second), F.col("value")))) / 2).alias("median"))


def aggregate_metrics(values: DataFrame) -> DataFrame:
    """(category, metric, value) -> statistics a metric, overall and by category (null: a scope of its own)."""
    scopes = F.array(F.lit("overall"), F.coalesce(F.col("category").cast("string"), F.lit(_NONE)))
    rows = values.select(F.explode(scopes).alias("scope"), "metric", F.col("value").cast("double").alias("value")).where("value IS NOT NULL")
    # sums and counts are combined in the mappers
    flat = rows.groupBy("scope", "metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"))
    both = flat.join(medians(rows, ["scope", "metric"]), ["scope", "metric"])
    return both.select(F.when(F.col("scope") != _NONE, F.col("scope")).alias("scope"), "metric", "mean", "std", "median", "min", "max", "n")


def share(df: DataFrame, by: str) -> DataFrame:
    """by, n, percent of all rows."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def with_category_names(df: DataFrame, category: str = "category") -> DataFrame:
    names = df.sparkSession.createDataFrame(list(CATEGORIES.items()), f"{category} int, category_name string")
    # five fixed rows
    return df.join(F.broadcast(names), category, "left").withColumn("category_name", F.coalesce("category_name", F.lit("Unknown")))


def head_sample(df: DataFrame, order: str, ratio: float, share: int = 100_000) -> DataFrame:
    """The first max(1, int(n * ratio)) rows by order (a whole number): not random. Gaps don't matter.

    Rows are counted by ranges of `share` order values; a range before the cut is taken whole, only the one that holds it
    is ranked."""
    if not 0 < ratio <= 1:
        raise ValueError("ratio must be over 0 and at most 1")
    cell = F.floor(F.col(order) / share)
    counts = df.groupBy(cell.alias("cell_")).agg(F.count("*").alias("c_"))
    before = Window.orderBy("cell_").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    want = F.greatest(F.lit(1), F.floor(F.sum("c_").over(Window.partitionBy()) * F.lit(float(ratio))))
    cells = counts.select("cell_", (want - F.coalesce(F.sum("c_").over(before), F.lit(0))).alias("left_"), "c_").where("left_ > 0")
    rows = df.withColumn("cell_", cell).join(cells, "cell_")
    ranked = rows.where("left_ < c_").withColumn("r_", F.row_number().over(Window.partitionBy("cell_").orderBy(order))).where("r_ <= left_")
    return rows.where("left_ >= c_").select(df.columns).unionByName(ranked.select(df.columns))


def unanswered(questions: DataFrame, answered: DataFrame, keys: list[str], by_text: bool = True, idx: str = "qa_idx") -> DataFrame:
    """Questions without an answer: by their trimmed text, or by their place."""
    if not by_text:
        return questions.join(answered.select(*keys, idx), [*keys, idx], "left_anti")
    done = answered.select(*keys, strip("question").alias("q_")).distinct()
    return questions.withColumn("q_", strip("question")).join(done, [*keys, "q_"], "left_anti").drop("q_")

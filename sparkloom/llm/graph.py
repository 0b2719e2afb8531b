"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def components(edges: DataFrame) -> DataFrame:
    """(v, c): every vertex of edges(u, v) with the smallest vertex it reaches.

    Labels go to neighbours by minimum (pre-aggregated before the shuffle), then jump to their label's label, so long
    chains shrink in few rounds. A round is written to the shared folder; only a count of changes comes to the driver.
    """
    both = materialise(edges.where("u <> v").select("u", "v").unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    table = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("c")).withColumnRenamed("u", "v"), "labels")
    while True:
        labels = table.select("v", "c")
        near = both.join(labels, "v").groupBy(F.col("u").alias("v")).agg(F.min("c").alias("m"))
        low = labels.join(near, "v").select("v", F.least("c", "m").alias("c"), F.col("c").alias("old"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("j"))
        new = materialise(low.join(jump, "c").select("v", F.least("c", "j").alias("c"), "old"), "labels")
        release(table)
        table = new
        if new.where("c <> old").isEmpty():
            release(both)
            return new.select("v", "c")

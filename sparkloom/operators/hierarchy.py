"""Rolling facts up to scenes and scenes to personas.

A summariser turns a rendered list into text. The default is deterministic and offline: the list itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import dimension_label, strip
from sparkloom.functions.vector import cosine

#: Profile dimensions, and how scenes are linked to personas.
DIMENSIONS = ("basic_info", "interests", "personality", "values", "relationships")
LINK_LEAST, LINK_SHARE, LINK_SCORE = 5, 5, 0.2


def ordered_text(lines: Column, order: Column, sep: str = "\n") -> Column:
    """Aggregate: lines joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), lines.alias("t")))), lambda s: s["t"]), sep)


def fact_line() -> Column:
    return F.concat(F.lit("- ["), F.coalesce("timestamp", F.lit("")), F.lit("] "), F.col("content"))


def build_scenes(facts: DataFrame, communities: DataFrame, keys: list[str], summarise: Callable[[Column], Column] = lambda x: x) -> tuple[DataFrame, DataFrame]:
    """(scene nodes, contains edges): one scene a community; its time is its latest fact's."""
    of = facts.join(communities, [*keys, "node_id"])
    scene_id = F.concat(F.lit("s_"), *[F.col(k) for k in keys], F.lit("_"), F.col("community").cast("string"))
    rolled = of.groupBy(*keys, "community").agg(ordered_text(fact_line(), F.col("node_seq")).alias("rendered"), F.max("timestamp").alias("timestamp"), F.count("*").alias("n_facts"))
    scenes = rolled.select(*keys, scene_id.alias("node_id"), F.col("community").alias("node_seq"), F.lit("scene").alias("level"), summarise(F.col("rendered")).alias("content"), "timestamp", "n_facts")
    edges = of.select(*keys, scene_id.alias("src"), F.col("node_id").alias("dst"), F.col("node_seq").alias("edge_seq"), F.lit("contains").alias("type"))
    return scenes, edges


def build_personas(profiles: DataFrame, keys: list[str], existing: DataFrame | None = None) -> DataFrame:
    """One node a dimension that says something; samples that have personas already are skipped."""
    if existing is not None:
        profiles = profiles.join(existing.where("level = 'persona'").select(*keys).distinct(), keys, "left_anti")
    dims = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(i).alias("i"), F.col(d).alias("content")) for i, d in enumerate(DIMENSIONS)])
    rows = profiles.select(*keys, F.explode(dims).alias("x")).where((F.coalesce("x.content", F.lit("")) != "") & (F.col("x.content") != "N/A"))
    return rows.select(*keys, F.concat(F.lit("p_"), *[F.col(k) for k in keys], F.lit("_"), F.col("x.dimension")).alias("node_id"), F.col("x.i").cast("long").alias("node_seq"), F.lit("persona").alias("level"), F.col("x.content").alias("content"), dimension_label("x.dimension").alias("tag"))


def link_personas(personas: DataFrame, scenes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, src, dst, weight: a persona contains its nearest scenes, a fifth of them or five, above a floor."""
    p = personas.select(*keys, F.col("node_id").alias("src"), F.col("vec").alias("p_vec"))
    s = scenes.select(*keys, F.col("node_id").alias("dst"), F.col("node_seq").alias("s_seq"), F.col("vec").alias("s_vec"))
    pairs = p.join(s, keys).select(*keys, "src", "dst", "s_seq", F.round(cosine("p_vec", "s_vec"), 9).alias("weight"))
    n = F.count("*").over(Window.partitionBy(*keys, "src"))
    r = F.row_number().over(Window.partitionBy(*keys, "src").orderBy(F.desc("weight"), F.desc("s_seq")))
    return pairs.withColumn("n", n).withColumn("r", r).where((F.col("r") <= F.greatest(F.lit(LINK_LEAST), F.floor(F.col("n") / LINK_SHARE))) & (F.col("weight") > LINK_SCORE)).select(*keys, "src", "dst", "weight")


def profile_text(nodes: DataFrame, keys: list[str], tag: Column, level: str) -> DataFrame:
    """keys, profile: lines "[tag]: content" of a level in node order."""
    return nodes.where(F.col("level") == level).groupBy(*keys).agg(ordered_text(F.concat(F.lit("["), tag, F.lit("]: "), F.col("content")), F.col("node_seq")).alias("profile"))


def refined_content(content: Column, addition: Column) -> Column:
    """What refinement makes of a scene: an addition of over five characters is appended, anything else changes nothing."""
    more = strip(addition)
    return F.when(F.length(more) > 5, F.concat(content, F.lit("\n[Insight]: "), more)).otherwise(content)


def refine(scenes: DataFrame, additions: DataFrame, keys: list[str]) -> DataFrame:
    """Scenes not yet refined, with additions taken in; all of them are refined then, changed or not."""
    todo = scenes.where(~F.coalesce("refined", F.lit(False)))
    return todo.join(additions, [*keys, "node_id"], "left").select(*keys, "node_id", refined_content(F.col("content"), F.coalesce("addition", F.lit(""))).alias("content"), F.lit(True).alias("refined"))

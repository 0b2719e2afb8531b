"""Communities by semi-synchronous label propagation (Cordasco and Gargano, 2010): one colour class at a time.

Nodes of a colour aren't neighbours, so a class is updated as a whole, as if node by node, and the next class sees its
labels: unlike synchronous rounds this settles on any graph. Colours are those of a greedy walk over the nodes by falling
degree, then node order. Links are taken as undirected; loops and repeated links don't count; ends that are no node are
left out. Nodes without a link keep colour 0 and their own label.

Nothing is gathered by sample: every step is a join and an aggregate over links, so one sample may be the whole graph. Each
link takes part once in colouring and once in each round. A colouring step colours every node whose earlier neighbours have
colours, in all samples at once; there are as many steps as the longest chain of such neighbours has nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import written

from .graph import both_ways, undirected


def _links(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node_id, other: both ways, between nodes."""
    links = both_ways(undirected(edges, keys).select(*keys, F.col("a").alias("src"), F.col("b").alias("dst")))
    for end in ("src", "dst"):
        links = links.join(nodes.select(*keys, F.col("node_id").alias(end)), [*keys, end], "left_semi")
    return links.select(*keys, F.col("src").alias("node_id"), F.col("dst").alias("other"))


def colour_classes(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node_id, colour: the least colour from 0 that no earlier neighbour has, nodes of higher degree being earlier, then
    those that come first in node order."""
    return _coloured(nodes, written(_links(nodes, edges, keys), "links"), keys)


def _coloured(nodes: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    degree = links.groupBy(*keys, "node_id").agg((-F.count("*")).alias("turn"))
    place = nodes.select(*keys, "node_id", "node_seq").join(degree, [*keys, "node_id"]).select(*keys, "node_id", F.struct("turn", "node_seq", "node_id").alias("place"))
    place = written(place, "places")
    ends = links.join(place, [*keys, "node_id"]).join(place.select(*keys, F.col("node_id").alias("other"), F.col("place").alias("o_place")), [*keys, "other"])
    earlier = written(ends.where("o_place < place").select(*keys, "node_id", "other"), "earlier")
    waiting = earlier.groupBy(*keys, "node_id").agg(F.count("*").alias("waits"))
    none = F.array().cast("array<int>")
    state = written(place.select(*keys, "node_id").join(waiting, [*keys, "node_id"], "left").select(*keys, "node_id", F.coalesce("waits", F.lit(0).cast("long")).alias("waits"), none.alias("used")), "colouring")
    free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), "used"))
    done = [nodes.select(*keys, "node_id").join(place, [*keys, "node_id"], "left_anti").withColumn("colour", F.lit(0))]
    while True:
        ready = state.where("waits = 0").select(*keys, "node_id", free.alias("colour"))
        done.append(ready)
        rest = state.where("waits > 0")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        # what the nodes coloured last take from those that wait for them; a set holds colours, not neighbours
        seen = earlier.join(ready.withColumnRenamed("node_id", "other"), [*keys, "other"]).groupBy(*keys, "node_id").agg(F.count("*").alias("n"), F.collect_set("colour").alias("new"))
        state = written(rest.join(seen, [*keys, "node_id"], "left").select(*keys, "node_id", (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"), F.when(F.col("n").isNull(), F.col("used")).otherwise(F.array_union("used", "new")).alias("used")), "colouring")


def semi_synchronous(nodes: DataFrame, edges: DataFrame, keys: list[str], rounds: int | None = None) -> DataFrame:
    """keys, node_id, label: the id of the node the label comes from. Until a round changes nothing, or for `rounds` rounds.

    A node takes the label most of its neighbours have; it keeps its own if that is among the most frequent, else the one
    of the latest node wins."""
    links = written(_links(nodes, edges, keys), "links")
    colour = written(_coloured(nodes, links, keys).join(nodes.select(*keys, "node_id", "node_seq"), [*keys, "node_id"]), "colours")
    linked = written(links.join(colour.drop("node_seq"), [*keys, "node_id"]).sortWithinPartitions("colour"), "coloured-links")
    start = colour.select(*keys, "node_id", "colour", F.struct("node_seq", "node_id").alias("label"), F.lit(False).alias("moved"))
    last = colour.agg(F.max("colour")).first()[0]
    labels = [start.where(F.col("colour") == c) for c in range(0 if last is None else last + 1)]
    while labels and rounds != 0:
        for c, own in enumerate(labels):
            now = reduce(DataFrame.unionByName, labels).select(*keys, F.col("node_id").alias("other"), "label")
            votes = linked.where(F.col("colour") == c).join(now, [*keys, "other"]).groupBy(*keys, "node_id", "label").agg(F.count("*").alias("n"))
            mine = own.select(*keys, "node_id", F.col("label").alias("own"))
            best = votes.join(mine, [*keys, "node_id"]).groupBy(*keys, "node_id").agg(F.max(F.struct("n", F.col("label").eqNullSafe(F.col("own")).alias("mine"), "label")).alias("best"))
            new = own.drop("moved").join(best, [*keys, "node_id"], "left").withColumn("new", F.coalesce("best.label", "label"))
            labels[c] = written(new.select(*keys, "node_id", "colour", F.col("new").alias("label"), (~F.col("new").eqNullSafe(F.col("label"))).alias("moved")), "labels")
        rounds = None if rounds is None else rounds - 1
        if reduce(DataFrame.unionByName, labels).where("moved").isEmpty():
            break
    out = reduce(DataFrame.unionByName, labels) if labels else start
    return out.select(*keys, "node_id", F.col("label.node_id").alias("label"))

"""The memory graph as two tables: versions append, the latest wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import written


def latest(versions: DataFrame, key: list[str], version: str = "version") -> DataFrame:
    """One row a key: the one with the highest version. Only max_by's state is shuffled, whatever the history."""
    rest = [c for c in versions.columns if c not in key]
    one = versions.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("r_"))
    return one.select(*key, *[F.col(f"r_.{c}").alias(c) for c in rest])


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse; loops are left out."""
    turned = edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionByName(turned).where("src <> dst")


def undirected(edges: DataFrame, keys: list[str]) -> DataFrame:
    return edges.where("src <> dst").select(*keys, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def induced(nodes: DataFrame, edges: DataFrame, keys: list[str], keep: Column) -> DataFrame:
    """Edges between nodes that keep holds for."""
    ids = nodes.where(keep).select(*keys, "node_id")
    for end in ("src", "dst"):
        edges = edges.join(ids.withColumnRenamed("node_id", end), [*keys, end], "left_semi")
    return edges


def without_levels(nodes: DataFrame, edges: DataFrame, keys: list[str], levels: tuple[str, ...] = ("scene", "persona")) -> tuple[DataFrame, DataFrame]:
    """The graph without nodes of these levels and the edges at them."""
    gone = nodes.where(F.col("level").isin(*levels)).select(*keys, "node_id")
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("node_id", end), [*keys, end], "left_anti")
    return nodes.where(~F.coalesce(F.col("level").isin(*levels), F.lit(False))), edges


def suggested_edges(decisions: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Edges both ways from suggestions: a number is a place in the sample's node order, other text a node id.

    Numbers out of range, unknown ids and the node itself are left out."""
    one = decisions.select(*keys, "node_id", F.explode("suggested").alias("s"))
    place = F.when(F.col("s").rlike(r"^\d+$"), F.col("s").cast("long"))
    seats = index.select(*keys, F.col("node_id").alias("other"), F.col("node_seq").alias("place_"))
    by_place = one.withColumn("place_", place).where("place_ is not null").join(seats, [*keys, "place_"]).select(*keys, "node_id", "other")
    by_id = one.where(place.isNull()).join(seats.select(*keys, "other"), (F.col("s") == F.col("other")) & _same(one, seats, keys)).select(*[one[k] for k in keys], "node_id", "other")
    return both_ways(by_place.unionByName(by_id).distinct().select(*keys, F.col("node_id").alias("src"), F.col("other").alias("dst"))).distinct()


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (a[k] == b[k])
    return out


def neighbour_updates(decisions: DataFrame) -> DataFrame:
    """Rows (.., node_id, context, tags) of new attributes by position, while all three lists last."""
    n = F.least(F.size("neighbours"), F.size("contexts"), F.size("tags"))
    rest = [c for c in decisions.columns if c not in ("neighbours", "contexts", "tags")]
    rows = decisions.where(n > 0).select(*rest, "neighbours", "contexts", "tags", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    at = lambda c: F.col(c)[F.col("pos")]
    return rows.select(*rest, "pos", at("neighbours").alias("node_id"), at("contexts").alias("context"), at("tags").alias("tags"))


def level_counts(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, facts, scenes, personas, others, total_nodes, total_edges."""
    of = lambda x: F.sum((F.col("level") == x).cast("long"))
    known = F.col("level").isin("fact", "scene", "persona")
    n = nodes.groupBy(*keys).agg(of("fact").alias("facts"), of("scene").alias("scenes"), of("persona").alias("personas"), F.sum((~F.coalesce(known, F.lit(False))).cast("long")).alias("others"), F.count("*").alias("total_nodes"))
    e = edges.groupBy(*keys).agg(F.count("*").alias("total_edges"))
    return n.join(e, keys, "left").withColumn("total_edges", F.coalesce("total_edges", F.lit(0).cast("long")))


def degrees(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node_id, n_in, n_out and the sorted lists of both sides."""
    ends = edges.select(*keys, F.col("src").alias("node_id"), F.col("dst").alias("o"), F.lit(None).cast("string").alias("i")).unionByName(edges.select(*keys, F.col("dst").alias("node_id"), F.lit(None).cast("string").alias("o"), F.col("src").alias("i")))
    return ends.groupBy(*keys, "node_id").agg(F.count("i").alias("n_in"), F.count("o").alias("n_out"), F.array_join(F.array_sort(F.collect_list("i")), ",").alias("predecessors"), F.array_join(F.array_sort(F.collect_list("o")), ",").alias("successors"))


def label_propagation(nodes: DataFrame, edges: DataFrame, keys: list[str], rounds: int, settle: bool = False) -> DataFrame:
    """keys, node_id, label after `rounds` synchronous rounds; with settle, sooner if a round changes nothing.

    A node takes the label most of its neighbours have; it keeps its own if that is among the most frequent, else the
    smallest of them wins. Nodes without a neighbour stay alone. Each round is a table in the shared folder."""
    links = both_ways(undirected(edges, keys).select(*keys, F.col("a").alias("src"), F.col("b").alias("dst")))
    labels = nodes.select(*keys, "node_id", F.col("node_id").alias("label"))
    for _ in range(rounds):
        votes = links.join(labels.select(*keys, F.col("node_id").alias("dst"), "label"), [*keys, "dst"]).groupBy(*keys, F.col("src").alias("node_id"), "label").agg(F.count("*").alias("n"))
        own = labels.withColumnRenamed("label", "own")
        ranked = votes.join(own, [*keys, "node_id"]).withColumn("mine", (F.col("label") == F.col("own")).cast("int"))
        w = Window.partitionBy(*keys, "node_id").orderBy(F.desc("n"), F.desc("mine"), "label")
        best = ranked.withColumn("r", F.row_number().over(w)).where("r = 1").select(*keys, "node_id", F.col("label").alias("new"))
        moved = written(own.join(best, [*keys, "node_id"], "left").select(*keys, "node_id", F.coalesce("new", "own").alias("label"), (F.col("new") != F.col("own")).alias("moved")), "labels")
        labels = moved.select(*keys, "node_id", "label")
        if settle and moved.where("moved").isEmpty():
            break
    return labels


def chunk_communities(nodes: DataFrame, keys: list[str], size: int = 10) -> DataFrame:
    """The fallback: runs of `size` nodes in order."""
    w = Window.partitionBy(*keys).orderBy("node_seq")
    return nodes.select(*keys, "node_id", F.floor((F.row_number().over(w) - 1) / size).cast("long").alias("community"))


def uncovered(communities: DataFrame, nodes: DataFrame, edges: DataFrame, keys: list[str], parent: str) -> DataFrame:
    """Communities whose first member (by node order) has no predecessor of the parent level."""
    first = communities.join(nodes.select(*keys, "node_id", "node_seq"), [*keys, "node_id"]).groupBy(*keys, "community").agg(F.min_by("node_id", "node_seq").alias("dst"))
    parents = edges.join(nodes.where(F.col("level") == parent).select(*keys, F.col("node_id").alias("src")), [*keys, "src"], "left_semi").select(*keys, "dst").distinct()
    return first.join(parents, [*keys, "dst"], "left_anti").select(*keys, "community", F.col("dst").alias("first_member"))

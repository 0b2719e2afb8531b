"""Hybrid scores, top-k, and the four retrieval strategies over a memory graph.

`keys` name a sample; nothing crosses it. Queries carry a text and a vector, nodes a document, a vector and their
place in insertion order. Equal scores: the later node first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import context_line, index_tokens
from sparkloom.functions.vector import cosine
from sparkloom.session import written

from . import bm25
from .hierarchy import ordered_text

ALPHA, CHILDREN = 0.5, 5
LEVEL_K = (2, 3, 5)  # personas, scenes, facts
FLAT_K = 5


def level_k(given: tuple[int, ...] | None) -> tuple[int, int, int]:
    """The default if nothing is given or it is too short."""
    return tuple(given[:3]) if given and len(given) >= 3 else LEVEL_K


def top_k(df: DataFrame, by: list[str], score: Column | str, tie: str, k: Column | int) -> DataFrame:
    """Rows of the k best scores of each group, with `rank` from 1; k = 0 keeps all, more than there are as well."""
    k = F.lit(k) if isinstance(k, int) else k
    score = F.col(score) if isinstance(score, str) else score
    w = Window.partitionBy(*by).orderBy(score.desc(), F.col(tie).desc())
    return df.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) | (k == 0))


def dense_scores(queries: DataFrame, docs: DataFrame, keys: list[str], query: str, doc: str, seq: str) -> DataFrame:
    """keys, query, doc, seq, cosine: every query against its sample's documents."""
    q = queries.select(*keys, query, F.col("vec").alias("q_vec"))
    return q.join(docs.select(*keys, doc, seq, "vec"), keys).select(*keys, query, doc, seq, cosine("q_vec", "vec").alias("cosine"))


def hybrid_scores(queries: DataFrame, docs: DataFrame, keys: list[str], query: str, doc: str, seq: str, alpha: float = ALPHA, index: DataFrame | None = None, k: Column | int | None = None) -> DataFrame:
    """keys, query, doc, seq, dense, sparse, score: dense in [0, 1], BM25 rescaled over the whole corpus.

    Scores are rounded to nine places, so that ties do not depend on the order sums were taken in. k: only rows that may be
    among the k best of a query come out, with `k`; pairs are never shuffled."""
    more = [] if k is None else ["k"]
    asked = queries if k is None else queries.withColumn("k", (F.lit(k) if isinstance(k, int) else k).cast("int"))
    asks = bm25.weighed(asked, bm25.vocabulary(docs, keys, doc, "doc") if index is None else index, keys, query, "text", "vec", *more)
    asks = asks.withColumn("vec", F.col("vec").cast("array<double>"))
    has = docs.select(*keys, doc, F.col(seq).alias("seq"), index_tokens("doc").alias("toks"), F.col("vec").cast("array<double>").alias("vec"))
    both = bm25.block_scores(asks, has, keys, query, doc, alpha)
    return both.select(*keys, query, doc, F.col("seq").alias(seq), "dense", "sparse", F.round(alpha * F.col("dense") + (1 - alpha) * F.col("sparse"), 9).alias("score"), *more)


def flat(queries: DataFrame, docs: DataFrame, keys: list[str], k: Column | int, query: str = "query_id", doc: str = "node_id", seq: str = "node_seq", index: DataFrame | None = None) -> DataFrame:
    """keys, query, doc, rank, score over all levels. k may be a column of queries; index: bm25.vocabulary() of docs, if written."""
    scored = hybrid_scores(queries, docs, keys, query, doc, seq, index=index, k=k)
    return top_k(scored, [*keys, query], "score", seq, F.col("k")).drop("k")


def children(edges: DataFrame, keys: list[str], limit: int | None = CHILDREN) -> DataFrame:
    """keys, src, dst of contains edges: each source's first `limit` by insertion order."""
    down = edges.where("type = 'contains'")
    if limit is None:
        return down.select(*keys, "src", "dst")
    w = Window.partitionBy(*keys, "src").orderBy("edge_seq")
    return down.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= limit).select(*keys, "src", "dst")


def neighbours(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node_id, near: what a seed expands to, as a list of (node_id, node_seq). A scene brings its first children, a
    fact the scenes it is in, a persona nothing."""
    levels = nodes.select(*keys, "node_id", "level", "node_seq")
    src, dst = (levels.select(*keys, F.col("node_id").alias(e), F.col("level").alias(f"{e}_level"), F.col("node_seq").alias(f"{e}_seq")) for e in ("src", "dst"))
    w = Window.partitionBy(*keys, "src").orderBy("edge_seq")
    of_scene = edges.where("type = 'contains'").withColumn("n_", F.row_number().over(w)).join(src, [*keys, "src"]).where("src_level = 'scene'").join(dst, [*keys, "dst"])
    ways = F.array(
        F.when(F.col("n_") <= CHILDREN, F.struct(F.col("src").alias("node_id"), F.col("dst").alias("other"), F.col("dst_seq").alias("seq"))),
        F.when(F.col("dst_level") == "fact", F.struct(F.col("dst").alias("node_id"), F.col("src").alias("other"), F.col("src_seq").alias("seq"))),
    )
    rows = of_scene.select(*keys, F.explode(ways).alias("x")).where("x IS NOT NULL")
    return rows.groupBy(*keys, "x.node_id").agg(F.collect_set(F.struct(F.col("x.other").alias("node_id"), F.col("x.seq").alias("node_seq"))).alias("near"))


def graph_traversal(queries: DataFrame, docs: DataFrame, nodes: DataFrame, edges: DataFrame, keys: list[str], k: Column | int, index: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """keys, query_id, node_id, rank, seed: hybrid seeds in rank order, then what they expand to in node order.

    A node counts once. index, near: bm25.vocabulary() of docs and neighbours() of the graph, if they are written."""
    near = neighbours(nodes, edges, keys) if near is None else near
    seeds = flat(queries, docs, keys, k, index=index).select(*keys, "query_id", "node_id", "rank").join(near, [*keys, "node_id"], "left")
    own = F.struct(F.lit(0).alias("late"), F.col("rank").cast("long").alias("r"), "node_id")
    more = F.transform(F.coalesce("near", F.array().cast("array<struct<node_id:string,node_seq:bigint>>")), lambda x: F.struct(F.lit(1).alias("late"), x["node_seq"].cast("long").alias("r"), x["node_id"].alias("node_id")))
    every = seeds.select(*keys, "query_id", F.explode(F.concat(F.array(own), more)).alias("x"))
    once = every.groupBy(*keys, "query_id", F.col("x.node_id").alias("node_id")).agg(F.min(F.struct("x.late", "x.r")).alias("x"))
    w = Window.partitionBy(*keys, "query_id").orderBy("x.late", "x.r", "node_id")
    return once.select(*keys, "query_id", "node_id", F.row_number().over(w).alias("rank"), (F.col("x.late") == 0).alias("seed"))


def context_text(found: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, query_id, context: what a strategy found, as the text that goes into a prompt and nothing else."""
    rows = found.join(nodes.select(*keys, "node_id", "level", "timestamp", "tags", "content"), [*keys, "node_id"])
    line = context_line(F.col("rank") - 1, "level", "timestamp", "tags", "content")
    return rows.groupBy(*keys, "query_id").agg(ordered_text(line, F.col("rank"), "").alias("context"))


def block_search(vectors: DataFrame, keys: list[str], doc: str, k: int, rows: int = 2000) -> DataFrame:
    """keys, query, doc, score, rank: every vector's k nearest of its corpus, itself included, by exact cosine.

    A corpus of over `rows` vectors is dealt into blocks; each pair of blocks is one matrix product that keeps k a query."""
    sizes = vectors.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias("nb"))
    dealt = vectors.join(sizes, keys).withColumn("b", F.pmod(F.xxhash64(doc), "nb").cast("int"))
    spread = lambda asks: dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(*keys, F.col("b" if asks else "o").alias("q_"), F.col("o" if asks else "b").alias("d_"), F.lit(asks).alias("asks"), doc, "vec")
    both = spread(True).unionByName(spread(False))

    def best(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group["vec"].to_numpy()).astype(np.float64)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        asks, ids = group["asks"].to_numpy(bool), group[doc].to_numpy()
        score, base = x[asks] @ x[~asks].T, ids[~asks]
        order = np.lexsort((np.broadcast_to(-base, score.shape), -np.round(score, 9)), axis=1)[:, :k]
        out = pd.DataFrame({"query": np.repeat(ids[asks], order.shape[1]), doc: base[order].ravel(), "score": np.take_along_axis(score, order, axis=1).ravel()})
        for name in keys:
            out[name] = group[name].iloc[0]
        return out

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    ddl = ", ".join([f"query {kinds[doc]}, {doc} {kinds[doc]}, score double", *[f"{x} {kinds[x]}" for x in keys]])
    return top_k(both.groupBy(*keys, "q_", "d_").applyInPandas(best, ddl), [*keys, "query"], F.round("score", 9), doc, k)


def _level_top(queries: DataFrame, nodes: DataFrame, keys: list[str], level: str, k: int, within: DataFrame | None) -> DataFrame:
    """The k best nodes of a level for each query, of those in `within` if given: candidates first, vectors after.
    Only ids and scores are ranked."""
    found = nodes.where(F.col("level") == level).select(*keys, "node_id", "node_seq", F.col("vec").alias("n_vec"))
    asked = queries.select(*keys, "query_id", "vec")
    pairs = asked.join(found, keys) if within is None else asked.join(within, [*keys, "query_id"]).join(found, [*keys, "node_id"])
    scored = pairs.select(*keys, "query_id", "node_id", "node_seq", F.round(cosine("vec", "n_vec"), 9).alias("score"))
    return top_k(scored, [*keys, "query_id"], "score", "node_seq", k)


def _enriched(queries: DataFrame, chosen: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The query's vector plus those of what was chosen: what re-embedding query and contents comes to with an additive
    embedder."""
    dims = F.col("vec")
    chosen = chosen.select(*keys, "query_id", "node_id", "rank").join(nodes.select(*keys, "node_id", F.col("vec").alias("n_vec")), [*keys, "node_id"])
    lists = chosen.groupBy(*keys, "query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "n_vec"))).alias("vs"))
    add = F.aggregate("vs", dims.cast("array<double>"), lambda a, s: F.zip_with(a, s["n_vec"].cast("array<double>"), lambda x, y: x + y))
    return queries.join(lists, [*keys, "query_id"]).select(*[c for c in queries.columns if c != "vec"], add.alias("vec"))


def level_walk(queries: DataFrame, nodes: DataFrame, edges: DataFrame, keys: list[str], order: list[str], ks: list[int]) -> DataFrame:
    """keys, query_id, node_id, level, stage, rank. At each stage the best of a level among the neighbours of the last.

    ["persona", "scene", "fact"] walks down, the reverse walks up. Queries of a sample that has no node of the first
    level are answered by flat retrieval, at stage 0; of the others, those that find nothing at a later stage end there.
    What a stage chose, a few ids a query, and the queries it leads to are written, so no stage plans those before it again."""
    first = nodes.where(F.col("level") == order[0]).select(*keys).distinct()
    lost = written(queries.join(first, keys, "left_anti"), "walk-lost")
    if lost.isEmpty():
        plain = lost.join(nodes.select(*keys, "node_id"), keys).select(*keys, "query_id", "node_id", F.lit(0).alias("rank"))
    elif "text" in queries.columns and "doc" in nodes.columns:
        plain = flat(lost, nodes, keys, FLAT_K).select(*keys, "query_id", "node_id", "rank")
    else:
        near = dense_scores(lost, nodes, keys, "query_id", "node_id", "node_seq").withColumn("cosine", F.round("cosine", 9))
        plain = top_k(near, [*keys, "query_id"], "cosine", "node_seq", FLAT_K).select(*keys, "query_id", "node_id", "rank")
    out = plain.join(nodes.select(*keys, "node_id", "level"), [*keys, "node_id"]).select(*keys, "query_id", "node_id", "level", F.lit(0).alias("stage"), "rank")
    within = None
    down = order[0] == "persona"
    for stage, (level, k) in enumerate(zip(order, ks), 1):
        best = written(_level_top(queries, nodes, keys, level, k, within).select(*keys, "query_id", "node_id", "rank"), "walk-stage")
        rows = best.select(*keys, "query_id", "node_id", F.lit(level).alias("level"), F.lit(stage).alias("stage"), "rank")
        out = out.unionByName(rows)
        if stage < len(order):
            links = edges.where("type = 'contains'").select(*keys, F.col("src" if down else "dst").alias("node_id"), F.col("dst" if down else "src").alias("next"))
            within = best.select(*keys, "query_id", "node_id").join(links, [*keys, "node_id"]).select(*keys, "query_id", F.col("next").alias("node_id")).distinct()
            queries = written(_enriched(queries, best, nodes, keys), "walk-queries")
    return out


def top_down(queries: DataFrame, nodes: DataFrame, edges: DataFrame, keys: list[str], k: tuple[int, ...] | None = None) -> DataFrame:
    k = level_k(k)
    return level_walk(queries, nodes, edges, keys, ["persona", "scene", "fact"], [k[0], k[1], k[2]])


def bottom_up(queries: DataFrame, nodes: DataFrame, edges: DataFrame, keys: list[str], k: tuple[int, ...] | None = None) -> DataFrame:
    k = level_k(k)
    return level_walk(queries, nodes, edges, keys, ["fact", "scene", "persona"], [k[2], k[1], k[0]])

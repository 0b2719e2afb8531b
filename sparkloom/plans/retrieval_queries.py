"""Queries over the memory graph: index, scores, strategies, expansion joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions.vector import cosine
from sparkloom.operators import bm25, graph, hierarchy, retrieval
from sparkloom.session import written

from . import model as M
from .registry import query

K = M.KEYS
r6 = lambda c: F.round(c, 6)


@query("index_documents", f"WITH {M.FACTS} SELECT sample_id, node_seq, {M.sql_doc('content', 'context', 'keywords', 'tags')} AS doc FROM facts")
def index_documents(spark: SparkSession, d: str) -> DataFrame:
    return M.facts(spark, d).select("sample_id", "node_seq", T.index_document("content", "context", "keywords", "tags").alias("doc"))


@query("note_documents", f"WITH {M.FACTS} SELECT sample_id, node_seq, content || ' , ' || context || ' ' || {M.sql_join('keywords')} || ' ' || {M.sql_join('tags')} AS doc FROM facts")
def note_documents(spark: SparkSession, d: str) -> DataFrame:
    return M.facts(spark, d).select("sample_id", "node_seq", T.note_document("content", "context", "keywords", "tags").alias("doc"))


@query("fact_nodes", f"WITH {M.FACTS} SELECT sample_id, node_id, node_seq, content, \"timestamp\", array_to_string(keywords, '|') AS keywords, context, array_to_string(tags, '|') AS tags FROM facts")
def fact_nodes(spark: SparkSession, d: str) -> DataFrame:
    return M.facts(spark, d).select("sample_id", "node_id", "node_seq", "content", "timestamp", F.array_join("keywords", "|").alias("keywords"), "context", F.array_join("tags", "|").alias("tags"))


@query("level_filter", f"WITH {M.GRAPH} SELECT sample_id, node_id, content FROM nodes WHERE level = 'scene'")
def level_filter(spark: SparkSession, d: str) -> DataFrame:
    return M.graph(spark, d)[0].where("level = 'scene'").select("sample_id", "node_id", "content")


def _user_scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return M.queries_of(spark, d), M.graph(spark, d)[0]


@query("bm25_term_stats", f"WITH {M.GRAPH}, {M.QUERIES}, {M.sql_bm25()} SELECT sample_id, term, df::BIGINT AS df, round(idf, 6) AS idf FROM idf")
def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    n = M.graph(spark, d)[0]
    stats = bm25.term_stats(bm25.postings(n, K, "node_id", "doc"), bm25.corpus_stats(n, K, "node_id", "doc"), K)
    return stats.select("sample_id", "term", "df", r6("idf").alias("idf"))


@query("bm25_corpus_stats", f"WITH {M.GRAPH}, {M.QUERIES}, {M.sql_bm25()} SELECT sample_id, n::BIGINT AS n_docs, round(avgdl, 6) AS avgdl FROM stat")
def bm25_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25.corpus_stats(M.graph(spark, d)[0], K, "node_id", "doc").withColumn("avgdl", r6("avgdl"))


@query("bm25_scores", f"WITH {M.GRAPH}, {M.QUERIES}, {M.sql_bm25()} SELECT sample_id, query_id, node_id, round(s, 6) AS bm25 FROM bm25")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    q, n = _user_scores(spark, d)
    return bm25.scores(q, n, K, "query_id", "text", "node_id", "doc", M.index(spark, d)).select("sample_id", "query_id", "node_id", r6("bm25").alias("bm25"))


@query("bm25_min_max", f"WITH {M.GRAPH}, {M.QUERIES}, {M.HYBRID} SELECT sample_id, query_id, node_id, round(sparse, 6) AS sparse FROM scaled")
def bm25_min_max(spark: SparkSession, d: str) -> DataFrame:
    q, n = _user_scores(spark, d)
    s = bm25.scores(q, n, K, "query_id", "text", "node_id", "doc", M.index(spark, d))
    return s.select("sample_id", "query_id", "node_id", r6("sparse").alias("sparse"))


@query("dense_scores", f"WITH {M.GRAPH}, {M.QUERIES} SELECT sample_id, query_id, node_id, round(({M.sql_cosine('q.vec', 'n.vec')} + 1) / 2, 6) AS dense FROM q JOIN nodes n USING (sample_id)")
def dense_scores(spark: SparkSession, d: str) -> DataFrame:
    q, n = _user_scores(spark, d)
    return retrieval.dense_scores(q, n, K, "query_id", "node_id", "node_seq").select("sample_id", "query_id", "node_id", r6((F.col("cosine") + 1) / 2).alias("dense"))


@query("dense_top_k", f"WITH {M.GRAPH}, {M.QUERIES}, s AS (SELECT sample_id, query_id, node_id, node_seq, round({M.sql_cosine('q.vec', 'n.vec')}, 9) AS c FROM q JOIN nodes n USING (sample_id)) SELECT sample_id, query_id, node_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, query_id ORDER BY c DESC, node_seq DESC) AS rank FROM s) WHERE rank <= 5")
def dense_top_k(spark: SparkSession, d: str) -> DataFrame:
    q, n = _user_scores(spark, d)
    s = retrieval.dense_scores(q, n, K, "query_id", "node_id", "node_seq").withColumn("c", F.round("cosine", 9))
    return retrieval.top_k(s, [*K, "query_id"], "c", "node_seq", 5).select("sample_id", "query_id", "node_id", "rank")


@query("hybrid_scores", f"WITH {M.GRAPH}, {M.QUERIES}, {M.HYBRID} SELECT sample_id, query_id, node_id, round(score, 6) AS score FROM scored")
def hybrid_scores(spark: SparkSession, d: str) -> DataFrame:
    q, n = _user_scores(spark, d)
    return retrieval.hybrid_scores(q, n, K, "query_id", "node_id", "node_seq", index=M.index(spark, d)).select("sample_id", "query_id", "node_id", r6("score").alias("score"))


@query("flat_retrieval", f"WITH {M.GRAPH}, {M.QUERIES}, {M.HYBRID} SELECT sample_id, query_id, node_id, rank::INT AS rank FROM ranked WHERE rank <= 5")
def flat_retrieval(spark: SparkSession, d: str) -> DataFrame:
    q, n = _user_scores(spark, d)
    return retrieval.flat(q, n, K, 5, index=M.index(spark, d)).select("sample_id", "query_id", "node_id", "rank")


@query("category_k_retrieval", f"WITH {M.GRAPH}, {M.QUERIES}, {M.HYBRID} SELECT sample_id, query_id, node_id, rank::INT AS rank FROM ranked WHERE rank <= CASE query_id % 5 + 1 WHEN 2 THEN 25 WHEN 4 THEN 25 WHEN 3 THEN 30 ELSE 35 END")
def category_k_retrieval(spark: SparkSession, d: str) -> DataFrame:
    q, n = _user_scores(spark, d)
    return retrieval.flat(q, n, K, T.category_k(F.col("query_id") % 5 + 1), index=M.index(spark, d)).select("sample_id", "query_id", "node_id", "rank")


@query("position_join", f"WITH {M.GRAPH}, {M.QUERIES}, {M.HYBRID} SELECT sample_id, query_id, level, content FROM ranked JOIN nodes USING (sample_id, node_id) WHERE rank = 1")
def position_join(spark: SparkSession, d: str) -> DataFrame:
    q, n = _user_scores(spark, d)
    top = retrieval.flat(q, n, K, 1, index=M.index(spark, d)).select("sample_id", "query_id", "node_id")
    return top.join(n.select("sample_id", "node_id", "level", "content"), ["sample_id", "node_id"]).select("sample_id", "query_id", "level", "content")


_TRAVERSAL = """
seeds AS (SELECT sample_id, query_id, node_id, rank, level FROM ranked JOIN nodes USING (sample_id, node_id) WHERE rank <= 5),
kids AS (SELECT sample_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, src ORDER BY edge_seq) AS i FROM edges WHERE type = 'contains') WHERE i <= 5),
more AS (SELECT s.sample_id, query_id, k.dst AS node_id FROM seeds s JOIN kids k ON s.sample_id = k.sample_id AND s.node_id = k.src WHERE s.level = 'scene'
  UNION SELECT s.sample_id, query_id, e.src FROM seeds s JOIN edges e ON s.sample_id = e.sample_id AND s.node_id = e.dst AND e.type = 'contains' JOIN nodes n ON n.sample_id = e.sample_id AND n.node_id = e.src AND n.level = 'scene' WHERE s.level = 'fact'),
walk AS (SELECT sample_id, query_id, node_id, rank AS r, 0 AS late FROM seeds
  UNION ALL SELECT m.sample_id, m.query_id, m.node_id, n.node_seq, 1 FROM more m JOIN nodes n USING (sample_id, node_id) ANTI JOIN seeds s USING (sample_id, query_id, node_id)),
found AS (SELECT sample_id, query_id, node_id, row_number() OVER (PARTITION BY sample_id, query_id ORDER BY late, r, node_id) AS rank, late = 0 AS seed FROM walk)"""


@query("graph_traversal", f"WITH {M.GRAPH}, {M.QUERIES}, {M.HYBRID}, {_TRAVERSAL} SELECT sample_id, query_id, node_id, rank::INT AS rank, seed FROM found")
def graph_traversal(spark: SparkSession, d: str) -> DataFrame:
    n, e = M.graph(spark, d)
    return retrieval.graph_traversal(M.queries_of(spark, d), n, n, e, K, 5, M.index(spark, d), M.near(spark, d))


@query("context_block", f"WITH {M.GRAPH}, {M.QUERIES}, {M.HYBRID}, {_TRAVERSAL} SELECT sample_id, query_id, string_agg('[Index: ' || (rank - 1) || '] [' || upper(level) || '] [Time: ' || coalesce(\"timestamp\", 'Unknown Time') || '] [' || {M.sql_join('tags')} || ']' || chr(10) || content || chr(10) || chr(10), '' ORDER BY rank) AS context FROM found JOIN nodes USING (sample_id, node_id) GROUP BY ALL")
def context_block(spark: SparkSession, d: str) -> DataFrame:
    n, e = M.graph(spark, d)
    found = retrieval.graph_traversal(M.queries_of(spark, d), n, n, e, K, 5, M.index(spark, d), M.near(spark, d))
    return retrieval.context_text(found, n, K)


# the walks through the levels, over the embeddings table: a hundred vectors are a sample, a vector is a fact, centroids are
# scenes and personas; every fourth sample has no personas yet
def _vector_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = M.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 100).cast("string").alias("sample_id"), "vec_id", "label", F.pmod("vec_id", F.lit(5)).alias("part"), F.col("embedding").cast("array<double>").alias("vec"))
    fact = F.concat(F.lit("f"), F.col("vec_id").cast("string"))
    scene = F.concat(F.lit("s"), "sample_id", F.lit("_"), F.col("label").cast("string"), F.lit("_"), F.col("part").cast("string"))
    persona = F.concat(F.lit("p"), "sample_id", F.lit("_"), F.col("label").cast("string"))
    has = F.col("sample_id").cast("int") % 4 != 3

    def centroid(keys: list, name, level: str, seq) -> DataFrame:
        dims = e.select("sample_id", name.alias("node_id"), seq.cast("long").alias("node_seq"), F.posexplode("vec").alias("i", "x"))
        means = dims.groupBy("sample_id", "node_id", "node_seq", "i").agg(F.round(F.avg("x"), 9).alias("x"))
        vec = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
        return means.groupBy("sample_id", "node_id", "node_seq").agg(vec.alias("vec")).withColumn("level", F.lit(level))

    nodes_ = e.select("sample_id", fact.alias("node_id"), F.col("vec_id").alias("node_seq"), "vec", F.lit("fact").alias("level")).unionByName(centroid([], scene, "scene", F.col("label") * 5 + F.col("part"))).unionByName(centroid([], persona, "persona", F.col("label")).where(has))
    down = e.select("sample_id", scene.alias("src"), fact.alias("dst")).unionByName(e.where(has).select("sample_id", persona.alias("src"), scene.alias("dst")).distinct())
    queries = e.select("sample_id", F.col("vec_id").alias("query_id"), "vec")
    nodes = M.stored(spark, d, "vector_nodes", lambda: nodes_)
    edges = M.stored(spark, d, "vector_edges", lambda: down.withColumn("type", F.lit("contains")))
    return queries, nodes, edges


_VECTORS = """e AS (SELECT vec_id // 100 AS s, vec_id, label, vec_id % 5 AS part, embedding::DOUBLE[] AS vec FROM embeddings),
dims AS (SELECT s, vec_id, label, part, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM e),
cs AS (SELECT s, label, part, list(x ORDER BY i) AS vec FROM (SELECT s, label, part, i, round(avg(x), 9) AS x FROM dims GROUP BY ALL) GROUP BY ALL),
cp AS (SELECT s, label, list(x ORDER BY i) AS vec FROM (SELECT s, label, i, round(avg(x), 9) AS x FROM dims WHERE s % 4 <> 3 GROUP BY ALL) GROUP BY ALL),
nodes AS (SELECT s, 'f' || vec_id AS node_id, vec_id AS node_seq, vec, 'fact' AS level FROM e UNION ALL SELECT s, 's' || s || '_' || label || '_' || part, label * 5 + part, vec, 'scene' FROM cs UNION ALL SELECT s, 'p' || s || '_' || label, label, vec, 'persona' FROM cp),
links AS (SELECT s, 's' || s || '_' || label || '_' || part AS src, 'f' || vec_id AS dst FROM e UNION SELECT s, 'p' || s || '_' || label, 's' || s || '_' || label || '_' || part FROM e WHERE s % 4 <> 3),
q0 AS (SELECT s, vec_id AS query_id, vec FROM e)"""


def _sql_stage(n: int, level: str, k: int, last: bool, down: bool) -> str:
    limit = "" if n == 1 else f"JOIN w{n - 1} w ON w.query_id = q.query_id AND w.node_id = d.node_id"
    out = f"""s{n} AS (SELECT s, query_id, node_id, rank, vec FROM (SELECT q.s, q.query_id, d.node_id, d.vec, row_number() OVER (PARTITION BY q.query_id ORDER BY round({M.sql_cosine('q.vec', 'd.vec')}, 9) DESC, d.node_seq DESC) AS rank FROM q{n - 1} q JOIN nodes d ON d.s = q.s AND d.level = '{level}' {limit}) WHERE rank <= {k})"""
    if not last:
        here, there = ("src", "dst") if down else ("dst", "src")
        out += f""",
w{n} AS (SELECT DISTINCT query_id, {there} AS node_id FROM s{n} JOIN links ON links.{here} = s{n}.node_id),
q{n} AS (SELECT q.s, q.query_id, list_reduce(list_prepend(q.vec, vs), lambda a, b: list_transform(list_zip(a, b), lambda z: z[1] + z[2])) AS vec FROM q{n - 1} q JOIN (SELECT query_id, list(vec ORDER BY rank) AS vs FROM s{n} GROUP BY query_id) USING (query_id))"""
    return out


def _sql_walk(order: list[str], ks: list[int]) -> str:
    stages = ",\n".join(_sql_stage(i, level, k, i == 3, order[0] == "persona") for i, (level, k) in enumerate(zip(order, ks), 1))
    union = " UNION ALL ".join(f"SELECT query_id, node_id, '{level}' AS level, {i} AS stage, rank::INT AS rank FROM s{i}" for i, level in enumerate(order, 1))
    plain = f"SELECT query_id, node_id, level, 0, rank::INT FROM (SELECT q.query_id, d.node_id, d.level, row_number() OVER (PARTITION BY q.query_id ORDER BY round({M.sql_cosine('q.vec', 'd.vec')}, 9) DESC, d.node_seq DESC) AS rank FROM q0 q JOIN nodes d ON d.s = q.s WHERE NOT EXISTS (FROM nodes x WHERE x.s = q.s AND x.level = '{order[0]}')) WHERE rank <= 5"
    return f"WITH {_VECTORS},\n{stages} {union} UNION ALL {plain}"


@query("top_down", _sql_walk(["persona", "scene", "fact"], [2, 3, 5]))
def top_down(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top_down(*_vector_graph(spark, d), K).drop("sample_id")


@query("bottom_up", _sql_walk(["fact", "scene", "persona"], [5, 3, 2]))
def bottom_up(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bottom_up(*_vector_graph(spark, d), K).drop("sample_id")


@query("level_top_k", f"WITH {_VECTORS} SELECT query_id, node_id, rank::INT AS rank FROM (SELECT q.query_id, d.node_id, row_number() OVER (PARTITION BY q.query_id ORDER BY round({M.sql_cosine('q.vec', 'd.vec')}, 9) DESC, d.node_seq DESC) AS rank FROM q0 q JOIN nodes d ON d.s = q.s AND d.level = 'scene') WHERE rank <= 3")
def level_top_k(spark: SparkSession, d: str) -> DataFrame:
    q, n, _ = _vector_graph(spark, d)
    return retrieval._level_top(q, n, K, "scene", 3, None).select("query_id", "node_id", "rank")


# -- expansion joins -------------------------------------------------------------------------------------------------


@query("scene_children", f"WITH {M.GRAPH} SELECT sample_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, src ORDER BY edge_seq) AS i FROM edges WHERE type = 'contains') WHERE i <= 5")
def scene_children(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.children(M.graph(spark, d)[1], K)


@query("fact_parents", f"WITH {M.GRAPH} SELECT e.sample_id, e.dst, e.src FROM edges e JOIN nodes n ON n.sample_id = e.sample_id AND n.node_id = e.src WHERE n.level = 'scene'")
def fact_parents(spark: SparkSession, d: str) -> DataFrame:
    n, e = M.graph(spark, d)
    return e.join(n.where("level = 'scene'").select("sample_id", F.col("node_id").alias("src")), ["sample_id", "src"]).select("sample_id", "dst", "src")


@query("persona_facts", f"WITH {M.GRAPH} SELECT DISTINCT a.sample_id, a.src AS persona, b.dst AS fact FROM edges a JOIN edges b ON a.sample_id = b.sample_id AND a.dst = b.src AND a.type = 'contains' AND b.type = 'contains'")
def persona_facts(spark: SparkSession, d: str) -> DataFrame:
    down = retrieval.children(M.graph(spark, d)[1], K, None)
    return down.select("sample_id", F.col("src").alias("persona"), F.col("dst").alias("mid")).join(down.select("sample_id", F.col("src").alias("mid"), F.col("dst").alias("fact")), ["sample_id", "mid"]).select("sample_id", "persona", "fact").distinct()


@query("fact_personas", f"WITH {M.GRAPH} SELECT DISTINCT a.sample_id, a.dst AS fact, b.src AS persona FROM edges a JOIN edges b ON a.sample_id = b.sample_id AND a.src = b.dst AND a.type = 'contains' AND b.type = 'contains'")
def fact_personas(spark: SparkSession, d: str) -> DataFrame:
    down = retrieval.children(M.graph(spark, d)[1], K, None)
    return down.select("sample_id", F.col("dst").alias("fact"), F.col("src").alias("mid")).join(down.select("sample_id", F.col("dst").alias("mid"), F.col("src").alias("persona")), ["sample_id", "mid"]).select("sample_id", "fact", "persona").distinct()


@query("lateral_links", f"WITH {M.GRAPH} SELECT e.sample_id, a.node_seq AS a_seq, b.node_seq AS b_seq, CASE WHEN length(b.content) > 60 THEN substr(b.content, 1, 60) || '...' ELSE b.content END AS preview FROM edges e JOIN nodes a ON a.sample_id = e.sample_id AND a.node_id = e.src AND a.level = 'fact' JOIN nodes b ON b.sample_id = e.sample_id AND b.node_id = e.dst AND b.level = 'fact'")
def lateral_links(spark: SparkSession, d: str) -> DataFrame:
    n, e = M.graph(spark, d)
    f = n.where("level = 'fact'")
    a = f.select("sample_id", F.col("node_id").alias("src"), F.col("node_seq").alias("a_seq"))
    b = f.select("sample_id", F.col("node_id").alias("dst"), F.col("node_seq").alias("b_seq"), "content")
    return e.join(a, ["sample_id", "src"]).join(b, ["sample_id", "dst"]).select("sample_id", "a_seq", "b_seq", T.preview("content").alias("preview"))


@query("degree_lists", f"WITH {M.GRAPH}, ends AS (SELECT sample_id, src AS node_id, dst AS o, NULL AS i FROM edges UNION ALL SELECT sample_id, dst, NULL, src FROM edges) SELECT sample_id, node_id, count(i)::BIGINT AS n_in, count(o)::BIGINT AS n_out, coalesce(string_agg(i, ',' ORDER BY i), '') AS predecessors, coalesce(string_agg(o, ',' ORDER BY o), '') AS successors FROM ends GROUP BY ALL")
def degree_lists(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(M.graph(spark, d)[1], K)


@query("persona_scene_links", f"""WITH {M.GRAPH}, p AS (SELECT a.sample_id, a.node_id AS src, b.node_id AS dst, b.node_seq, round({M.sql_cosine('a.vec', 'b.vec')}, 9) AS weight FROM nodes a JOIN nodes b ON a.sample_id = b.sample_id AND a.level = 'persona' AND b.level = 'scene'),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, src ORDER BY weight DESC, node_seq DESC) AS i, count(*) OVER (PARTITION BY sample_id, src) AS n FROM p) SELECT sample_id, src, dst, round(weight, 6) AS weight FROM r WHERE i <= greatest(5, n // 5) AND weight > 0.2""")
def persona_scene_links(spark: SparkSession, d: str) -> DataFrame:
    n = M.graph(spark, d)[0]
    return hierarchy.link_personas(n.where("level = 'persona'"), n.where("level = 'scene'"), K).withColumn("weight", r6("weight"))


@query("prefix_neighbors", f"""WITH {M.FACTS}, docs AS (SELECT sample_id, node_id, node_seq, {M.sql_doc('content', 'context', 'keywords', 'tags')} AS doc FROM facts), nodes AS (SELECT *, {M.sql_vec('doc')} AS vec FROM docs),
s AS (SELECT a.sample_id, a.node_seq AS q_seq, b.node_seq AS n_seq, round({M.sql_cosine('a.vec', 'b.vec')}, 9) AS c FROM nodes a JOIN nodes b ON a.sample_id = b.sample_id AND b.node_seq <= a.node_seq)
SELECT sample_id, q_seq, n_seq, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, q_seq ORDER BY c DESC, n_seq DESC) AS rank FROM s) WHERE rank <= 5""")
def prefix_neighbors(spark: SparkSession, d: str) -> DataFrame:
    n = M.graph(spark, d)[0].where("level = 'fact'")
    a, b = n.select("sample_id", F.col("node_seq").alias("q_seq"), F.col("vec").alias("a")), n.select("sample_id", F.col("node_seq").alias("n_seq"), F.col("vec").alias("b"))
    s = a.join(b, "sample_id").where("n_seq <= q_seq").withColumn("c", F.round(cosine("a", "b"), 9))
    return retrieval.top_k(s, ["sample_id", "q_seq"], "c", "n_seq", 5).select("sample_id", "q_seq", "n_seq", "rank")


@query("prefix_bm25", f"""WITH {M.FACTS}, docs AS (SELECT sample_id, node_seq, {M.sql_tokens(M.sql_doc('content', 'context', 'keywords', 'tags'))} AS w FROM facts),
tf AS (SELECT sample_id, node_seq, dl, term, count(*) AS tf FROM (SELECT sample_id, node_seq, len(w) AS dl, unnest(w) AS term FROM docs) GROUP BY ALL),
pre AS (SELECT a.sample_id, a.node_seq AS q_seq, count(*) AS n, avg(len(b.w)) AS avgdl FROM docs a JOIN docs b ON a.sample_id = b.sample_id AND b.node_seq <= a.node_seq GROUP BY ALL),
raw AS (SELECT p.sample_id, q_seq, term, any_value(avgdl) AS avgdl, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM pre p JOIN tf ON tf.sample_id = p.sample_id AND tf.node_seq <= q_seq GROUP BY p.sample_id, q_seq, term),
idf AS (SELECT sample_id, q_seq, term, avgdl, CASE WHEN r < 0 THEN 0.25 * avg(r) OVER (PARTITION BY sample_id, q_seq) ELSE r END AS idf FROM raw),
hit AS (SELECT i.sample_id, i.q_seq, d.node_seq AS n_seq, sum(a.tf * idf * d.tf * 2.5 / (d.tf + 1.5 * (0.25 + 0.75 * d.dl / avgdl))) AS s FROM idf i JOIN tf a ON a.sample_id = i.sample_id AND a.node_seq = q_seq AND a.term = i.term JOIN tf d ON d.sample_id = i.sample_id AND d.term = i.term AND d.node_seq <= q_seq GROUP BY ALL)
SELECT a.sample_id, a.node_seq AS q_seq, b.node_seq AS n_seq, round(coalesce(s, 0.0), 6) AS bm25 FROM docs a JOIN docs b ON a.sample_id = b.sample_id AND b.node_seq <= a.node_seq LEFT JOIN hit ON hit.sample_id = a.sample_id AND hit.q_seq = a.node_seq AND hit.n_seq = b.node_seq""")
def prefix_bm25(spark: SparkSession, d: str) -> DataFrame:
    n = M.facts(spark, d).withColumn("doc", T.index_document("content", "context", "keywords", "tags")).withColumn("seq2", F.col("node_seq"))
    s = bm25.prefix_scores(n.select("sample_id", "node_seq", "seq2", "doc"), K, "node_seq", "seq2", "doc")
    return s.select("sample_id", F.col("query").alias("q_seq"), F.col("other").alias("n_seq"), r6("bm25").alias("bm25"))


@query("reindex", f"WITH {M.GRAPH} SELECT sample_id, node_id, doc FROM nodes")
def reindex(spark: SparkSession, d: str) -> DataFrame:
    n = M.graph(spark, d)[0].drop("doc")
    old = n.withColumn("content", F.lit("stale")).withColumn("version", F.lit(0))
    now = graph.latest(old.unionByName(n.withColumn("version", F.lit(1))), ["sample_id", "node_id"])
    return now.select("sample_id", "node_id", T.index_document("content", "context", "keywords", "tags").alias("doc"))


@query("vector_search", f"WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) SELECT query_id, vec_id, round(c, 6) AS score, rank::INT AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, {M.sql_cosine('a.v', 'b.v')} AS c, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({M.sql_cosine('a.v', 'b.v')}, 9) DESC, b.vec_id DESC) AS rank FROM e a JOIN e b USING (label)) WHERE rank <= 5")
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    e = M.table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").alias("vec"))
    return retrieval.block_search(e, ["label"], "vec_id", 5).select(F.col("query").alias("query_id"), "vec_id", r6("score").alias("score"), "rank")


@query("index_build", f"WITH {M.GRAPH}, {M.QUERIES}, {M.sql_bm25()} SELECT sample_id, term, node_id, round(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)), 6) AS w FROM idf JOIN tf USING (sample_id, term)")
def index_build(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index of all nodes, built anew from the turns."""
    # documents are written, since three statistics are made of them
    docs = written(M.build(spark, d)[0].select("sample_id", "node_id", "doc"), "index-documents")
    return bm25.weights(docs, K, "node_id", "doc").select("sample_id", "term", "node_id", r6("w").alias("w"))

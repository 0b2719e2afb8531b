"""The driver's tables seen as the engine's model, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import hash_embedding, index_document
from sparkloom.operators import bm25, hierarchy, retrieval
from sparkloom.session import written
from sparkloom.streaming import ingest

KEYS = ["sample_id"]
GRAPH_COLUMNS = ["sample_id", "node_id", "node_seq", "level", "content", "timestamp", "keywords", "context", "tags"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("turn") + 1).cast("string"), 2, "0"), F.lit(" 09:00:00"))
    return c.select(F.col("conv_id").cast("string").alias("sample_id"), F.col("turn").alias("turn_seq"), day.alias("date_time"), F.col("role").alias("speaker"), "text")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.facts(turns(spark, sf_dir))


def communities(fact_rows: DataFrame) -> DataFrame:
    return fact_rows.select("sample_id", "node_id", F.floor(F.col("node_seq") / 3).cast("long").alias("community"))


_tables: dict[tuple[str, str, str, str], DataFrame] = {}


def _stamp(spark: SparkSession, sf_dir: str) -> str:
    """Tells one state of the turns' files from another: when they were last changed, and how long they are."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/conversations.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{fs.getFileStatus(path).getModificationTime()}-{fs.getContentSummary(path).getLength()}"


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table of the graph or its index: written once a session into the shared folder, read by every query; written anew
    if the turns' files have changed since."""
    key = (spark.sparkContext.applicationId, sf_dir, name, _stamp(spark, sf_dir))
    if key not in _tables:
        _tables[key] = written(make(), f"graph-{name}")
    return _tables[key]


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as written."""
    return stored(spark, sf_dir, "nodes", lambda: build(spark, sf_dir)[0]), stored(spark, sf_dir, "edges", lambda: build(spark, sf_dir)[1])


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies and idfs of every sample's terms, as written."""
    return stored(spark, sf_dir, "terms", lambda: bm25.vocabulary(graph(spark, sf_dir)[0], KEYS, "node_id", "doc"))


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every node expands to, as written."""
    return stored(spark, sf_dir, "near", lambda: retrieval.neighbours(*graph(spark, sf_dir), KEYS))


def build(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): facts, a scene for three turns, a persona for each speaker, links of turns two apart."""
    f = facts(spark, sf_dir)
    scenes, contains = hierarchy.build_scenes(f, communities(f), KEYS)
    empty = F.lit(None).cast("array<string>")
    scenes = scenes.withColumn("node_seq", F.col("node_seq") + 100).select("sample_id", "node_id", "node_seq", "level", "content", "timestamp", empty.alias("keywords"), F.lit(None).cast("string").alias("context"), empty.alias("tags"))
    t = turns(spark, sf_dir)
    who = F.concat(F.lit("p_"), "sample_id", F.lit("_"), "speaker")
    personas = t.groupBy("sample_id", "speaker").agg(F.count("*").alias("n"), F.min("turn_seq").alias("first"), F.max("date_time").alias("timestamp")).select("sample_id", who.alias("node_id"), (F.col("first") + 200).alias("node_seq"), F.lit("persona").alias("level"), F.concat("speaker", F.lit(" took "), F.col("n").cast("string"), F.lit(" turns")).alias("content"), "timestamp", empty.alias("keywords"), F.lit(None).cast("string").alias("context"), F.array("speaker").alias("tags"))
    nodes = reduce(DataFrame.unionByName, [f.select(*GRAPH_COLUMNS), scenes.select(*GRAPH_COLUMNS), personas])
    doc = index_document("content", "context", "keywords", "tags")
    nodes = nodes.withColumn("doc", doc).withColumn("vec", hash_embedding("doc"))
    spoke = t.select("sample_id", who.alias("src"), F.concat(F.lit("s_"), "sample_id", F.lit("_"), F.floor(F.col("turn_seq") / 3).cast("string")).alias("dst"), F.floor(F.col("turn_seq") / 3).cast("long").alias("edge_seq")).distinct()
    a = f.select("sample_id", F.col("node_id").alias("src"), F.col("node_seq").alias("edge_seq"))
    b = f.select("sample_id", F.col("node_id").alias("dst"), (F.col("node_seq") - 2).alias("edge_seq"))
    near = a.join(b, ["sample_id", "edge_seq"]).select("sample_id", "src", "dst", "edge_seq")
    related = near.unionByName(near.select("sample_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_seq"))
    kinds = lambda df, k: df.select("sample_id", "src", "dst", "edge_seq", F.lit(k).alias("type"))
    return nodes, reduce(DataFrame.unionByName, [kinds(contains, "contains"), kinds(spoke, "contains"), kinds(related, "persona_related")])


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn asks its own sample."""
    return turns(spark, sf_dir).where("speaker = 'user'").select("sample_id", F.col("turn_seq").alias("query_id"), "text").withColumn("vec", hash_embedding("text"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn as prediction, the assistant's reply as reference."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "reference": F.lead("text").over(w)})
    return c.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prediction"), "reference", (F.col("turn") % 5 + 1).cast("int").alias("category"))


# -- the same as DuckDB SQL ------------------------------------------------------------------------------------------


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+')"


def sql_vec(x: str) -> str:
    one = ", ".join(f"len(list_filter(h, lambda v: v = '{d}'))::DOUBLE" for d in "0123456789abcdef")
    return f"(SELECT [{one}] FROM (SELECT list_transform({sql_tokens(x)}, lambda w: substr(md5(w), 1, 1)) AS h))"


def sql_cosine(a: str, b: str) -> str:
    n = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"CASE WHEN {n} > 0 THEN list_dot_product({a}, {b}) / {n} ELSE 0.0 END"


def sql_top_terms(x: str, n: int) -> str:
    words = sql_tokens(f"lower({x})")
    return f"(SELECT list_transform(list_sort(list_transform(list_distinct(ws), lambda a: {{'n': -len(list_filter(ws, lambda b: b = a)), 't': a}}))[1:{n}], lambda s: s.t) FROM (SELECT {words} AS ws))"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_join(x: str) -> str:
    return f"coalesce(array_to_string({x}, ', '), '')"


def sql_doc(content: str, context: str, keywords: str, tags: str) -> str:
    return f"'content: ' || coalesce({content}, '') || ' context: ' || coalesce({context}, '') || ' keywords: ' || {sql_join(keywords)} || ' tags: ' || {sql_join(tags)}"


TURNS = "t AS (SELECT conv_id::VARCHAR AS sample_id, turn AS turn_seq, '2024-01-' || lpad((turn + 1)::VARCHAR, 2, '0') || ' 09:00:00' AS date_time, role AS speaker, text FROM conversations)"
FACTS = f"""{TURNS}, k AS (SELECT *, {sql_top_terms("text", 3)} AS kw FROM t),
facts AS (SELECT sample_id, sha256(sample_id || '|fact|' || turn_seq) AS node_id, turn_seq AS node_seq, 'fact' AS level, 'Speaker ' || speaker || ' says: ' || text AS content, date_time AS "timestamp", kw AS keywords, regexp_extract(text, '^([^.]*)', 1) AS context, kw[1:1] AS tags, turn_seq // 3 AS community FROM k)"""
GRAPH = f"""{FACTS},
scenes AS (SELECT sample_id, 's_' || sample_id || '_' || community AS node_id, 100 + community AS node_seq, 'scene' AS level, string_agg('- [' || "timestamp" || '] ' || content, chr(10) ORDER BY node_seq) AS content, max("timestamp") AS "timestamp", NULL::VARCHAR[] AS keywords, NULL::VARCHAR AS context, NULL::VARCHAR[] AS tags FROM facts GROUP BY sample_id, community),
personas AS (SELECT sample_id, 'p_' || sample_id || '_' || speaker AS node_id, 200 + min(turn_seq) AS node_seq, 'persona' AS level, speaker || ' took ' || count(*) || ' turns' AS content, max(date_time) AS "timestamp", NULL::VARCHAR[] AS keywords, NULL::VARCHAR AS context, [speaker] AS tags FROM t GROUP BY sample_id, speaker),
plain AS (SELECT * EXCLUDE (community) FROM facts UNION ALL BY NAME SELECT * FROM scenes UNION ALL BY NAME SELECT * FROM personas),
documented AS (SELECT *, {sql_doc("content", "context", "keywords", "tags")} AS doc FROM plain),
nodes AS (SELECT *, {sql_vec("doc")} AS vec FROM documented),
edges AS (SELECT sample_id, 's_' || sample_id || '_' || community AS src, node_id AS dst, node_seq AS edge_seq, 'contains' AS type FROM facts
  UNION ALL SELECT DISTINCT sample_id, 'p_' || sample_id || '_' || speaker, 's_' || sample_id || '_' || (turn_seq // 3), turn_seq // 3, 'contains' FROM t
  UNION ALL SELECT a.sample_id, a.node_id, b.node_id, a.node_seq, 'persona_related' FROM facts a JOIN facts b ON a.sample_id = b.sample_id AND a.node_seq = b.node_seq - 2
  UNION ALL SELECT a.sample_id, b.node_id, a.node_id, a.node_seq, 'persona_related' FROM facts a JOIN facts b ON a.sample_id = b.sample_id AND a.node_seq = b.node_seq - 2)"""
QUERIES = f"q AS (SELECT sample_id, turn_seq AS query_id, text, {sql_vec('text')} AS vec FROM t WHERE speaker = 'user')"
PAIRS = "pairs AS (SELECT conv_id, turn, text AS prediction, reference, (turn % 5 + 1)::INT AS category FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS reference FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"


def sql_bm25(docs: str = "nodes", text: str = "doc") -> str:
    """CTEs up to `bm25`(sample_id, query_id, node_id, node_seq, s): every document of the query's sample."""
    return f"""
toks AS (SELECT sample_id, node_id, {sql_tokens(text)} AS w FROM {docs}),
post AS (SELECT sample_id, node_id, len(w) AS dl, unnest(w) AS term FROM toks),
tf AS (SELECT sample_id, node_id, dl, term, count(*) AS tf FROM post GROUP BY ALL),
stat AS (SELECT sample_id, count(*) AS n, avg(len(w)) AS avgdl FROM toks GROUP BY sample_id),
raw AS (SELECT tf.sample_id, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r, any_value(avgdl) AS avgdl, count(*) AS df FROM tf JOIN stat USING (sample_id) GROUP BY tf.sample_id, term),
low AS (SELECT sample_id, 0.25 * avg(r) AS floor FROM raw GROUP BY sample_id),
idf AS (SELECT sample_id, term, df, avgdl, CASE WHEN r < 0 THEN floor ELSE r END AS idf FROM raw JOIN low USING (sample_id)),
asked AS (SELECT sample_id, query_id, term, count(*) AS qtf FROM (SELECT sample_id, query_id, unnest({sql_tokens("text")}) AS term FROM q) GROUP BY ALL),
hit AS (SELECT sample_id, query_id, node_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM asked JOIN idf USING (sample_id, term) JOIN tf USING (sample_id, term) GROUP BY ALL),
bm25 AS (SELECT q.sample_id, query_id, d.node_id, d.node_seq, coalesce(s, 0.0) AS s FROM q JOIN {docs} d USING (sample_id) LEFT JOIN hit USING (sample_id, query_id, node_id))"""


HYBRID = sql_bm25() + f""",
scaled AS (SELECT *, CASE WHEN max(s) OVER w > min(s) OVER w THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) ELSE 0.0 END AS sparse FROM bm25 WINDOW w AS (PARTITION BY sample_id, query_id)),
hybrid AS (SELECT sample_id, query_id, s.node_id, s.node_seq, (({sql_cosine("q.vec", "n.vec")}) + 1) / 2 AS dense, sparse FROM scaled s JOIN q USING (sample_id, query_id) JOIN nodes n USING (sample_id, node_id)),
scored AS (SELECT *, round(0.5 * dense + 0.5 * sparse, 9) AS score FROM hybrid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id, query_id ORDER BY score DESC, node_seq DESC) AS rank FROM scored)"""

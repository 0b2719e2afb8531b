"""The phases of the whole run as queries: what the offline job decides, answers and sums up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import metrics
from sparkloom.operators import job, retrieval, stats
from sparkloom.streaming import evolution

from . import data_queries as D
from . import model as M
from . import retrieval_queries as R
from .registry import ORACLE_SQL, query

K = M.KEYS
# from the survey: what is asked is the content, a fact is its own candidate, the floor is the mean idf of the prefix's terms
_NEAR = f"""{M.FACTS},
dv AS (SELECT sample_id, node_seq, node_id, content, {M.sql_vec('content')} AS qv, {M.sql_vec(M.sql_doc('content', 'context', 'keywords', 'tags'))} AS vec, {M.sql_tokens(M.sql_doc('content', 'context', 'keywords', 'tags'))} AS w FROM facts),
post AS (SELECT sample_id, node_seq, len(w) AS dl, unnest(w) AS term FROM dv),
tf AS (SELECT sample_id, node_seq, dl, term, count(*) AS tf FROM post GROUP BY ALL),
stat AS (SELECT a.sample_id, a.node_seq AS q_seq, count(*) AS n, avg(len(b.w)) AS avgdl FROM dv a JOIN dv b ON a.sample_id = b.sample_id AND b.node_seq <= a.node_seq GROUP BY ALL),
raw AS (SELECT s.sample_id, q_seq, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r, any_value(avgdl) AS avgdl FROM stat s JOIN tf ON tf.sample_id = s.sample_id AND node_seq <= q_seq GROUP BY ALL),
low AS (SELECT sample_id, q_seq, 0.25 * avg(r) AS floor FROM raw GROUP BY ALL),
asked AS (SELECT sample_id, node_seq AS q_seq, term, count(*) AS qtf FROM (SELECT sample_id, node_seq, unnest({M.sql_tokens('content')}) AS term FROM dv) GROUP BY ALL),
hit AS (SELECT sample_id, q_seq, node_seq AS n_seq, sum(qtf * (CASE WHEN r < 0 THEN floor ELSE r END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM asked JOIN raw USING (sample_id, q_seq, term) JOIN low USING (sample_id, q_seq) JOIN tf USING (sample_id, term) WHERE tf.node_seq <= q_seq GROUP BY ALL),
pb AS (SELECT a.sample_id, a.node_id, b.node_id AS other, a.node_seq AS q_seq, b.node_seq AS n_seq, a.qv, b.vec, coalesce(s, 0.0) AS bm25 FROM dv a JOIN dv b ON a.sample_id = b.sample_id AND b.node_seq <= a.node_seq LEFT JOIN hit ON hit.sample_id = a.sample_id AND q_seq = a.node_seq AND n_seq = b.node_seq),
scaled AS (SELECT *, CASE WHEN max(bm25) OVER w > min(bm25) OVER w THEN (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) ELSE 0.0 END AS sparse FROM pb WINDOW w AS (PARTITION BY sample_id, q_seq)),
cosed AS (SELECT sample_id, node_id, other, n_seq, sparse, round({M.sql_cosine('qv', 'vec')}, 9) AS c FROM scaled),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, node_id ORDER BY round(0.5 * (c + 1) / 2 + 0.5 * sparse, 9) DESC, n_seq DESC) AS rank FROM cosed) WHERE rank <= 5)"""


@query("job_neighbours", f"WITH {_NEAR} SELECT sample_id, node_id, other, rank::INT AS rank FROM near")
def job_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return job.prefix_neighbours(M.facts(spark, d)).select("sample_id", "node_id", "other", "rank")


@query("job_evolution", f"WITH {_NEAR} SELECT DISTINCT sample_id, src, dst FROM (SELECT sample_id, node_id AS src, other AS dst FROM near WHERE c >= 0.8 UNION ALL SELECT sample_id, other, node_id FROM near WHERE c >= 0.8) WHERE src <> dst")
def job_evolution(spark: SparkSession, d: str) -> DataFrame:
    return job.offline_links(job.prefix_neighbours(M.facts(spark, d)))


@query("stream_evolution", ORACLE_SQL["job_evolution"])
def stream_evolution(spark: SparkSession, d: str) -> DataFrame:
    """The links that the stream's state gives, over the whole table as one batch."""
    return evolution.links(evolution.evolving(M.turns(spark, d), job.NEIGHBOURS))


_BEST = f"{M.GRAPH}, {M.QUERIES}, {M.HYBRID}, best AS (SELECT sample_id, query_id, regexp_extract(content, '^([^.]*)', 1) AS prediction FROM ranked JOIN nodes USING (sample_id, node_id) WHERE rank = 1)"


def _found(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, e = M.graph(spark, d)
    return retrieval.graph_traversal(M.queries_of(spark, d), n, n, e, K, 5, M.index(spark, d), M.near(spark, d)), n


@query("job_answers", f"WITH {_BEST} SELECT sample_id, query_id, prediction FROM best")
def job_answers(spark: SparkSession, d: str) -> DataFrame:
    return job.offline_answer(*_found(spark, d))


# the assistant's reply to the question is the reference
_SCORED = f"{_BEST}, given AS (SELECT conv_id, turn, reference, category FROM (SELECT *, (turn % 5 + 1)::INT AS category, lead(role) OVER w AS next_role, lead(text) OVER w AS reference FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'), pairs AS (SELECT conv_id, turn, prediction, reference, category FROM given JOIN best ON best.sample_id = conv_id::VARCHAR AND query_id = turn)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    answers = job_answers(spark, d)
    given = M.pairs(spark, d).select(F.col("conv_id").cast("string").alias("sample_id"), F.col("turn").alias("query_id"), "reference", "category")
    return answers.join(given, ["sample_id", "query_id"])


@query("job_scores", f"WITH {_SCORED} SELECT conv_id::VARCHAR AS sample_id, turn AS query_id, category, round({D._F1_VALUE}, 6) AS f1 FROM ({D._F1})")
def job_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("sample_id", "query_id", "category", F.round(metrics.token_f1("prediction", "reference"), 6).alias("f1"))


@query("job_summary", f"WITH {_SCORED}, v AS (SELECT category, {D._F1_VALUE} AS f1 FROM ({D._F1})) SELECT CASE WHEN grouping(category) = 1 THEN 'overall' ELSE category::VARCHAR END AS scope, count(*) AS questions, round(avg(f1), 6) AS f1 FROM v GROUP BY GROUPING SETS ((), (category))")
def job_summary(spark: SparkSession, d: str) -> DataFrame:
    """The run summary's record, opened to a row a scope."""
    rows = _scored(spark, d).select(F.col("category").cast("string").alias("category"), F.create_map(F.lit("f1"), metrics.token_f1("prediction", "reference")).alias("metrics"))
    one = job.run_summary(rows, "offline")
    scopes = one.select(F.explode("aggregate_metrics_for_this_run").alias("scope", "means"), "questions_processed_in_this_run", "category_distribution_in_this_run")
    n = F.when(F.col("scope") == "overall", F.col("questions_processed_in_this_run")).otherwise(F.col("category_distribution_in_this_run")[F.col("scope")])
    return scopes.select("scope", n.alias("questions"), F.round(F.col("means")["f1"], 6).alias("f1"))


@query("job_resume", f"WITH {M.TURNS}, {M.QUERIES} SELECT sample_id, query_id FROM q WHERE query_id >= 2 AND NOT EXISTS (FROM q p WHERE p.sample_id = q.sample_id AND p.query_id < 2 AND {M.sql_strip('p.text')} = {M.sql_strip('q.text')})")
def job_resume(spark: SparkSession, d: str) -> DataFrame:
    """What is left to answer where the first two turns' questions are answered."""
    q = M.queries_of(spark, d).withColumnRenamed("text", "question")
    return stats.unanswered(q, q.where("query_id < 2"), K).select("sample_id", "query_id")

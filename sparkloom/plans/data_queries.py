"""Queries over turns, datasets, result logs, metrics, replies and graph maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import metrics, text as T
from sparkloom.functions.vector import cosine
from sparkloom.operators import communities, embedder, graph, hierarchy, stats
from sparkloom.sources import dataset, results

from . import model as M
from .registry import query

K = M.KEYS
r6 = lambda c: F.round(c, 6)
_CAT = "(turn % 5 + 1)::INT"


# -- datasets: conversations as nested JSON with a key for each session, read back through the loader -----------------


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of three turns; those whose number is a multiple of 4 have no time. Every fifth turn has a picture."""
    c = M.table(spark, d, "conversations")
    pic = F.col("turn") % 5 == 4
    turn = F.struct(
        F.col("role").alias("speaker"), F.concat(F.lit("D"), (F.floor(F.col("turn") / 3) + 1).cast("string"), F.lit(":"), (F.col("turn") % 3 + 1).cast("string")).alias("dia_id"), F.col("text"),
        F.when(pic, F.lit("http://x")).alias("img_url"), F.when(pic | (F.col("turn") % 7 == 6), F.lit("a picture")).alias("blip_caption"),
    )
    s = c.groupBy("conv_id", (F.floor(F.col("turn") / 3) + 1).alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]).alias("turns"))
    key = F.concat(F.lit("session_"), F.col("n").cast("string"))
    entries = F.array(F.struct(key.alias("k"), F.to_json("turns").alias("v")), F.struct(F.concat(key, F.lit("_date_time")).alias("k"), F.when(F.col("n") % 4 != 0, F.concat(F.lit("day "), F.col("n").cast("string"))).alias("v")))
    talk = s.groupBy("conv_id").agg(F.map_from_entries(F.filter(F.flatten(F.collect_list(entries)), lambda e: e["v"].isNotNull())).alias("m"))
    talk = talk.select("conv_id", F.map_concat("m", F.create_map(F.lit("speaker_a"), F.lit("user"), F.lit("speaker_b"), F.lit("assistant"))).alias("conversation"))
    q = c.where("role = 'user'").withColumn("cat", (F.col("turn") % 5 + 1).cast("int")).withColumn("mark", F.concat(F.lit("D9:"), (F.col("turn") % 3 + 1).cast("string")))
    one = F.struct(F.col("text").alias("question"), F.when(F.col("cat") != 5, F.lit("yes")).alias("answer"), F.when(F.col("turn") % 2 == 0, F.array("mark")).alias("evidence"), F.col("cat").alias("category"), F.when(F.col("cat") == 5, F.lit("no")).alias("adversarial_answer"))
    asked = q.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("q")))), lambda x: x["q"]).alias("qa"))
    both = talk.join(asked, "conv_id", "left").withColumn("qa", F.coalesce("qa", F.array().cast(asked.schema["qa"].dataType)))
    # a file a conversation: one sample each, told apart by conv_id
    json = F.concat(F.lit("["), F.to_json(F.struct("qa", "conversation")), F.lit("]"))
    files = both.select(F.col("conv_id").cast("string").alias("file"), json.alias("json"))
    opened = files.select("file", F.explode(F.from_json("json", dataset.schemas.DATASET)).alias("sample"))
    return opened.select(F.col("file").alias("sample_id"), "sample")


_S = """c AS (SELECT conv_id::VARCHAR AS sample_id, turn, role, text, turn // 3 + 1 AS session_id, turn % 3 AS turn_pos, turn % 5 = 4 AS pic, turn % 5 = 4 OR turn % 7 = 6 AS img FROM conversations),
st AS (SELECT sample_id, session_id, turn_pos, 'day ' || session_id AS date_time, role AS speaker, 'D' || session_id || ':' || (turn_pos + 1) AS dia_id, CASE WHEN pic THEN CASE WHEN text = '' THEN '[Image: a picture]' ELSE '[Image: a picture] ' || text END ELSE text END AS text, img AS has_image FROM c WHERE session_id % 4 <> 0),
sq AS (SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY turn) - 1)::INT AS qa_idx, text AS question, (turn % 5 + 1)::INT AS category, CASE WHEN turn % 5 <> 4 THEN 'yes' END AS answer, CASE WHEN turn % 5 = 4 THEN 'no' END AS adversarial_answer, CASE WHEN turn % 2 = 0 THEN 'D9:' || (turn % 3 + 1) ELSE '' END AS mark FROM c WHERE role = 'user')"""
_IMG = "EXISTS (SELECT 1 FROM st WHERE st.sample_id = sq.sample_id AND has_image AND mark <> '' AND ends_with(dia_id, split_part(mark, ':', 2)))"


@query("dataset_turns", f"WITH {_S} SELECT sample_id, session_id::INT AS session_id, turn_pos::INT AS turn_pos, date_time, speaker, dia_id, text, has_image FROM st")
def dataset_turns(spark: SparkSession, d: str) -> DataFrame:
    return dataset.turns(samples(spark, d))


@query("dataset_turn_order", f"WITH {_S} SELECT sample_id, dia_id, row_number() OVER (PARTITION BY sample_id ORDER BY session_id, turn_pos) - 1 AS turn_seq FROM st")
def dataset_turn_order(spark: SparkSession, d: str) -> DataFrame:
    return dataset.numbered(dataset.turns(samples(spark, d))).select("sample_id", "dia_id", "turn_seq")


@query("dataset_qa", f"WITH {_S} SELECT sample_id, qa_idx, question, category, answer, adversarial_answer, CASE WHEN category = 5 THEN adversarial_answer ELSE answer END AS final_answer, mark AS evidence FROM sq")
def dataset_qa(spark: SparkSession, d: str) -> DataFrame:
    return dataset.qa(samples(spark, d)).withColumn("evidence", F.array_join("evidence", ","))


@query("dataset_speakers", "SELECT DISTINCT conv_id::VARCHAR AS sample_id, 'user' AS speaker_a, 'assistant' AS speaker_b, 0 AS n_summaries FROM conversations")
def dataset_speakers(spark: SparkSession, d: str) -> DataFrame:
    return dataset.speakers(samples(spark, d)).select("sample_id", "speaker_a", "speaker_b", F.size("session_summary").alias("n_summaries"))


@query("image_evidence", f"WITH {_S} SELECT sample_id, qa_idx FROM sq WHERE {_IMG}")
def image_evidence(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    return dataset.image_evidence(dataset.qa(s), dataset.turns(s))


@query("dataset_statistics", f"WITH {_S} SELECT (SELECT count(DISTINCT sample_id) FROM c) AS samples, (SELECT count(DISTINCT (sample_id, session_id)) FROM st) AS sessions, (SELECT count(*) FROM st) AS turns, (SELECT count(*) FROM sq) AS questions, (SELECT count(adversarial_answer) FROM sq) AS adversarial")
def dataset_statistics(spark: SparkSession, d: str) -> DataFrame:
    return dataset.dataset_statistics(samples(spark, d))


@query("load_statistics", f"WITH {_S}, n AS (SELECT sample_id, count(q.qa_idx) AS n, count(i.qa_idx) AS images FROM (SELECT DISTINCT sample_id FROM c) LEFT JOIN sq q USING (sample_id) LEFT JOIN (SELECT sample_id, qa_idx FROM sq WHERE {_IMG}) i USING (sample_id, qa_idx) GROUP BY sample_id) SELECT sum(n)::BIGINT AS questions, sum(images)::BIGINT AS image_questions, avg(n) AS avg_questions, min(n) AS min_questions, max(n) AS max_questions, avg(images) AS avg_images FROM n")
def load_statistics(spark: SparkSession, d: str) -> DataFrame:
    return dataset.load_statistics(samples(spark, d))


@query("utterances", "SELECT conv_id, turn, 'Speaker ' || role || ' says: ' || text AS utterance FROM conversations")
def utterances(spark: SparkSession, d: str) -> DataFrame:
    return M.table(spark, d, "conversations").select("conv_id", "turn", T.utterance("role", "text").alias("utterance"))


@query("category_filter", f"WITH {M.PAIRS} SELECT conv_id, turn, category FROM pairs WHERE category IN (1, 2, 3, 4)")
def category_filter(spark: SparkSession, d: str) -> DataFrame:
    return M.pairs(spark, d).where(F.col("category").isin(1, 2, 3, 4)).select("conv_id", "turn", "category")


@query("prefix_skip", "SELECT conv_id, turn, text FROM conversations WHERE turn >= (SELECT 2)")
def prefix_skip(spark: SparkSession, d: str) -> DataFrame:
    done = 2  # turns processed before
    return M.table(spark, d, "conversations").where(F.col("turn") >= done).select("conv_id", "turn", "text")


@query("head_sample", "SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id < greatest(1, floor((SELECT count(DISTINCT conv_id) FROM conversations) * 0.29::DOUBLE))")
def head_sample(spark: SparkSession, d: str) -> DataFrame:
    return stats.head_sample(M.table(spark, d, "conversations").select("conv_id").distinct(), "conv_id", 0.29)


# -- result logs -----------------------------------------------------------------------------------------------------

_LOG = f"""WITH {M.PAIRS}, log AS (SELECT conv_id::VARCHAR AS sample_id, turn, prediction, reference, CASE WHEN turn % 11 = 10 THEN NULL ELSE category END AS category, turn % 3 AS qid, length(prediction) / 10.0::DOUBLE AS f1, CASE WHEN turn % 2 = 0 THEN 0.5::DOUBLE END AS bleu1 FROM pairs)"""


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a log: a result for each pair, and for each a blank, a broken and a metadata line."""
    p = M.pairs(spark, d).withColumn("category", F.when(F.col("turn") % 11 == 10, None).otherwise(F.col("category")))
    scores = F.map_from_entries(F.filter(F.array(F.struct(F.lit("f1").alias("k"), (F.length("prediction") / 10.0).alias("v")), F.struct(F.lit("bleu1").alias("k"), F.when(F.col("turn") % 2 == 0, F.lit(0.5)).alias("v"))), lambda e: e["v"].isNotNull()))
    record = F.to_json(F.struct(F.lit("qa_result").alias("type"), F.col("conv_id").cast("string").alias("sample_id"), (F.col("turn") % 3).cast("int").alias("question_id"), F.col("turn").cast("int").alias("question_id_in_sample"), F.col("prediction").alias("question"), "prediction", "reference", "category", scores.alias("metrics")))
    other = F.array(record, F.lit(""), F.lit('{"type": "qa_result", broken'), F.concat(F.lit('{"type":"metadata","model":"m'), F.col("conv_id").cast("string"), F.lit('"}')))
    return p.select(F.explode(other).alias("line"))


@query("results_scan", _LOG + " SELECT sample_id, turn::INT AS question_id_in_sample, prediction, category FROM log")
def results_scan(spark: SparkSession, d: str) -> DataFrame:
    return results.results(log_lines(spark, d)).select("sample_id", "question_id_in_sample", "prediction", "category")


@query("results_flat", _LOG + " SELECT sample_id, (CASE WHEN qid = 0 THEN turn ELSE qid END)::INT AS question_id, category, coalesce(CASE category WHEN 1 THEN 'Multi-Hop' WHEN 2 THEN 'Temporal' WHEN 3 THEN 'Open-Domain' WHEN 4 THEN 'Single-Hop' WHEN 5 THEN 'Adversarial' END, 'Unknown') AS category_name, prediction AS question, reference, prediction, f1, bleu1 FROM log")
def results_flat(spark: SparkSession, d: str) -> DataFrame:
    return results.flattened(results.results(log_lines(spark, d)), ("f1", "bleu1"))


@query("results_extract", _LOG + " SELECT sample_id, turn::INT AS question_id_in_sample, f1 FROM log WHERE category = 2")
def results_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = results.extract(results.results(log_lines(spark, d)), 2)
    return rows.select("sample_id", "question_id_in_sample", F.col("metrics")["f1"].alias("f1"))


@query("results_delete", _LOG + " SELECT kind, count(*) AS n FROM (SELECT 'result' AS kind FROM log WHERE NOT coalesce(category IN (1, 2) AND sample_id IN ('0', '1', '2', '3'), false) UNION ALL SELECT 'broken' FROM log UNION ALL SELECT 'metadata' FROM log) GROUP BY kind")
def results_delete(spark: SparkSession, d: str) -> DataFrame:
    kept = results.without(log_lines(spark, d), ["0", "1", "2", "3"], [1, 2])
    kind = F.when(F.col("line").contains("broken"), "broken").when(F.col("line").contains('"metadata"'), "metadata").otherwise("result")
    return kept.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("resume_anti_join", rf"""WITH {M.PAIRS}, done AS (SELECT DISTINCT conv_id, {M.sql_strip('prediction')} AS q FROM pairs WHERE turn % 2 = 0) SELECT p.conv_id, turn FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.conv_id = p.conv_id AND done.q = {M.sql_strip('p.prediction')})""")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    p = M.pairs(spark, d).select("conv_id", "turn", F.concat(F.lit("\n "), "prediction").alias("question"))
    return stats.unanswered(p, p.where("turn % 2 = 0").select("conv_id", "question"), ["conv_id"]).select("conv_id", "turn")


# -- metrics ---------------------------------------------------------------------------------------------------------

_MT = lambda x: f"list_filter(string_split_regex(translate(lower({x}), '.,!?', '    '), '\\s+'), lambda w: w <> '')"


def _sql_f1(both: str, a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 AND {b} > 0 AND {both} > 0 THEN 2 * ({both}::DOUBLE / {a}) * ({both}::DOUBLE / {b}) / ({both}::DOUBLE / {a} + {both}::DOUBLE / {b}) ELSE 0.0 END"


_F1 = f"SELECT *, list_distinct({_MT('prediction')}) AS pt, list_distinct({_MT('reference')}) AS rt FROM pairs"
_F1_VALUE = _sql_f1("len(list_intersect(pt, rt))", "len(pt)", "len(rt)")


@query("metric_tokens", f"SELECT conv_id, turn, array_to_string({_MT('text')}, ' ') AS tokens FROM conversations")
def metric_tokens(spark: SparkSession, d: str) -> DataFrame:
    return M.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.metric_tokens("text"), " ").alias("tokens"))


@query("index_tokens", f"SELECT conv_id, turn, array_to_string({M.sql_tokens('text')}, ' ') AS tokens FROM conversations")
def index_tokens(spark: SparkSession, d: str) -> DataFrame:
    return M.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.index_tokens("text"), " ").alias("tokens"))


def _sql_treebank(x: str) -> str:
    for pattern, new in T.TREEBANK:
        quoted = [v.replace("'", "''") for v in (pattern, new.replace("$", "\\"))]
        x = f"regexp_replace({x}, '{quoted[0]}', '{quoted[1]}', 'g')"
    return f"list_filter(regexp_split_to_array({x}, '[ \\t\\n\\f\\r]+'), lambda t: t <> '')"


@query("treebank_tokens", f"SELECT conv_id, turn, array_to_string({_sql_treebank('text')}, ' ') AS tokens FROM conversations")
def treebank_tokens(spark: SparkSession, d: str) -> DataFrame:
    return M.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.treebank_tokens("text"), " ").alias("tokens"))


@query("distinct_tokens", f"SELECT conv_id, turn, len(list_distinct({_MT('text')}))::INT AS n FROM conversations")
def distinct_tokens(spark: SparkSession, d: str) -> DataFrame:
    return M.table(spark, d, "conversations").select("conv_id", "turn", F.size(F.array_distinct(T.metric_tokens("text"))).alias("n"))


@query("token_intersection", f"WITH {M.PAIRS} SELECT conv_id, turn, array_to_string(list_sort(list_intersect(pt, rt)), ' ') AS common FROM ({_F1})")
def token_intersection(spark: SparkSession, d: str) -> DataFrame:
    both = F.array_intersect(F.array_distinct(T.metric_tokens("prediction")), F.array_distinct(T.metric_tokens("reference")))
    return M.pairs(spark, d).select("conv_id", "turn", F.array_join(F.array_sort(both), " ").alias("common"))


@query("exact_match", rf"WITH {M.PAIRS} SELECT conv_id, turn, (lower({M.sql_strip('prediction')}) = lower({M.sql_strip('reference')}))::INT AS em FROM pairs")
def exact_match(spark: SparkSession, d: str) -> DataFrame:
    return M.pairs(spark, d).select("conv_id", "turn", metrics.exact_match("prediction", "reference").alias("em"))


@query("token_f1", f"WITH {M.PAIRS} SELECT conv_id, turn, round({_F1_VALUE}, 6) AS f1 FROM ({_F1})")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    return M.pairs(spark, d).select("conv_id", "turn", r6(metrics.token_f1("prediction", "reference")).alias("f1"))


_GRAMS = f"""tk AS (SELECT conv_id, turn, 'p' AS side, {M.sql_tokens('lower(prediction)')} AS w FROM pairs UNION ALL SELECT conv_id, turn, 'r', {M.sql_tokens('lower(reference)')} FROM pairs),
gr AS (SELECT conv_id, turn, side, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM tk, (SELECT unnest([1, 2, 3, 4]) AS n))),
cn AS (SELECT conv_id, turn, n, gram, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 'r') AS r FROM gr GROUP BY ALL),
ov AS (SELECT k.conv_id, k.turn, k.n, coalesce(sum(least(p, r)), 0)::BIGINT AS b, coalesce(sum(p), 0)::BIGINT AS p, coalesce(sum(r), 0)::BIGINT AS r FROM (SELECT conv_id, turn, n FROM pairs, (SELECT unnest([1, 2, 3, 4]) AS n)) k LEFT JOIN cn USING (conv_id, turn, n) GROUP BY ALL)"""


@query("rouge_n", f"WITH {M.PAIRS}, {_GRAMS} SELECT conv_id, turn, n::INT AS n, round({_sql_f1('b', 'p', 'r')}, 6) AS f FROM ov WHERE n <= 2")
def rouge_n(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rouge_n(M.pairs(spark, d), ["conv_id", "turn"]).withColumn("f", r6("f"))


_P = [f"(CASE WHEN b{n} = 0 THEN 0.1::DOUBLE ELSE b{n}::DOUBLE END / greatest(p{n}, 1))" for n in range(1, 5)]
_BP = "(CASE WHEN p1 > r1 THEN 1.0::DOUBLE WHEN p1 = 0 THEN 0.0::DOUBLE ELSE exp(1 - r1::DOUBLE / greatest(p1, 1)) END)"
_WIDE = "SELECT conv_id, turn, " + ", ".join(f"max(b) FILTER (n = {n}) AS b{n}, max(p) FILTER (n = {n}) AS p{n}, max(r) FILTER (n = {n}) AS r{n}" for n in range(1, 5)) + " FROM ov GROUP BY ALL"
_BLEU = ", ".join(
    f"round(CASE WHEN b1 = 0 THEN 0.0 ELSE {_BP} * exp({' + '.join(f'{w}::DOUBLE * ln({p})' for w, p in zip(ws, _P) if w)}) END, 6) AS bleu{m}" for m, ws in enumerate(metrics.BLEU_WEIGHTS, 1)
)


@query("bleu", f"WITH {M.PAIRS}, {_GRAMS} SELECT conv_id, turn, {_BLEU} FROM ({_WIDE})")
def bleu(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.bleu(M.pairs(spark, d), ["conv_id", "turn"])
    return out.select("conv_id", "turn", *[r6(f"bleu{m}").alias(f"bleu{m}") for m in range(1, 5)])


@query("sentence_similarity", f"WITH {M.PAIRS}, v AS (SELECT conv_id, turn, {M.sql_vec('prediction')} AS a, {M.sql_vec('reference')} AS b FROM pairs) SELECT conv_id, turn, round({M.sql_cosine('a', 'b')}, 6) AS similarity FROM v")
def sentence_similarity(spark: SparkSession, d: str) -> DataFrame:
    from sparkloom.functions.vector import cosine

    return M.pairs(spark, d).select("conv_id", "turn", r6(cosine(T.hash_embedding("prediction"), T.hash_embedding("reference"))).alias("similarity"))


_LCS = f"""lt AS (SELECT conv_id, turn, {M.sql_tokens('lower(prediction)')} AS a, {M.sql_tokens('lower(reference)')} AS b FROM pairs),
dp(conv_id, turn, a, b, i, r) AS (SELECT conv_id, turn, a, b, 0, list_transform(range(0, len(b) + 1), lambda x: 0::BIGINT) FROM lt
  UNION ALL SELECT conv_id, turn, a, b, i + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [CASE WHEN b[j] = a[i + 1] THEN r[j] + 1 ELSE r[j + 1] END]), lambda x, y: list_append(x, greatest(x[-1], y[1])), [0::BIGINT]) FROM dp WHERE i < len(a)),
lcs AS (SELECT conv_id, turn, r[-1] AS l, len(a) AS p, len(b) AS r FROM dp WHERE i = len(a))"""


@query("rouge_l", f"WITH RECURSIVE {M.PAIRS}, {_LCS} SELECT conv_id, turn, round({_sql_f1('l', 'p', 'r')}, 6) AS f FROM lcs")
def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return M.pairs(spark, d).select("conv_id", "turn", r6(metrics.rouge_l("prediction", "reference")).alias("f"))


_BERT = "(SELECT CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END FROM (SELECT CASE WHEN len(a) > 0 THEN len(list_filter(a, lambda x: list_contains(b, x)))::DOUBLE / len(a) ELSE 0.0 END AS p, CASE WHEN len(b) > 0 THEN len(list_filter(b, lambda x: list_contains(a, x)))::DOUBLE / len(b) ELSE 0.0 END AS r))"


@query("bert_score_tokens", f"WITH {M.PAIRS}, lt AS (SELECT conv_id, turn, {M.sql_tokens('lower(prediction)')} AS a, {M.sql_tokens('lower(reference)')} AS b FROM pairs) SELECT conv_id, turn, round({_BERT}, 6) AS bert_f1 FROM lt")
def bert_score_tokens(spark: SparkSession, d: str) -> DataFrame:
    return M.pairs(spark, d).select("conv_id", "turn", r6(metrics.bert_scores("prediction", "reference")[2]).alias("bert_f1"))


_TOKENS = M.sql_tokens("lower(coalesce(text, ''))")
_MET = f"""toks AS (SELECT {_TOKENS} AS t FROM conversations),
near AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: {{'a': t[i], 'b': t[i + 1]}})) AS x FROM toks UNION ALL SELECT unnest(list_transform(range(1, len(t) - 1), lambda i: {{'a': t[i], 'b': t[i + 2]}})) FROM toks),
met AS (SELECT term, other, count(*) AS n FROM (SELECT x.a AS term, x.b AS other FROM near UNION ALL SELECT x.b, x.a FROM near) GROUP BY ALL)"""
_MODEL = f"""{_MET},
total AS (SELECT term, sum(n) AS t FROM met GROUP BY term),
ppmi AS (SELECT met.term, other, md5(other) AS h, ln(n::DOUBLE * (SELECT sum(t) FROM total) / (a.t::DOUBLE * b.t)) AS w FROM met JOIN total a ON a.term = met.term JOIN total b ON b.term = other),
entry AS (SELECT term, ('0x' || substr(h, 2 * m + 1, 2))::INT % 64 AS d, w * (CASE WHEN substr(h, 9 + m, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0 END) AS v FROM ppmi, range(4) r(m) WHERE w > 0),
comp AS (SELECT term, d, sum(v) AS v FROM entry GROUP BY ALL),
long AS (SELECT term, sqrt(sum(v * v)) AS l FROM comp GROUP BY term),
model AS (SELECT term, list_transform(range(64), lambda d: coalesce(m[d::INT], 0.0::DOUBLE) / l) AS vec FROM (SELECT term, map_from_entries(list((d, v))) AS m FROM comp GROUP BY term) JOIN long USING (term) WHERE l > 1e-9)"""
_BERT_VEC = f"""{_MODEL},
pt AS (SELECT conv_id, turn, term, count(*) AS n FROM (SELECT conv_id, turn, unnest({M.sql_tokens('lower(prediction)')}) AS term FROM pairs) GROUP BY ALL),
rt AS (SELECT conv_id, turn, term, count(*) AS n FROM (SELECT conv_id, turn, unnest({M.sql_tokens('lower(reference)')}) AS term FROM pairs) GROUP BY ALL),
sim AS (SELECT p.conv_id, p.turn, p.term AS a, r.term AS b, p.n AS pn, r.n AS rn, CASE WHEN p.term = r.term THEN 1.0 ELSE coalesce(list_dot_product(mp.vec, mr.vec), 0.0) END AS c FROM pt p JOIN rt r USING (conv_id, turn) LEFT JOIN model mp ON mp.term = p.term LEFT JOIN model mr ON mr.term = r.term),
pb AS (SELECT conv_id, turn, sum(n * c) / sum(n) AS p FROM (SELECT conv_id, turn, a, any_value(pn) AS n, CASE WHEN count(*) FILTER (a = b) > 0 THEN 1.0 ELSE max(c) END AS c FROM sim GROUP BY ALL) GROUP BY ALL),
rb AS (SELECT conv_id, turn, sum(n * c) / sum(n) AS r FROM (SELECT conv_id, turn, b, any_value(rn) AS n, CASE WHEN count(*) FILTER (a = b) > 0 THEN 1.0 ELSE max(c) END AS c FROM sim GROUP BY ALL) GROUP BY ALL),
bs AS (SELECT pairs.conv_id, pairs.turn, round(coalesce(p, 0.0), 6) AS bert_precision, round(coalesce(r, 0.0), 6) AS bert_recall, round(coalesce(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 0.0), 6) AS bert_f1 FROM pairs LEFT JOIN pb USING (conv_id, turn) LEFT JOIN rb USING (conv_id, turn))"""


def token_model(spark: SparkSession, d: str) -> DataFrame:
    """Token vectors of all turns, written once a session."""
    return M.stored(spark, d, "token-model", lambda: embedder.fit(M.table(spark, d, "conversations"), "text"))


@query("token_cooccurrence", f"WITH {_MET} SELECT term, other, n FROM met")
def token_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return embedder.cooccurrences(M.table(spark, d, "conversations"), "text")


@query("token_vectors", f"WITH {_MODEL} SELECT term, round(vec[1], 6) AS v0, round(vec[22], 6) AS v21, round(vec[64], 6) AS v63 FROM model")
def token_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec")
    return token_model(spark, d).select("term", *[r6(v[i]).alias(f"v{i}") for i in (0, 21, 63)])


@query("bert_score", f"WITH {M.PAIRS}, {_BERT_VEC} SELECT conv_id, turn, bert_precision, bert_recall, bert_f1 FROM bs")
def bert_score(spark: SparkSession, d: str) -> DataFrame:
    """By the trained token vectors; bert_score_tokens takes equal tokens alone."""
    got = embedder.bert_scores(M.pairs(spark, d), ["conv_id", "turn"], token_model(spark, d))
    return got.select("conv_id", "turn", *[r6(F.col(c)).alias(c) for c in ("bert_precision", "bert_recall", "bert_f1")])


def _sql_encoded(side: str) -> str:
    return f"(SELECT conv_id, turn, list(s ORDER BY i) AS vec FROM (SELECT conv_id, turn, i, sum(v) AS s FROM (SELECT conv_id, turn, unnest(range(64)) AS i, unnest(vec) AS v FROM (SELECT conv_id, turn, unnest({M.sql_tokens(f'lower({side})')}) AS term FROM pairs) JOIN model USING (term)) GROUP BY ALL) GROUP BY ALL)"


@query("trained_similarity", f"WITH {M.PAIRS}, {_MODEL}, a AS {_sql_encoded('prediction')}, b AS {_sql_encoded('reference')} SELECT conv_id, turn, round(coalesce({M.sql_cosine('a.vec', 'b.vec')}, 0.0), 6) AS similarity FROM pairs LEFT JOIN a USING (conv_id, turn) LEFT JOIN b USING (conv_id, turn)")
def trained_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of two texts as sums of trained token vectors."""
    pairs, key, model = M.pairs(spark, d), ["conv_id", "turn"], token_model(spark, d)
    return embedder.encode_all(pairs, key, ["prediction", "reference"], model).select(*key, r6(cosine("prediction", "reference")).alias("similarity"))


_RECORD = f"""rec AS (SELECT conv_id, turn, category, (lower({M.sql_strip('prediction')}) = lower({M.sql_strip('reference')}))::DOUBLE AS exact_match, {_F1_VALUE} AS f1 FROM ({_F1}))"""


@query("metric_record", f"WITH RECURSIVE {M.PAIRS}, {_GRAMS}, {_RECORD}, {_LCS}, rg AS (SELECT conv_id, turn, max({_sql_f1('b', 'p', 'r')}) FILTER (n = 1) AS r1, max({_sql_f1('b', 'p', 'r')}) FILTER (n = 2) AS r2 FROM ov GROUP BY ALL), bl AS (SELECT conv_id, turn, {_BLEU} FROM ({_WIDE})), rl AS (SELECT conv_id, turn, round({_sql_f1('l', 'p', 'r')}, 6) AS rougeL_f FROM lcs), bs AS (SELECT conv_id, turn, round({_BERT}, 6) AS bert_f1 FROM lt), sv AS (SELECT conv_id, turn, {M.sql_vec('prediction')} AS a, {M.sql_vec('reference')} AS b FROM pairs), ss AS (SELECT conv_id, turn, round({M.sql_cosine('a', 'b')}, 6) AS sbert_similarity FROM sv) SELECT conv_id, turn, exact_match, round(f1, 6) AS f1, round(rg.r1, 6) AS rouge1_f, round(rg.r2, 6) AS rouge2_f, rougeL_f, bleu1, bleu2, bleu3, bleu4, bert_f1, sbert_similarity FROM rec JOIN rg USING (conv_id, turn) JOIN bl USING (conv_id, turn) JOIN rl USING (conv_id, turn) JOIN bs USING (conv_id, turn) JOIN ss USING (conv_id, turn)")
def metric_record(spark: SparkSession, d: str) -> DataFrame:
    """The record without stems and METEOR, which `rouge_n_stemmed`, `rouge_l_stemmed` and `meteor` give."""
    out = metrics.metric_record(M.pairs(spark, d), ["conv_id", "turn"], stem=False).drop("meteor")
    return out.select("conv_id", "turn", *[r6(c).alias(c) for c in out.columns[2:]])


@query("metric_summary", f"""WITH {M.PAIRS}, {_RECORD}, v AS (SELECT category, 'exact_match' AS metric, exact_match AS value FROM rec UNION ALL SELECT category, 'f1', f1 FROM rec)
SELECT CASE WHEN grouping(category) = 1 THEN 'overall' ELSE category::VARCHAR END AS scope, metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(median(value), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max, count(value) AS n FROM v GROUP BY GROUPING SETS ((metric), (metric, category))""")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    p = M.pairs(spark, d).select("category", metrics.exact_match("prediction", "reference").alias("exact_match"), metrics.token_f1("prediction", "reference").alias("f1"))
    out = stats.aggregate_metrics(stats.long_form(p, ["category"], ["exact_match", "f1"]))
    return out.select("scope", "metric", *[r6(c).alias(c) for c in ("mean", "std", "median", "min", "max")], "n")


@query("category_share", f"WITH {M.PAIRS} SELECT category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM pairs GROUP BY category ORDER BY category")
def category_share(spark: SparkSession, d: str) -> DataFrame:
    return stats.share(M.pairs(spark, d), "category").withColumn("percent", r6("percent")).orderBy("category")


# -- replies ---------------------------------------------------------------------------------------------------------

_REPLIES = """r AS (SELECT conv_id, turn, CASE turn % 7 WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || j || chr(10) || '```' WHEN 1 THEN '``` ' || j || ' ``` bye' WHEN 2 THEN 'I say ' || j || ' so' WHEN 3 THEN j WHEN 4 THEN ' Short answer: "' || role || '" ' WHEN 5 THEN '{"prediction": "Answer: ' || role || '", "x": 1}' ELSE '' END AS reply, j, role
FROM (SELECT *, '{"answer": "' || role || '", "n": ' || turn || ', "ok": True}' AS j0, '{"answer": "' || role || '", "n": ' || turn || '}' AS j FROM conversations))"""


def replies(spark: SparkSession, d: str) -> DataFrame:
    c = M.table(spark, d, "conversations")
    j = F.concat(F.lit('{"answer": "'), "role", F.lit('", "n": '), F.col("turn").cast("string"), F.lit("}"))
    kinds = [F.concat(F.lit("Sure:\n```json\n"), j, F.lit("\n```")), F.concat(F.lit("``` "), j, F.lit(" ``` bye")), F.concat(F.lit("I say "), j, F.lit(" so")), j, F.concat(F.lit(' Short answer: "'), "role", F.lit('" ')), F.concat(F.lit('{"prediction": "Answer: '), "role", F.lit('", "x": 1}')), F.lit("")]
    reply = kinds[6]
    for i in range(6):
        reply = F.when(F.col("turn") % 7 == i, kinds[i]).otherwise(reply)
    return c.select("conv_id", "turn", "role", reply.alias("reply"))


_JT = r"coalesce(nullif(regexp_extract(reply, '(?s)```json\s*(\{.*\})\s*```', 1), ''), nullif(regexp_extract(reply, '(?s)```\s*(\{.*\})\s*```', 1), ''), nullif(regexp_extract(reply, '(?s)\{.*\}'), ''), reply)"


@query("json_text", f"WITH {_REPLIES} SELECT conv_id, turn, {_JT} AS body FROM r")
def json_text(spark: SparkSession, d: str) -> DataFrame:
    return replies(spark, d).select("conv_id", "turn", T.json_text("reply").alias("body"))


@query("json_object", f"WITH {_REPLIES} SELECT conv_id, turn, CASE WHEN try_cast({_JT} AS JSON) IS NOT NULL AND {_JT} <> '' THEN {_JT} ELSE '{{}}' END AS body FROM r")
def json_object(spark: SparkSession, d: str) -> DataFrame:
    return replies(spark, d).select("conv_id", "turn", T.json_object("reply").alias("body"))


@query("literal_repair", "SELECT conv_id, turn, '{\"a\": true, \"b\": false, \"c\": null, \"t\": ' || turn || '}' AS fixed FROM conversations")
def literal_repair(spark: SparkSession, d: str) -> DataFrame:
    c = M.table(spark, d, "conversations")
    raw = F.concat(F.lit('{"a": True, "b": False, "c": None, "t": '), F.col("turn").cast("string"), F.lit("}"))
    return c.select("conv_id", "turn", T.literal_repair(raw).alias("fixed"))


@query("answers", f"""WITH {_REPLIES} SELECT conv_id, turn, CASE turn % 7 WHEN 2 THEN reply WHEN 6 THEN '' ELSE role END AS answer FROM r""")
def answers(spark: SparkSession, d: str) -> DataFrame:
    picked = T.answer_clean(T.answer_pick("reply"))
    return replies(spark, d).select("conv_id", "turn", picked.alias("answer"))


@query("unwrap_answers", f"""WITH {_REPLIES} SELECT conv_id, turn, CASE turn % 7 WHEN 3 THEN role ELSE reply END AS answer FROM r""")
def unwrap_answers(spark: SparkSession, d: str) -> DataFrame:
    return replies(spark, d).select("conv_id", "turn", T.unwrap_answer("reply").alias("answer"))


_AUX = "|".join(T.AUXILIARIES)


@query("question_classes", f"""WITH qs AS (SELECT conv_id, turn, {_CAT} AS category, lower(CASE turn % 4 WHEN 0 THEN 'Is it ' WHEN 1 THEN 'How many ' WHEN 2 THEN 'This or that ' ELSE '' END || text || '?') AS q FROM conversations) SELECT conv_id, turn, category, CASE WHEN category = 3 AND contains(q, ' or ') AND contains(q, '?') THEN 'choice' WHEN category IN (1, 3) AND regexp_matches(q, '^({_AUX})') THEN 'yes_no' WHEN category = 1 AND regexp_matches(q, '^how (many|much)') THEN 'count' ELSE 'open' END AS kind FROM qs""")
def question_classes(spark: SparkSession, d: str) -> DataFrame:
    head = F.when(F.col("turn") % 4 == 0, "Is it ").when(F.col("turn") % 4 == 1, "How many ").when(F.col("turn") % 4 == 2, "This or that ").otherwise("")
    c = M.table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") % 5 + 1).cast("int").alias("category"), F.concat(head, F.col("text"), F.lit("?")).alias("q"))
    return c.select("conv_id", "turn", "category", T.question_class("q", "category").alias("kind"))


@query("labels_and_slugs", "SELECT DISTINCT role, upper(role[1]) || lower(role[2:]) || ' Info' AS label, 'org_' || role || '_v1' AS slug FROM conversations")
def labels_and_slugs(spark: SparkSession, d: str) -> DataFrame:
    c = M.table(spark, d, "conversations").select("role").distinct()
    return c.select("role", T.dimension_label(F.concat("role", F.lit("_info"))).alias("label"), T.model_slug(F.concat(F.lit("org/"), "role", F.lit(":v1"))).alias("slug"))


# -- graph maintenance -----------------------------------------------------------------------------------------------


@query("node_upsert", f"WITH {M.FACTS} SELECT sample_id, node_id, CASE WHEN node_seq % 2 = 0 THEN content || ' (new)' ELSE content END AS content FROM facts")
def node_upsert(spark: SparkSession, d: str) -> DataFrame:
    f = M.facts(spark, d).select("sample_id", "node_id", "node_seq", "content", "version")
    new = f.where("node_seq % 2 = 0").withColumn("content", F.concat("content", F.lit(" (new)"))).withColumn("version", F.lit(1).cast("long"))
    return graph.latest(f.unionByName(new), ["sample_id", "node_id"]).select("sample_id", "node_id", "content")


@query("edge_upsert", f"WITH {M.GRAPH} SELECT sample_id, src, dst, CASE WHEN type = 'contains' THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM edges")
def edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = M.graph(spark, d)[1].select("sample_id", "src", "dst", "type")
    first = e.select("sample_id", "src", "dst", F.lit(1.0).alias("weight"), F.lit(0).alias("version"))
    again = e.where("type = 'persona_related'").select("sample_id", "src", "dst", F.lit(2.0).alias("weight"), F.lit(1).alias("version"))
    return graph.latest(first.unionByName(again), ["sample_id", "src", "dst"]).drop("version")


@query("suggested_edges", f"WITH {M.FACTS}, s AS (SELECT sample_id, node_id AS a, sha256(sample_id || '|fact|0') AS b FROM facts WHERE node_seq > 0) SELECT sample_id, a AS src, b AS dst FROM s UNION SELECT sample_id, b, a FROM s")
def suggested_edges(spark: SparkSession, d: str) -> DataFrame:
    f = M.facts(spark, d)
    zero = F.sha2(F.concat("sample_id", F.lit("|fact|0")), 256)
    # by place, by id, out of range, unknown, and itself
    asked = f.select("sample_id", "node_id", F.array(F.when(F.col("node_seq") % 2 == 0, F.lit("0")).otherwise(zero), F.lit("99"), F.lit("no such id"), F.col("node_id")).alias("suggested"))
    return graph.suggested_edges(asked, f.select("sample_id", "node_id", "node_seq"), K)


@query("neighbour_updates", "SELECT conv_id, turn, pos::INT AS pos, 'n' || pos AS node_id, 'c' || pos AS context FROM conversations, (SELECT unnest(range(3)) AS pos) WHERE pos < least(3, turn % 4, 2)")
def neighbour_updates(spark: SparkSession, d: str) -> DataFrame:
    c = M.table(spark, d, "conversations")
    some = F.slice(F.array(*[F.lit(f"c{i}") for i in range(4)]), F.lit(1), (F.col("turn") % 4).cast("int"))
    rows = c.select("conv_id", "turn", F.array(*[F.lit(f"n{i}") for i in range(3)]).alias("neighbours"), some.alias("contexts"), F.array(F.array(F.lit("t0")), F.array(F.lit("t1"))).alias("tags"))
    return graph.neighbour_updates(rows).select("conv_id", "turn", "pos", "node_id", "context")


@query("scene_append", r"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || chr(10) || '[Insight]: more about ' || role ELSE text END AS content FROM conversations")
def scene_append(spark: SparkSession, d: str) -> DataFrame:
    c = M.table(spark, d, "conversations")
    add = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("\n more about "), "role", F.lit(" \n"))).when(F.col("turn") % 3 == 1, "  few \n").otherwise("")
    return c.select("conv_id", "turn", hierarchy.refined_content(F.col("text"), add).alias("content"))


@query("scene_refinement", f"WITH {M.GRAPH} SELECT sample_id, node_id, CASE WHEN node_seq % 2 = 0 THEN content || chr(10) || '[Insight]: of ' || sample_id || ' more' ELSE content END AS content, true AS refined FROM scenes WHERE node_seq <> 101")
def scene_refinement(spark: SparkSession, d: str) -> DataFrame:
    s = M.graph(spark, d)[0].where("level = 'scene'").withColumn("refined", F.when(F.col("node_seq") == 101, True))
    add = s.where("node_seq % 2 = 0").select("sample_id", "node_id", F.concat(F.lit("of "), "sample_id", F.lit(" more")).alias("addition"))
    return hierarchy.refine(s, add, K)


@query("unrefined_scenes", f"WITH {M.GRAPH} SELECT sample_id, node_id FROM scenes WHERE node_seq <> 100")
def unrefined_scenes(spark: SparkSession, d: str) -> DataFrame:
    s = M.graph(spark, d)[0].where("level = 'scene'").withColumn("refined", F.when(F.col("node_seq") == 100, True))
    return s.where(~F.coalesce("refined", F.lit(False))).select("sample_id", "node_id")


@query("clean_levels", f"WITH {M.GRAPH}, keep AS (SELECT sample_id, node_id FROM nodes WHERE level = 'fact') SELECT 'node' AS kind, sample_id, node_id AS a, '' AS b FROM keep UNION ALL SELECT 'edge', e.sample_id, e.src, e.dst FROM edges e SEMI JOIN keep x ON x.sample_id = e.sample_id AND x.node_id = e.src SEMI JOIN keep y ON y.sample_id = e.sample_id AND y.node_id = e.dst")
def clean_levels(spark: SparkSession, d: str) -> DataFrame:
    n, e = graph.without_levels(*M.graph(spark, d), K)
    return n.select(F.lit("node").alias("kind"), "sample_id", F.col("node_id").alias("a"), F.lit("").alias("b")).unionByName(e.select(F.lit("edge").alias("kind"), "sample_id", F.col("src").alias("a"), F.col("dst").alias("b")))


@query("induced_subgraph", f"WITH {M.GRAPH} SELECT DISTINCT e.sample_id, least(src, dst) AS a, greatest(src, dst) AS b FROM edges e JOIN nodes x ON x.sample_id = e.sample_id AND x.node_id = e.src AND x.level = 'fact' JOIN nodes y ON y.sample_id = e.sample_id AND y.node_id = e.dst AND y.level = 'fact' WHERE src <> dst")
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    n, e = M.graph(spark, d)
    return graph.undirected(graph.induced(n, e, K, F.col("level") == "fact"), K)


def _sql_lpa(rounds: int) -> str:
    out = [f"WITH {M.GRAPH}, l0 AS (SELECT sample_id, node_id, node_id AS label FROM facts), ln AS (SELECT DISTINCT sample_id, src, dst FROM edges WHERE type = 'persona_related')"]
    for i in range(1, rounds + 1):
        out.append(f"""v{i} AS (SELECT ln.sample_id, ln.src AS node_id, l.label, count(*) AS n FROM ln JOIN l{i - 1} l ON l.sample_id = ln.sample_id AND l.node_id = ln.dst GROUP BY ALL),
b{i} AS (SELECT v.sample_id, v.node_id, v.label, row_number() OVER (PARTITION BY v.sample_id, v.node_id ORDER BY v.n DESC, (v.label = l.label)::INT DESC, v.label) AS r FROM v{i} v JOIN l{i - 1} l USING (sample_id, node_id)),
l{i} AS (SELECT l.sample_id, l.node_id, coalesce(b.label, l.label) AS label FROM l{i - 1} l LEFT JOIN b{i} b ON b.sample_id = l.sample_id AND b.node_id = l.node_id AND b.r = 1)""")
    return ", ".join(out) + f" SELECT sample_id, node_id, label FROM l{rounds}"


@query("label_propagation", _sql_lpa(2))
def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    n, e = M.graph(spark, d)
    return graph.label_propagation(n.where("level = 'fact'"), e.where("type = 'persona_related'"), K, 2)


_LINKS = """pairs_ AS (SELECT DISTINCT sample_id, least(src, dst) AS a, greatest(src, dst) AS b FROM picked WHERE src <> dst),
nb AS (SELECT sample_id, a AS node_id, b AS other FROM pairs_ UNION ALL SELECT sample_id, b, a FROM pairs_),
ord AS (SELECT s.*, row_number() OVER (PARTITION BY sample_id ORDER BY (SELECT count(*) FROM nb WHERE nb.sample_id = s.sample_id AND nb.node_id = s.node_id) DESC, node_seq, node_id) AS p FROM seats s),
before AS MATERIALIZED (SELECT a.sample_id, a.node_id, a.p, coalesce(list(b.p) FILTER (b.p < a.p), []) AS ps FROM ord a LEFT JOIN nb ON nb.sample_id = a.sample_id AND nb.node_id = a.node_id LEFT JOIN ord b ON b.sample_id = nb.sample_id AND b.node_id = nb.other GROUP BY ALL),
walk AS (SELECT DISTINCT sample_id, 0::BIGINT AS p, []::BIGINT[] AS cs FROM seats
  UNION ALL SELECT sample_id, p, list_append(cs, list_min(list_filter(range(0, len(used) + 1), lambda c: NOT list_contains(used, c)))) FROM (SELECT w.sample_id, b.p, w.cs, list_transform(b.ps, lambda x: w.cs[x]) AS used FROM walk w JOIN before b ON b.sample_id = w.sample_id AND b.p = w.p + 1)),
coloured AS MATERIALIZED (SELECT b.sample_id, b.node_id, w.cs[b.p]::INT AS colour FROM before b JOIN walk w USING (sample_id, p))"""
#: a node a step, by colour; the labels of a sample are one list
_SETTLED = """pos AS MATERIALIZED (SELECT s.sample_id, s.node_id, row_number() OVER (PARTITION BY s.sample_id ORDER BY node_seq, node_id) AS k, row_number() OVER (PARTITION BY s.sample_id ORDER BY colour, node_seq, node_id) AS p FROM seats s JOIN coloured USING (sample_id, node_id)),
around AS MATERIALIZED (SELECT a.sample_id, a.p, list(b.p) FILTER (b.p IS NOT NULL) AS ns FROM pos a LEFT JOIN nb ON nb.sample_id = a.sample_id AND nb.node_id = a.node_id LEFT JOIN pos b ON b.sample_id = nb.sample_id AND b.node_id = nb.other GROUP BY ALL),
lpa AS (SELECT sample_id, 0::BIGINT AS t, list(k ORDER BY p) AS ls FROM pos GROUP BY sample_id
  UNION ALL SELECT sample_id, t + 1, ls[:p - 1] || [CASE WHEN list_contains(high, ls[p]) THEN ls[p] ELSE coalesce(list_max(high), ls[p]) END] || ls[p + 1:] FROM (SELECT *, list_filter(vs, lambda x: len(list_filter(vs, lambda y: y = x)) = list_max(list_transform(vs, lambda z: len(list_filter(vs, lambda y: y = z))))) AS high
    FROM (SELECT l.*, a.p, coalesce(list_transform(a.ns, lambda x: l.ls[x]), []) AS vs FROM lpa l JOIN around a ON a.sample_id = l.sample_id AND a.p = l.t % len(l.ls) + 1 WHERE l.t < 10 * len(l.ls)))),
settled AS (SELECT sample_id, ls FROM lpa WHERE t = 10 * len(ls))"""


@query("colour_classes", f"WITH RECURSIVE {M.GRAPH}, seats AS MATERIALIZED (SELECT sample_id, node_id, node_seq FROM nodes), picked AS (SELECT * FROM edges), {_LINKS} SELECT * FROM coloured")
def colour_classes(spark: SparkSession, d: str) -> DataFrame:
    return communities.colour_classes(*M.graph(spark, d), K)


def _sql_settled(nodes: str, edges: str) -> str:
    return f"""WITH RECURSIVE {M.GRAPH}, seats AS MATERIALIZED (SELECT sample_id, node_id, node_seq FROM {nodes}), picked AS (SELECT * FROM edges WHERE {edges}), {_LINKS}, {_SETTLED}
SELECT a.sample_id, a.node_id, b.node_id AS label FROM settled s JOIN pos a USING (sample_id) JOIN pos b ON b.sample_id = a.sample_id AND b.k = s.ls[a.p]"""


@query("fact_communities", _sql_settled("facts", "type = 'persona_related'"))
def fact_communities(spark: SparkSession, d: str) -> DataFrame:
    n, e = M.graph(spark, d)
    return communities.semi_synchronous(n.where("level = 'fact'"), e.where("type = 'persona_related'"), K, 10)


@query("graph_communities", _sql_settled("nodes", "true"))
def graph_communities(spark: SparkSession, d: str) -> DataFrame:
    """Over all levels: hubs and several colours."""
    return communities.semi_synchronous(*M.graph(spark, d), K, 10)


@query("chunk_communities", f"WITH {M.FACTS} SELECT sample_id, node_id, ((row_number() OVER (PARTITION BY sample_id ORDER BY node_seq) - 1) // 3)::BIGINT AS community FROM facts")
def chunk_communities(spark: SparkSession, d: str) -> DataFrame:
    return graph.chunk_communities(M.facts(spark, d), K, 3)


@query("uncovered_communities", f"WITH {M.GRAPH} SELECT sample_id, community::BIGINT AS community, min_by(node_id, node_seq) AS first_member FROM facts WHERE community <> 1 GROUP BY sample_id, community")
def uncovered_communities(spark: SparkSession, d: str) -> DataFrame:
    n, e = M.graph(spark, d)
    some = e.where(~F.col("src").startswith("s_") | F.col("src").endswith("_1"))  # scenes of the second community alone
    return graph.uncovered(M.communities(n.where("level = 'fact'")), n, some, K, "scene")


@query("scene_build", f"WITH {M.GRAPH} SELECT sample_id, node_id, content, \"timestamp\" FROM scenes")
def scene_build(spark: SparkSession, d: str) -> DataFrame:
    f = M.facts(spark, d)
    return hierarchy.build_scenes(f, M.communities(f), K)[0].select("sample_id", "node_id", "content", "timestamp")


@query("persona_build", "WITH p AS (SELECT conv_id::VARCHAR AS sample_id, count(*) AS n, min(role) AS r FROM conversations GROUP BY conv_id HAVING conv_id % 3 <> 0) SELECT sample_id, 'p_' || sample_id || '_' || dim AS node_id, seq::BIGINT AS node_seq, 'persona' AS level, content, tag FROM (SELECT sample_id, 'basic_info' AS dim, 0 AS seq, n || ' turns' AS content, 'Basic Info' AS tag FROM p UNION ALL SELECT sample_id, 'interests', 1, r, 'Interests' FROM p UNION ALL SELECT sample_id, 'values', 3, 'x', 'Values' FROM p WHERE n > 4)")
def persona_build(spark: SparkSession, d: str) -> DataFrame:
    c = M.turns(spark, d).groupBy("sample_id").agg(F.count("*").alias("n"), F.min("speaker").alias("r"))
    p = c.select("sample_id", F.concat(F.col("n").cast("string"), F.lit(" turns")).alias("basic_info"), F.col("r").alias("interests"), F.lit("N/A").alias("personality"), F.when(F.col("n") > 4, "x").otherwise("").alias("values"), F.lit(None).cast("string").alias("relationships"))
    have = c.where(F.col("sample_id").cast("long") % 3 == 0).select("sample_id", F.lit("persona").alias("level"))
    return hierarchy.build_personas(p, K, have)


@query("profile_text", f"WITH {M.GRAPH} SELECT sample_id, string_agg('[' || tags[1] || ']: ' || content, chr(10) ORDER BY node_seq) AS profile FROM personas GROUP BY sample_id")
def profile_text(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.profile_text(M.graph(spark, d)[0], K, F.col("tags")[0], "persona")


@query("graph_stats", f"WITH {M.GRAPH} SELECT sample_id, count(*) FILTER (level = 'fact') AS facts, count(*) FILTER (level = 'scene') AS scenes, count(*) FILTER (level = 'persona') AS personas, 0::BIGINT AS others, count(*) AS total_nodes, any_value(e.n) AS total_edges FROM nodes JOIN (SELECT sample_id, count(*) AS n FROM edges GROUP BY sample_id) e USING (sample_id) GROUP BY sample_id")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.level_counts(*M.graph(spark, d), K)


@query("facts_by_time", f"WITH {M.FACTS} SELECT sample_id, node_id, row_number() OVER (PARTITION BY sample_id ORDER BY coalesce(\"timestamp\", ''), node_seq) AS place FROM facts")
def facts_by_time(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("sample_id").orderBy(F.coalesce("timestamp", F.lit("")), "node_seq")
    return M.facts(spark, d).select("sample_id", "node_id", F.row_number().over(w).cast("long").alias("place"))


@query("display_limit", f"WITH {M.FACTS} SELECT sample_id, node_id, n FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY \"timestamp\", node_seq) AS i, count(*) OVER (PARTITION BY sample_id) - 5 AS n FROM facts) WHERE i <= 5")
def display_limit(spark: SparkSession, d: str) -> DataFrame:
    """The first five facts of each sample's report, and how many more there are."""
    w = Window.partitionBy("sample_id")
    f = M.facts(spark, d).select("sample_id", "node_id", (F.count("*").over(w) - 5).alias("n"), F.row_number().over(w.orderBy("timestamp", "node_seq")).alias("i"))
    return f.where("i <= 5").drop("i")


@query("previews", "SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS preview FROM conversations")
def previews(spark: SparkSession, d: str) -> DataFrame:
    return M.table(spark, d, "conversations").select("conv_id", "turn", T.preview("text").alias("preview"))


@query("context_union", f"WITH {M.GRAPH} SELECT sample_id, src AS node_id FROM edges WHERE type = 'contains' UNION SELECT sample_id, dst FROM edges WHERE type = 'contains'")
def context_union(spark: SparkSession, d: str) -> DataFrame:
    e = M.graph(spark, d)[1].where("type = 'contains'")
    return e.select("sample_id", F.col("src").alias("node_id")).union(e.select("sample_id", "dst")).distinct()


@query("set_difference", f"WITH {M.GRAPH} SELECT sample_id, node_id FROM nodes EXCEPT SELECT sample_id, src FROM edges")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    n, e = M.graph(spark, d)
    return n.select("sample_id", "node_id").join(e.select("sample_id", F.col("src").alias("node_id")), ["sample_id", "node_id"], "left_anti").distinct()


@query("event_windows", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    from sparkloom.streaming.ingest import event_counts

    return event_counts(M.table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))

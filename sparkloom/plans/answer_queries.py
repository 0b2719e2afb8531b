"""Queries of answer metrics by stems: distinct words, ROUGE and METEOR."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import metrics, stems

from . import model as M
from .data_queries import _GRAMS, _LCS, _sql_f1, r6
from .registry import query


def _cut(x: str, n: int | str) -> str:
    return f"left({x}, greatest(length({x}) - {n}, 0)::BIGINT)"


def _like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _rules(rules: dict[str, str], measure: str, source: str, name: str) -> str:
    """CTEs that replace the longest suffix of the rules in `source`.a where the measure of the rest allows it."""
    new = "CASE s " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.items()) + " END"
    ok = f"CASE WHEN s = 'logi' THEN {_like(_cut('a', 3), measure)} WHEN s = 'ion' THEN {_like('x', measure)} AND {_like('x', '[st]$')} ELSE {_like('x', measure)} END"
    return f"""{name}_s AS (SELECT w, a, s, {_cut('a', 'length(s)')} AS x FROM (SELECT w, a, regexp_extract(a, '({'|'.join(rules)})$', 1) AS s FROM {source})),
{name} AS (SELECT w, CASE WHEN s <> '' AND {ok} THEN x || {new} ELSE a END AS a FROM {name}_s)"""


def sql_stems(words: str) -> str:
    """CTEs up to st(w, stem) over the distinct lower-cased words that `words` selects as w."""
    v, m0, m1 = stems.VOWEL, stems.OVER_0, stems.OVER_1
    one_long = f"{_like('x', stems.IS_1)} AND NOT {_like('x', stems.SHORT)}"
    own = "CASE w " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, s in stems.IRREGULAR.items()) + " END"
    return f"""wd AS ({words}),
p0 AS (SELECT w, replace(regexp_replace(w, '(^|[aeiou])y', '\\1Y', 'g'), 'yy', 'yY') AS a FROM wd),
p1 AS (SELECT w, CASE WHEN {_like('a', '^.ies$')} THEN {_cut('a', 1)} WHEN a LIKE '%sses' OR a LIKE '%ies' THEN {_cut('a', 2)} WHEN a LIKE '%ss' THEN a WHEN a LIKE '%s' THEN {_cut('a', 1)} ELSE a END AS a FROM p0),
p2 AS (SELECT w, a, CASE WHEN a LIKE '%ied' OR a LIKE '%eed' THEN NULL WHEN a LIKE '%ed' AND {_like(_cut('a', 2), v)} THEN {_cut('a', 2)} WHEN a LIKE '%ing' AND {_like(_cut('a', 3), v)} THEN {_cut('a', 3)} END AS x FROM p1),
p3 AS (SELECT w, CASE WHEN a LIKE '%ied' THEN CASE WHEN length(a) = 4 THEN {_cut('a', 1)} ELSE {_cut('a', 2)} END WHEN a LIKE '%eed' THEN CASE WHEN {_like(_cut('a', 3), m0)} THEN {_cut('a', 1)} ELSE a END
  WHEN x IS NULL THEN a WHEN x LIKE '%at' OR x LIKE '%bl' OR x LIKE '%iz' THEN x || 'e'
  WHEN length(x) > 1 AND lower(right(x, 1)) = lower(left(right(x, 2), 1)) AND NOT {_like('x', v + '$')} THEN CASE WHEN right(x, 1) IN ('l', 's', 'z') THEN x ELSE {_cut('x', 1)} END
  WHEN {_like('x', stems.IS_1)} AND {_like('x', stems.SHORT)} THEN x || 'e' ELSE x END AS a FROM p2),
p4 AS (SELECT w, CASE WHEN length(a) > 2 AND a LIKE '%y' THEN {_cut('a', 1)} || 'i' ELSE a END AS a FROM p3),
p5 AS (SELECT w, CASE WHEN a LIKE '%alli' AND {_like(_cut('a', 4), m0)} THEN {_cut('a', 2)} ELSE a END AS a FROM p4),
{_rules(stems.STEP2, m0, 'p5', 'p6')},
{_rules(stems.STEP3, m0, 'p6', 'p7')},
{_rules(dict.fromkeys(stems.STEP4, ''), m1, 'p7', 'p8')},
p9 AS (SELECT w, CASE WHEN a LIKE '%e' AND ({_like('x', m1)} OR ({one_long})) THEN x ELSE a END AS a FROM (SELECT w, a, {_cut('a', 1)} AS x FROM p8)),
st AS (SELECT w, coalesce({own}, lower(CASE WHEN a LIKE '%ll' AND {_like(_cut('a', 1), m1)} THEN {_cut('a', 1)} ELSE a END)) AS stem FROM p9)"""


_RUNS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
_SIDES = f"sides AS (SELECT conv_id, turn, 'p' AS side, {_RUNS.format('prediction')} AS w FROM pairs UNION ALL SELECT conv_id, turn, 'r', {_RUNS.format('reference')} FROM pairs)"
_PLACED = "placed AS (SELECT conv_id, turn, side, i, w[i] AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM sides))"
_STEMMED = f"""{_SIDES}, {_PLACED}, {sql_stems('SELECT DISTINCT word AS w FROM placed WHERE length(word) > 3')},
tk AS (SELECT s.conv_id, s.turn, s.side, coalesce(list(coalesce(stem, word) ORDER BY i) FILTER (word IS NOT NULL), []) AS w FROM sides s LEFT JOIN placed p USING (conv_id, turn, side) LEFT JOIN st ON st.w = word GROUP BY ALL)"""
_GRAMS_OF = _GRAMS.split("\n", 1)[1]
_LCS_OF = "lt AS (SELECT x.conv_id, x.turn, x.w AS a, y.w AS b FROM tk x JOIN tk y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.side = 'p' AND y.side = 'r'),\n" + _LCS.split("\n", 1)[1]


_WORDS = "SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations)"


@query("word_stems", f"WITH {sql_stems(_WORDS)} SELECT w AS word, CASE WHEN length(w) > 2 THEN stem ELSE w END AS stem FROM st")
def word_stems(spark: SparkSession, d: str) -> DataFrame:
    words = M.table(spark, d, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1)).alias("word")).distinct()
    return words.select("word", stems.stems(F.array("word"))[0].alias("stem"))


@query("rouge_n_stemmed", f"WITH {M.PAIRS}, {_STEMMED}, {_GRAMS_OF} SELECT conv_id, turn, n::INT AS n, round({_sql_f1('b', 'p', 'r')}, 6) AS f FROM ov WHERE n <= 2")
def rouge_n_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rouge_n(M.pairs(spark, d), ["conv_id", "turn"], stem=True).withColumn("f", r6("f"))


@query("rouge_l_stemmed", f"WITH RECURSIVE {M.PAIRS}, {_STEMMED}, {_LCS_OF} SELECT conv_id, turn, round({_sql_f1('l', 'p', 'r')}, 6) AS f FROM lcs")
def rouge_l_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return M.pairs(spark, d).select("conv_id", "turn", r6(metrics.rouge_l("prediction", "reference", stem=True)).alias("f"))


def _spaced(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '{metrics.SPACE}'), lambda x: x <> '')"


_METEOR = f"""sides AS (SELECT conv_id, turn, 'p' AS side, {_spaced('prediction')} AS w FROM pairs UNION ALL SELECT conv_id, turn, 'r', {_spaced('reference')} FROM pairs), {_PLACED},
{sql_stems('SELECT DISTINCT word AS w FROM placed')},
e AS (SELECT p.*, CASE WHEN length(word) > 2 THEN stem ELSE word END AS stem, row_number() OVER (PARTITION BY conv_id, turn, side, word ORDER BY i DESC) AS k FROM placed p JOIN st ON st.w = word),
m1 AS (SELECT a.conv_id, a.turn, a.i, b.i AS j FROM e a JOIN e b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.word = b.word AND a.k = b.k AND a.side = 'p' AND b.side = 'r'),
rest AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, side, stem ORDER BY i DESC) AS q FROM e WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.conv_id = e.conv_id AND m1.turn = e.turn AND e.i = CASE WHEN e.side = 'p' THEN m1.i ELSE m1.j END)),
m AS (SELECT * FROM m1 UNION ALL SELECT a.conv_id, a.turn, a.i, b.i FROM rest a JOIN rest b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.stem = b.stem AND a.q = b.q AND a.side = 'p' AND b.side = 'r'),
g AS (SELECT conv_id, turn, CASE WHEN lag(i) OVER o = i - 1 AND lag(j) OVER o = j - 1 THEN 0 ELSE 1 END AS c FROM m WINDOW o AS (PARTITION BY conv_id, turn ORDER BY i)),
h AS (SELECT conv_id, turn, count(*)::DOUBLE AS n, sum(c)::DOUBLE AS c FROM g GROUP BY ALL),
z AS (SELECT conv_id, turn, n / max(len(w)) FILTER (side = 'p') AS p, n / max(len(w)) FILTER (side = 'r') AS r, n, c FROM h JOIN sides USING (conv_id, turn) GROUP BY conv_id, turn, n, c)"""


@query("meteor", f"WITH {M.PAIRS}, {_METEOR} SELECT pairs.conv_id, pairs.turn, round(coalesce(p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * (c / n) ** 3), 0.0), 6) AS meteor FROM pairs LEFT JOIN z USING (conv_id, turn)")
def meteor(spark: SparkSession, d: str) -> DataFrame:
    return M.pairs(spark, d).select("conv_id", "turn", r6(metrics.meteor("prediction", "reference")).alias("meteor"))

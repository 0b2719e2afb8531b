"""DuckDB SQL for the queries whose contract SQL can express: all pairs, all strings."""

NEARDUP = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
one AS (SELECT doc_id, unnest(sh) AS x FROM s),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM met JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM reach r JOIN edge e ON e.a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(c) AS component_id, min(c) = n.doc_id AS kept FROM n JOIN reach r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
SUFFIX = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
p AS (SELECT doc_id, unnest(range(0, octet_length(x) - 99)) AS s, unnest(list_transform(range(0, octet_length(x) - 99), lambda i: md5(x[i + 1:i + 100]))) AS k FROM d WHERE octet_length(x) >= 100),
f AS (SELECT k, min((doc_id, s)) AS f FROM p GROUP BY k HAVING count(*) > 1),
late AS (SELECT doc_id, s FROM p JOIN f ON p.k = f.k WHERE (doc_id, s) <> f.f),
run AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 1 ELSE 0 END AS fresh FROM late)),
span AS (SELECT doc_id, min(s) AS s, max(s) + 100 AS e FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM span),
left_ AS (SELECT g.doc_id, sum(e - s) AS removed, count(*) AS spans, max(e) AS last, string_agg(hex(d.x[before + 1:s]), '' ORDER BY s) AS h FROM gap g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, CAST(octet_length(x) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  CASE WHEN removed IS NULL THEN sha256(x) ELSE sha256(unhex(h || hex(x[last + 1:octet_length(x)]))) END AS kept_sha256
FROM d LEFT JOIN left_ l ON l.doc_id = d.doc_id
"""

RUNS = r"""
WITH bits AS (SELECT doc_id, list_reduce([4294967295::UBIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [256::UBIGINT + ascii(c), 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT])),
  lambda s, x: CASE WHEN xor(s, CASE WHEN x >= 256 THEN x - 256 ELSE 0 END) % 2 = 1 THEN xor(xor(s, CASE WHEN x >= 256 THEN x - 256 ELSE 0 END) // 2, 3988292384::UBIGINT) ELSE xor(s, CASE WHEN x >= 256 THEN x - 256 ELSE 0 END) // 2 END) AS c FROM documents),
d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws, xor(c, 4294967295::UBIGINT)::BIGINT AS h FROM documents JOIN bits USING (doc_id)),
e AS (SELECT *, len(ws) AS n, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE ws END AS w FROM e),
u AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS w FROM t),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isle AS (SELECT doc_id, q, min(i) AS s, max(i) + q + 1 - min(i) AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pair) GROUP BY doc_id, q, g HAVING max(i) + q + 1 - min(i) >= greatest(6, 4 * q)),
run AS (SELECT * FROM isle r WHERE NOT EXISTS (FROM isle o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.s + o.len >= r.s + r.len)),
top AS (SELECT doc_id, count(*) AS n_runs, arg_max({'s': s, 'len': len, 'q': q}, (len, -s, -q)) AS b, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS told FROM run GROUP BY doc_id),
kept AS (SELECT u.doc_id, string_agg(w, ' ' ORDER BY i) AS x FROM u WHERE NOT EXISTS (FROM run r WHERE r.doc_id = u.doc_id AND u.i >= r.s + r.q AND u.i < r.s + r.len) GROUP BY u.doc_id)
SELECT t.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.len AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period, CAST(1000 * b.len // b.q AS BIGINT) AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(x, '')) AS collapsed_sha256
FROM t LEFT JOIN top ON top.doc_id = t.doc_id LEFT JOIN kept ON kept.doc_id = t.doc_id
"""
PHRASES = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents),
w AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) v(m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
total AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND a >= 30),
cut AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, 2000000 * c.a::HUGEINT // (l.a + r.a) AS score FROM c, (VALUES (1), (2), (3)) v(k) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k + 1:], ' ') WHERE k < c.m),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (FROM c WHERE c.lang = b.lang AND c.m > len(string_split(b.phrase, ' ')) AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.a >= 80 * b.a))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL = {"op4_neardup": NEARDUP, "op9_suffix": SUFFIX, "op11_runs": RUNS, "op13_phrases": PHRASES}

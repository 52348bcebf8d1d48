"""SQL for the queries of problems.py: plain statements of the results, by other means than the operators use."""

from __future__ import annotations

#: The lines of csv_lines, each with the reason for which it fails (null: none).
_LINES = r"""WITH h0 AS (SELECT file_name, min(regexp_replace(regexp_replace(line, '^\x{FEFF}', ''), '\r$', '')) AS h FROM csv_lines WHERE line_no = 1 AND line IS NOT NULL GROUP BY file_name),
h1 AS (SELECT *, CASE WHEN length(h) - length(replace(h, ';', '')) > length(h) - length(replace(h, ',', '')) THEN ';' ELSE ',' END AS sep FROM h0),
h2 AS (SELECT *, list_transform(regexp_extract_all(h || sep, '("(?:[^"]|"")*"|[^"' || sep || ']*)' || sep, 1), lambda x: lower(trim(trim(x, ' 	'), '"'))) AS names FROM h1),
h AS (SELECT file_name, sep, names, CASE WHEN list_position(names, 'date') > 0 AND (coalesce(list_position(names, 'datetime'), 0) = 0 OR list_position(names, 'date') < list_position(names, 'datetime')) THEN list_position(names, 'date') ELSE list_position(names, 'datetime') END AS at_d, list_position(names, 'close') AS at_c FROM h2),
b AS (SELECT DISTINCT l.line_id, l.line_no, l.file_name AS file, regexp_replace(coalesce(l.line, ''), '\r$', '') AS x, h.* FROM csv_lines l LEFT JOIN h USING (file_name) WHERE l.line_no IS NULL OR l.line_no <> 1),
p AS (SELECT *, regexp_full_match(x, '(?s)(?:"(?:[^"]|"")*"|[^"' || sep || ']*)(?:' || sep || '(?:"(?:[^"]|"")*"|[^"' || sep || ']*))*') AS quoted_well, regexp_extract_all(x || sep, '("(?:[^"]|"")*"|[^"' || sep || ']*)' || sep, 1) AS f FROM b),
v AS (SELECT *, list_transform(f, lambda y: trim(CASE WHEN trim(y, ' 	') LIKE '"%' THEN replace(substr(trim(y, ' 	'), 2, length(trim(y, ' 	')) - 2), '""', '"') ELSE y END, ' 	')) AS vals FROM p),
j AS (SELECT line_id, line_no, file, vals[at_d] AS dt, vals[at_c] AS cl, CASE WHEN NOT quoted_well THEN 'quoting' WHEN sep IS NULL OR trim(x, ' 	') = '' OR len(f) <> len(names) THEN 'columns'
  WHEN NOT coalesce(regexp_full_match(vals[at_d], '[0-9]{4}-[0-9]{2}-[0-9]{2}([ T]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?)?') AND try_strptime(substr(vals[at_d], 1, 10), '%Y-%m-%d') IS NOT NULL, false) THEN 'datetime'
  WHEN NOT coalesce(regexp_full_match(vals[at_c], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(TRY_CAST(vals[at_c] AS DOUBLE)), false) THEN 'close' END AS reason FROM v)
"""

#: The regular grid of both tables: each slot with its last reading; readings numbered by slot, with their neighbours and the slopes of the curve.
_GRID = """WITH f AS (SELECT DISTINCT file_id, step_minutes AS st, sessions = '24x5' AS wk FROM price_files),
r0 AS (SELECT 'ohlc' AS tab, CAST(o.file_id AS VARCHAR) AS src, f.st, f.wk, time_bucket(to_minutes(f.st), o.ts, TIMESTAMP '2000-01-03') AS slot, {'a': o.ts, 'b': o.bar_id, 'c': 0.0} AS ord, o.close AS v FROM ohlc o JOIN f USING (file_id) WHERE o.close IS NOT NULL
  UNION ALL SELECT 'algo_returns', algo_id, 1440, true, CAST(date AS TIMESTAMP), {'a': CAST(loaded_at AS TIMESTAMP), 'b': 0, 'c': close}, close FROM algo_returns WHERE close IS NOT NULL AND algo_id IS NOT NULL),
sl AS (SELECT tab, src, slot, arg_max(v, ord) AS v FROM r0 WHERE NOT (wk AND isodow(slot) > 5) GROUP BY ALL),
e AS (SELECT tab, src, st, wk, min(slot) AS a, max(slot) AS z FROM r0 GROUP BY ALL HAVING count(*) FILTER (NOT (wk AND isodow(slot) > 5)) > 0),
g0 AS (SELECT tab, src, wk, unnest(generate_series(a, z, to_minutes(st))) AS slot FROM e), g AS (SELECT tab, src, slot, row_number() OVER (PARTITION BY tab, src ORDER BY slot) AS k FROM g0 WHERE NOT (wk AND isodow(slot) > 5)),
kn AS (SELECT g.tab, g.src, g.k, sl.v, lag(g.k) OVER w AS pk, lag(sl.v) OVER w AS pv, lead(g.k) OVER w AS qk, lead(sl.v) OVER w AS qv, lead(g.k, 2) OVER w AS rk, lead(sl.v, 2) OVER w AS rv FROM g JOIN sl USING (tab, src, slot) WINDOW w AS (PARTITION BY g.tab, g.src ORDER BY g.k)),
d AS (SELECT *, CAST(qk - k AS DOUBLE) AS h, (qv - v) / (qk - k) AS s, CASE WHEN k - pk <= 11 THEN CAST(k - pk AS DOUBLE) END AS hl, CASE WHEN k - pk <= 11 THEN (v - pv) / (k - pk) END AS sl, CASE WHEN rk - qk <= 11 THEN CAST(rk - qk AS DOUBLE) END AS hr, CASE WHEN rk - qk <= 11 THEN (rv - qv) / (rk - qk) END AS sr FROM kn),
en AS (SELECT *, ((2 * h + hr) * s - h * sr) / (h + hr) AS e0, ((2 * h + hl) * s - h * sl) / (h + hl) AS e1 FROM d),
m AS (SELECT *, CASE WHEN hl IS NOT NULL THEN CASE WHEN sl * s > 0 THEN (3 * (h + hl)) / ((2 * h + hl) / sl + (h + 2 * hl) / s) ELSE 0 END WHEN hr IS NOT NULL THEN CASE WHEN sign(e0) <> sign(s) THEN 0 WHEN sign(s) <> sign(sr) AND abs(e0) > 3 * abs(s) THEN 3 * s ELSE e0 END ELSE s END AS m0,
  CASE WHEN hr IS NOT NULL THEN CASE WHEN sr * s > 0 THEN (3 * (h + hr)) / ((2 * hr + h) / s + (hr + 2 * h) / sr) ELSE 0 END WHEN hl IS NOT NULL THEN CASE WHEN sign(e1) <> sign(s) THEN 0 WHEN sign(s) <> sign(sl) AND abs(e1) > 3 * abs(s) THEN 3 * s ELSE e1 END ELSE s END AS m1 FROM en),
x AS (SELECT g.tab, g.src, g.slot, g.k - m.k AS i, (g.k - m.k) / m.h AS t, m.* EXCLUDE (tab, src) FROM g ASOF LEFT JOIN m ON g.tab = m.tab AND g.src = m.src AND g.k >= m.k)
"""

SQL = {
    "p1_found": """
WITH iv AS (
  SELECT DISTINCT algo_id, date_open AS s, coalesce(date_close, TIMESTAMP '2025-06-30 00:00:00') AS e FROM trades
  WHERE algo_id IS NOT NULL AND date_open IS NOT NULL AND coalesce(date_close, TIMESTAMP '2025-06-30 00:00:00') >= date_open
), o AS (
  SELECT *, max(e) OVER (PARTITION BY algo_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv
), g AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY algo_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o
), p AS (SELECT algo_id, min(s) AS s, max(e) AS e FROM g GROUP BY algo_id, island),
n AS (SELECT *, lead(s) OVER (PARTITION BY algo_id ORDER BY s) AS nx FROM p)
SELECT algo_id, 'period' AS kind, strftime(s, '%Y-%m-%d %H:%M:%S') AS from_ts, strftime(e, '%Y-%m-%d %H:%M:%S') AS to_ts FROM n
UNION ALL
SELECT algo_id, 'gap', strftime(e, '%Y-%m-%d %H:%M:%S'), strftime(nx, '%Y-%m-%d %H:%M:%S') FROM n WHERE nx IS NOT NULL
""",
    "p5_found": """
WITH d AS (SELECT DISTINCT algo_id, CAST(date AS DATE) AS day, ret FROM algo_returns WHERE algo_id IS NOT NULL AND date IS NOT NULL),
span AS (SELECT algo_id, min(day) AS a, max(day) AS z FROM d GROUP BY algo_id),
cal AS (SELECT algo_id, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
x AS (SELECT cal.algo_id, cal.day, coalesce(d.ret, 0.0) AS r FROM cal LEFT JOIN d ON d.algo_id = cal.algo_id AND d.day = cal.day),
f AS (
  SELECT algo_id, day, row_number() OVER w AS n, avg(r) OVER w21 AS m, stddev_pop(r) OVER w21 AS sd, product(1 + r) OVER w63 - 1 AS rr FROM x
  WINDOW w AS (PARTITION BY algo_id ORDER BY day), w21 AS (PARTITION BY algo_id ORDER BY day ROWS 20 PRECEDING), w63 AS (PARTITION BY algo_id ORDER BY day ROWS 62 PRECEDING)
), t AS (
  SELECT algo_id, day, CASE WHEN n >= 21 THEN CASE WHEN sd <= 1e-10 THEN 0 ELSE m / sd * sqrt(252) END END AS s, CASE WHEN n >= 63 THEN rr END AS rr FROM f
)
SELECT DISTINCT a.algo_id, strftime(CAST(a.date AS DATE), '%Y-%m-%d') AS day
FROM algo_features a LEFT JOIN t ON t.algo_id = a.algo_id AND t.day = CAST(a.date AS DATE)
WHERE coalesce(abs(a.rolling_sharpe_21d - t.s) > 0.001, (a.rolling_sharpe_21d IS NULL) <> (t.s IS NULL))
   OR coalesce(abs(a.rolling_return_63d - t.rr) > 0.001, (a.rolling_return_63d IS NULL) <> (t.rr IS NULL))
""",
    "p5_rolling": """
WITH d AS (SELECT DISTINCT algo_id, CAST(date AS DATE) AS day, ret FROM algo_returns WHERE algo_id IS NOT NULL AND date IS NOT NULL),
span AS (SELECT algo_id, min(day) AS a, max(day) AS z FROM d GROUP BY algo_id),
cal AS (SELECT algo_id, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
x AS (SELECT cal.algo_id, cal.day, coalesce(d.ret, 0.0) AS r FROM cal LEFT JOIN d ON d.algo_id = cal.algo_id AND d.day = cal.day),
f AS (
  SELECT algo_id, day, row_number() OVER w AS n, sum(r) OVER w7 AS s7, sum(r) OVER w30 AS s30, avg(r) OVER w21 AS m, stddev_pop(r) OVER w21 AS sd, product(1 + r) OVER w63 - 1 AS rr FROM x
  WINDOW w AS (PARTITION BY algo_id ORDER BY day), w7 AS (PARTITION BY algo_id ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY algo_id ORDER BY day ROWS 29 PRECEDING),
    w21 AS (PARTITION BY algo_id ORDER BY day ROWS 20 PRECEDING), w63 AS (PARTITION BY algo_id ORDER BY day ROWS 62 PRECEDING)
)
SELECT algo_id, strftime(day, '%Y-%m-%d') AS day, round(s7, 9) + 0.0 AS total_7, round(s7 / 7, 9) + 0.0 AS mean_7, round(s30, 9) + 0.0 AS total_30, round(s30 / 30, 9) + 0.0 AS mean_30,
  CASE WHEN n >= 21 THEN CASE WHEN sd <= 1e-10 THEN 0 ELSE round(m / sd * sqrt(252), 6) + 0.0 END END AS sharpe, CASE WHEN n >= 63 THEN round(rr, 9) + 0.0 END AS compound
FROM f
""",
    "p6_found": """
WITH r AS (
  SELECT o.file_id, f.step_minutes AS st, f.sessions = '24x5' AS wk, time_bucket(to_minutes(f.step_minutes), o.ts, TIMESTAMP '2000-01-03') AS slot
  FROM ohlc o JOIN (SELECT DISTINCT file_id, step_minutes, sessions FROM price_files) f USING (file_id) WHERE o.close IS NOT NULL
), s AS (SELECT DISTINCT file_id, st, wk, slot FROM r WHERE NOT (wk AND isodow(slot) > 5)),
e AS (SELECT file_id, st, wk, min(slot) AS a, max(slot) AS z FROM r GROUP BY ALL HAVING count(*) FILTER (NOT (wk AND isodow(slot) > 5)) > 0),
g AS (SELECT file_id, wk, unnest(generate_series(a, z, to_minutes(st))) AS slot FROM e),
d AS (SELECT DISTINCT algo_id, CAST(date AS TIMESTAMP) AS day FROM algo_returns WHERE close IS NOT NULL),
de AS (SELECT algo_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM d GROUP BY algo_id HAVING count(*) FILTER (isodow(day) <= 5) > 0)
SELECT 'ohlc' AS tab, CAST(g.file_id AS VARCHAR) AS source_key, strftime(g.slot, '%Y-%m-%d %H:%M') AS slot
FROM g LEFT JOIN s ON s.file_id = g.file_id AND s.slot = g.slot WHERE s.slot IS NULL AND NOT (g.wk AND isodow(g.slot) > 5)
UNION ALL
SELECT 'algo_returns', de.algo_id, strftime(de.day, '%Y-%m-%d') FROM de LEFT JOIN d ON d.algo_id = de.algo_id AND d.day = de.day
WHERE d.day IS NULL AND isodow(de.day) <= 5
""",
    "p4_found": _LINES + "SELECT line_id, reason FROM j WHERE reason IS NOT NULL",
    "p4_rows": _LINES + """SELECT DISTINCT line_id, file AS file_name, line_no, substr(dt, 1, 10) || ' ' || rpad(substr(dt, 12), 8, ':00') AS datetime, CAST(cl AS DOUBLE) AS close
FROM (SELECT * REPLACE (CASE WHEN length(dt) = 10 THEN dt || ' 00:00' ELSE dt END AS dt) FROM j WHERE reason IS NULL)""",
    "p6_grid": _GRID + """SELECT tab, src AS source_key, strftime(slot, '%Y-%m-%d %H:%M') AS slot,
  round(CASE WHEN i = 0 THEN v WHEN h <= 11 THEN (1 + 2 * t) * (1 - t) * (1 - t) * v + t * (1 - t) * (1 - t) * h * m0 + t * t * (3 - 2 * t) * qv + t * t * (t - 1) * h * m1 END, 6) + 0.0 AS value,
  CASE WHEN i = 0 THEN 'reading' WHEN h <= 11 THEN 'filled' ELSE 'gap' END AS state FROM x""",
}

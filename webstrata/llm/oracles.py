"""DuckDB SQL that gives the same rows as the queries it is named after."""

from __future__ import annotations

NEAR_VECTORS = """
WITH RECURSIVE usable AS (
  SELECT DISTINCT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.93),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
smallest AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, s.b) AS component_id, coalesce(least(e.vec_id, s.b) = e.vec_id, false) AS kept
FROM embeddings e LEFT JOIN counted c ON c.a = e.vec_id LEFT JOIN smallest s ON s.a = e.vec_id
"""

PARITY_JOIN = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
flat AS (SELECT doc_id, unnest(s) AS s FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM flat a JOIN flat b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT m.a, m.b FROM met m JOIN sets a ON a.doc_id = m.a JOIN sets b ON b.doc_id = m.b
  WHERE 100 * m.n >= 80 * (len(a.s) + len(b.s) - m.n)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
smallest AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, m.b) AS component_id FROM sets s LEFT JOIN smallest m ON m.a = s.doc_id
"""

QUOTE_LINKS = """
WITH RECURSIVE messages AS (SELECT row_number() OVER () AS r, conv_id, turn, role, text FROM conversations),
raw AS (SELECT r, unnest(ls) AS x, generate_subscripts(ls, 1) AS i
        FROM (SELECT r, string_split_regex(coalesce(text, ''), '\\r?\\n') AS ls FROM messages)),
levels AS (SELECT r, i, x, length(regexp_replace(regexp_extract(x, '^(?:[ \\t]*>)+'), '[^>]', '', 'g')) AS level,
                  regexp_replace(x, '^(?:[ \\t]*>)+[ \\t]?', '') AS content FROM raw),
lines AS (SELECT r, i, content, CASE WHEN level = 0 AND lead(level) OVER (PARTITION BY r ORDER BY i) > 0
            AND regexp_matches(x, '(?i)(?:wrote|schrieb|escribió|a écrit)[ \\t]*:[ \\t]*$') THEN -1 ELSE level END AS level FROM levels),
kinds AS (SELECT *, CASE WHEN trim(content) = '' THEN -2 ELSE level END AS kind FROM lines),
runs AS (SELECT *, sum(step) OVER (PARTITION BY r ORDER BY i) AS run
         FROM (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY r ORDER BY i) THEN 0 ELSE 1 END AS step FROM kinds)),
passages AS (SELECT r, run, kind AS level, string_agg(content, ' ' ORDER BY i) AS content FROM runs WHERE kind >= 0 GROUP BY r, run, kind),
owned AS (SELECT r, regexp_replace(string_agg(content, chr(10) ORDER BY i), '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g') AS own
          FROM lines WHERE level = 0 GROUP BY r),
forms AS (
  SELECT r, run, level, trim(regexp_replace(lower(content), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS form, false AS line FROM passages
  UNION ALL SELECT r, run, kind, trim(regexp_replace(lower(content), '[ \\t\\r\\n\\f]+', ' ', 'g')), true FROM runs WHERE kind >= 0
  UNION ALL SELECT r, 0, 0, trim(regexp_replace(lower(own), '[ \\t\\r\\n\\f]+', ' ', 'g')), false FROM owned),
units AS (SELECT DISTINCT m.conv_id, m.turn, f.r, f.run, f.level, f.form FROM forms f JOIN messages m USING (r)
          WHERE form <> '' AND (NOT line OR level = 0 OR length(form) >= 16) AND conv_id IS NOT NULL AND turn IS NOT NULL),
originals AS (SELECT conv_id, form, min(turn) AS original FROM units WHERE level = 0 GROUP BY ALL),
found AS (SELECT u.conv_id, u.turn, u.level, o.original, u.run, max(length(u.form)) AS chars
          FROM units u JOIN originals o ON o.conv_id = u.conv_id AND o.form = u.form WHERE u.level > 0 AND o.original < u.turn GROUP BY ALL),
weighed AS (SELECT conv_id, turn, level, original, sum(chars) AS chars, count(*) AS n FROM found GROUP BY ALL),
links AS (SELECT conv_id, turn, max(ROW(-level, chars, original)) AS best, sum(n) AS n_linked FROM weighed GROUP BY ALL),
replies AS (SELECT conv_id, turn, best[3] AS reply_to, n_linked FROM links),
chain AS (SELECT conv_id, turn, reply_to AS thread, 1 AS depth FROM replies
          UNION SELECT c.conv_id, c.turn, p.reply_to, c.depth + 1 FROM chain c JOIN replies p ON p.conv_id = c.conv_id AND p.turn = c.thread),
placed AS (SELECT conv_id, turn, min(thread) AS thread, max(depth) AS depth FROM chain GROUP BY ALL),
quoted AS (SELECT r, count(*) AS n FROM passages WHERE level > 0 GROUP BY r),
joined AS (SELECT m.conv_id, m.turn, m.role, coalesce(o.own, '') AS text, coalesce(p.thread, m.turn) AS thread, l.reply_to, coalesce(p.depth, 0) AS depth,
                  coalesce(q.n, 0) AS n_quotes, coalesce(l.n_linked, 0)::BIGINT AS n_linked, md5(m.text) AS tie
           FROM messages m LEFT JOIN owned o USING (r) LEFT JOIN quoted q USING (r)
           LEFT JOIN replies l ON l.conv_id = m.conv_id AND l.turn = m.turn LEFT JOIN placed p ON p.conv_id = m.conv_id AND p.turn = m.turn)
SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY thread NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, tie NULLS FIRST) - 1 AS position,
       thread, reply_to, depth::BIGINT AS depth, n_quotes, n_linked FROM joined
"""

FILTER_AUDIT = """
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM words GROUP BY t),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > first_id, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM words JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
cells AS (
  SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END
         || CASE WHEN e THEN 'E' ELSE '' END AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT x AS o FROM letters UNION ALL SELECT o || x FROM orders JOIN letters ON strpos(o, x) = 0 WHERE length(o) < 5),
placed AS (
  SELECT part, o, n, good, toxic, fails, list_min([strpos(o, f) FOR f IN string_split(fails, '') IF f <> '']) AS gone
  FROM cells CROSS JOIN orders WHERE length(o) = 5),
steps AS (SELECT *, o[step] AS letter FROM placed CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
metrics AS (
  SELECT part, o AS filter_order, step, letter, coalesce(sum(n) FILTER (gone IS NULL OR gone > step), 0) AS kept,
         coalesce(sum(n) FILTER (gone = step), 0) AS removed, coalesce(sum(n) FILTER (gone < step AND contains(fails, letter)), 0) AS redundant,
         coalesce(sum(n) FILTER (fails = letter), 0) AS unique_fails, coalesce(sum(good) FILTER (gone = step), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (gone = step), 0) AS toxic_lost
  FROM steps GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM metrics
"""


def _transform_codes(rounds: int = 6) -> str:
    """Plain product codes: each round's squared distances of all parts to all entries, then floored means."""
    sql = """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT r, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS v FROM kept CROSS JOIN (SELECT unnest(range(8)) AS p)),
book0 AS (SELECT p, r - 1 AS e, v AS c FROM parts WHERE r <= 16),"""
    distance = "list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(parts.v, c)])"
    for k in range(rounds + 1):
        sql += f"""
near{k} AS (SELECT r, p, min(ROW({distance}, e)) AS best FROM parts JOIN book{k} USING (p) GROUP BY ALL),"""
        if k < rounds:
            sql += f"""
mean{k} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, e, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
    FROM (SELECT p, best[2] AS e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{k} JOIN parts USING (r, p)) GROUP BY ALL) GROUP BY ALL),
book{k + 1} AS (SELECT p, e, coalesce(mean{k}.c, book{k}.c) AS c FROM book{k} LEFT JOIN mean{k} USING (p, e)),"""
    return sql + f"""
coded AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near{rounds} GROUP BY ALL),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r) CROSS JOIN books
"""


TRANSFORM_CODES = _transform_codes()
